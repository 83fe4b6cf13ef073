"""Removal of repeated byte strings by suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialise, narrow, small_batches

U = np.uint64


@dataclass(frozen=True)
class SuffixParams:
    """span: length of the strings.  gram: length of the anchors, below span.

    longer: length of the anchors among strings whose first anchor is shared.
    bucket_bytes: text whose fragments, as hashes, make one bucket.  finer: a
    bucket of bytes to sort is so many times smaller.  crowd: distinct
    fragments of one longer anchor beyond which its strings are dealt one by
    one.
    """

    span: int = 100
    gram: int = 24
    longer: int = 64
    bucket_bytes: int = 16 << 20
    finer: int = 16
    piece_bytes: int = 2 << 20
    crowd: int = 2000


# ---- suffix sorting -------------------------------------------------------------------------


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair, in the pairs' order."""
    top = int(b.max(initial=0)) + 1
    if int(a.max(initial=0)) >= (1 << 62) // top:
        a = np.unique(a, return_inverse=True)[1].astype(np.int64)
    return a * top + b


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``t`` (numbers from 1) in order, by the difference cover {1, 2} mod 3."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    padded = np.concatenate([t, np.zeros(3, np.int64)])
    pairs = _joint(padded[:-1], padded[1:])
    # Sampled triples; a dummy at n keeps the two halves of the recursion apart.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triples = _joint(pairs[sample], padded[np.minimum(sample + 2, n + 2)])
    kinds, names = np.unique(triples, return_inverse=True)
    if len(kinds) == len(sample):
        order = np.argsort(names)
    else:
        order = suffix_array(names.astype(np.int64) + 1)
    ordered = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[ordered] = np.arange(1, len(ordered) + 1)
    ordered = ordered[ordered < n]
    # The other suffixes by first symbol and the rank of the rest.
    zero = np.arange(0, n, 3)
    short = _joint(padded[:-1], rank[1:])
    zero = zero[np.argsort(short[zero], kind="stable")]
    # Merge: how many sampled suffixes of either kind come before each of them.
    long = _joint(pairs[: n + 1], rank[2 : n + 3])
    ones, twos = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    at = np.arange(len(zero)) + np.searchsorted(short[ones], short[zero]) + np.searchsorted(long[twos], long[zero])
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[at] = False
    out[at] = zero
    out[free] = ordered
    return out


def repeated(fragments: list[bytes], docs: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, offset) of each string of ``span`` bytes in the fragments that also starts earlier in one of them."""
    sizes = np.array([len(x) for x in fragments])
    raw = np.frombuffer(b"".join(x + b"\0" for x in fragments) + bytes(span), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    text = raw[: ends[-1] + 1].astype(np.int64) + 1
    text[ends] = 257 + np.arange(len(fragments))  # no two fragments end alike
    owner = np.repeat(np.arange(len(fragments)), sizes + 1)
    offset = np.arange(len(text)) - (ends - sizes)[owner]
    order = suffix_array(text)
    order = order[offset[order] + span <= sizes[owner[order]]]
    if not len(order):
        return order, order
    eight = np.zeros(len(raw) - 7, U)
    for i in range(8):
        eight |= raw[i : len(raw) - 7 + i].astype(U) << U(8 * i)
    same = np.ones(len(order) - 1, bool)
    for i in [*range(0, span - 7, 8), span - 8] if span >= 8 else []:
        same &= eight[order[:-1] + i] == eight[order[1:] + i]
    if span < 8:
        same &= (eight[order[:-1]] << U(64 - 8 * span)) == (eight[order[1:]] << U(64 - 8 * span))
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    o = owner[order]
    d, s = docs[o], starts[o] + offset[order]
    place = np.empty(len(order), np.int64)
    sorted_places = np.lexsort((s, d))
    place[sorted_places] = np.cumsum(np.concatenate([[0], (np.diff(d[sorted_places]) != 0) | (np.diff(s[sorted_places]) != 0)]))
    first = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(order))))
    late = place > first
    return o[late], offset[order][late]


# ---- fragments ------------------------------------------------------------------------------


@lru_cache(1)
def _constants() -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(2)
    base = int(rng.integers(1, 2**62)) * 2 + 1
    return rng.integers(0, 2**63, 256, U) * U(2) + U(1), base, pow(base, -1, 1 << 64)


@lru_cache(1)
def _second() -> tuple[int, int]:
    base = int(np.random.default_rng(5).integers(1, 2**62)) * 2 + 1
    return base, pow(base, -1, 1 << 64)


@lru_cache(8)
def _row(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, base, U)]), dtype=U)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(fine, coarse): the power i of ``base`` is fine[i % 2048] * coarse[i // 2048], for i below n."""
    rows = 1 << (n >> 11).bit_length()
    return _row(base, 2048), _row(pow(base, 2048, 1 << 64), rows)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x9FB21C651E98DF25)
    return h ^ (h >> U(28))


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position, by doubling."""
    table, base, _ = _constants()
    h, out, width, done = table[raw], None, 1, 0
    while True:
        if gram & width:
            part = h[done:]
            out = part if out is None else out[: len(part)] * U(pow(base, width, 1 << 64)) + part[: len(out)]
            done += width
        if 2 * width > gram:
            return _mixed(out)
        h = h[:-width] * U(pow(base, width, 1 << 64)) + h[width:]
        width *= 2


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    have, m = 1, x
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == width else np.minimum(m[: len(m) - (width - have)], m[width - have :])


def cut(texts: list[bytes], p: SuffixParams) -> tuple[np.ndarray, ...]:
    """Fragments of the texts: (text, start, strings, anchor hash, two digests).

    Every string of ``span`` bytes has an anchor, its gram of the smallest hash
    (the first of equals).  Strings in a row with the same anchor make a
    fragment; equal strings always have equal anchors.
    """
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    none = tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, U, U, U))
    if len(raw) < p.span:
        return none
    h = gram_hashes(raw, p.gram)
    anchor = (sliding_minimum((h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U), p.span - p.gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
    firsts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    valid = np.flatnonzero(np.arange(len(anchor)) + p.span <= (firsts + sizes)[owner])
    if not len(valid):
        return none
    at = anchor[valid]
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(valid) != 1)]))
    count = np.diff(np.append(heads, len(valid)))
    start, named = valid[heads], h[at[heads]]
    doc = owner[start]
    del anchor, owner, valid, at  # as long as the texts, eight times over

    def digest(values: np.ndarray, base: int, inverse: int) -> np.ndarray:
        fine, coarse = _powers(base, len(h))
        weighed = (coarse[: -(-len(h) // 2048), None] * fine).reshape(-1)[: len(h)]
        weighed *= values
        running = np.concatenate([np.zeros(1, U), np.cumsum(weighed, dtype=U)])
        fine, coarse = _powers(inverse, len(h))
        return _mixed((running[start + count + p.span - p.gram] - running[start]) * fine[start & 2047] * coarse[start >> 11])

    one, two = digest(h, *_constants()[1:]), digest(_mixed(h + U(0x9E3779B97F4A7C15)), *_second())
    return doc, start - firsts[doc], count, named, one, two


def pieces(texts: list[bytes], p: SuffixParams) -> Iterator[tuple[np.ndarray, ...]]:
    """``cut`` over pieces of bounded size; a longer text is taken in overlapping parts."""
    held: list[bytes] = []
    owners: list[int] = []
    begins: list[int] = []
    size = 0

    def made() -> tuple[np.ndarray, ...]:
        doc, start, *rest = cut(held, p)
        return np.array(owners, np.int64)[doc], start + np.array(begins, np.int64)[doc], *rest

    for i, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - p.span + 1), p.piece_bytes):
            part = text[lo : lo + p.piece_bytes + p.span - 1]
            held.append(part)
            owners.append(i)
            begins.append(lo)
            size += len(part)
            if size >= p.piece_bytes:
                yield made()
                held, owners, begins, size = [], [], [], 0
    if held:
        yield made()


SIX = (1 << 48) - 1


def _pack(anchor: np.ndarray, one: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> bytes:
    """Columns one after the other; the anchor, which only says who meets, is cut to six bytes."""
    six = np.ascontiguousarray(anchor.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return np.array([len(doc)], "<u4").tobytes() + b"".join([six, one.astype("<u8").tobytes(), two.astype("<u8").tobytes(), doc.astype("<i8").tobytes(), start.astype("<u4").tobytes(), count.astype("<u2").tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, at, out = int(np.frombuffer(blob, "<u4", 1)[0]), 4, []
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
    out.append(wide.reshape(-1).view("<u8"))
    at += 6 * n
    for kind, size in (("<u8", 8), ("<u8", 8), ("<i8", 8), ("<u4", 4), ("<u2", 2)):
        out.append(np.frombuffer(blob, kind, n, at).astype(U if kind == "<u8" else np.int64))
        at += size * n
    return tuple(out)


def _first_of_equals(anchor: np.ndarray, one: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, index of the first equal fragment for each in that order); the first has the smallest (doc, start)."""
    order = np.lexsort((start, doc, count, two, one, anchor))
    other = np.zeros(max(0, len(order) - 1), bool)
    for column in (anchor, one, two, count):
        other |= np.diff(column[order]) != 0
    heads = np.flatnonzero(np.concatenate([[True], other])) if len(order) else np.empty(0, np.int64)
    return order, np.repeat(order[heads], np.diff(np.append(heads, len(order))))


SPAN, WANTED = 0, 1
FOUND = "kind int, id long, start long, count long, anchor long"


def _found(kind: int, doc: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray | int = 0) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "id": doc, "start": start, "count": count, "anchor": anchor if isinstance(anchor, int) else anchor.view(np.int64)})


def deal(parts: Iterator[tuple[np.ndarray, list[bytes], np.ndarray]], p: SuffixParams, buckets: int, turn: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of the fragments; parts: ids, texts and where these begin in their documents.

    Fragments equal to an earlier one of the same stretch of ``bucket_bytes``
    are repeats.  They only pass through and may go anywhere: stretches take
    turns over the buckets (as -1 - bucket), whatever they hold.
    """
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[tuple[int, bytes]]:
        doc, start, count, anchor, one, two = (np.concatenate(x) for x in zip(*held, strict=True))
        anchor = anchor & U(SIX)
        order, first = _first_of_equals(anchor, one, two, doc, start, count)
        late = (doc[order] != doc[first]) | (start[order] != start[first])
        again, ours = order[late], np.unique(first)
        if len(again):
            yield -1 - turn % buckets, _pack(anchor[again], one[again], two[again], doc[again], start[again], count[again])
        bucket = (anchor[ours] % U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        ours, bucket = ours[by], bucket[by]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for x in np.split(ours, cuts) if len(ours) else []:
            yield int(anchor[x[0]] % U(buckets)), _pack(anchor[x], one[x], two[x], doc[x], start[x], count[x])

    for ids, texts, begins in parts:
        for doc, start, *rest in pieces(texts, p):
            held.append((ids[doc], start + begins[doc], *rest))
        size += sum(map(len, texts))
        if held and size >= p.bucket_bytes:
            yield from flush()
            held, size, turn = [], 0, turn + 1
    if held:
        yield from flush()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SuffixParams = SuffixParams()) -> DataFrame:
    """Remove every byte of a ``span``-byte string that also starts earlier.

    Earlier is a smaller id, or an earlier start in the same document; strings
    are judged on the input.  Five steps:

    1. Every string has an anchor (see ``cut``); runs of strings with one
       anchor are fragments.  A fragment equal to an earlier one of its batch
       is a repeat at once and goes no further.
    2. Fragments, as hashes, meet by anchor.  Again all but the first of equal
       ones are repeats.  An anchor whose fragments differ asks for the bytes
       of the first of each kind.
    3. In those bytes every string has a second, longer anchor, and the first
       two steps are done again with these: many texts share a common phrase
       and nothing longer.
    4. The bytes that are still asked for meet by longer anchor, and their
       suffixes are sorted with a difference cover: sampled triples are sorted,
       their names recursed on, the other suffixes merged in.  Neighbours that
       agree in ``span`` bytes are one string, and all but its earliest start
       are repeats.
    5. Documents meet their repeats and lose the bytes that these cover.

    The strings of a longer anchor with more than ``crowd`` kinds of fragments
    are dealt one by one, by their own hash, so that no anchor fills a task.

    Fragments are called equal by two 64-bit digests, their number of strings
    and their anchor: among n fragments of the corpus a pair is mistaken with a
    probability below n**2 / 2**129, 2e-13 for the 10**13 fragments of 100 TB.

    Returns id, n_bytes, n_removed, n_spans (maximal removed runs) and kept
    (the remaining bytes).

    Null text is empty.  A row without id is not searched and keeps its text.
    Rows with the same id count as one place, so repeated rows have the same
    result.  An empty table gives an empty result.
    """
    p, spark = params, docs.sparkSession
    small_batches(spark)
    rows = narrow(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    searched = rows.filter("id is not null")
    total = searched.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // p.bucket_bytes))
    sorts = buckets * p.finer

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
        for pdf in batches:
            yield pdf["id"].to_numpy(np.int64), [bytes(t) for t in pdf["text"]], np.zeros(len(pdf), np.int64)

    def of_runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
        for pdf in batches:
            texts: list[bytes] = []
            for runs, sizes in zip(pdf["runs"], pdf["sizes"], strict=True):
                ends = np.cumsum(sizes)
                texts.extend(runs[lo:hi] for lo, hi in zip((ends - sizes).tolist(), ends.tolist(), strict=True))
            yield np.repeat(pdf["id"].to_numpy(np.int64), [len(x) for x in pdf["sizes"]]), texts, np.concatenate(list(pdf["starts"]))

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.concatenate(x) for x in zip(*map(_unpack, pdf["blob"]), strict=True)]
        anchor, one, two, doc, start, count = parts
        if key[0] < 0:  # found in their batch
            return _found(SPAN, doc, start, count)
        order, first = _first_of_equals(anchor, one, two, doc, start, count)
        late = (doc[order] != doc[first]) | (start[order] != start[first])
        lasts = np.flatnonzero(np.concatenate([np.diff(first) != 0, [True]]))
        kinds = first[lasts]  # one of each kind, in order of anchor
        heads = np.flatnonzero(np.concatenate([[True], np.diff(anchor[kinds]) != 0]))
        number = np.diff(np.append(heads, len(kinds)))
        several = kinds[np.repeat(number > 1, number)]
        crowded = np.repeat(number > p.crowd, number)[np.repeat(number > 1, number)]
        again = order[late]
        marked = anchor[several] | (crowded.astype(U) << U(63))
        return pd.concat([_found(SPAN, doc[again], start[again], count[again]), _found(WANTED, doc[several], start[several], count[several], marked)])

    def level(source: DataFrame, of: Callable, gram: int, name: str) -> DataFrame:
        def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made = deal(of(batches), replace(p, gram=min(gram, p.span)), buckets, TaskContext.get().partitionId())
            while some := list(islice(made, 64)):
                yield pd.DataFrame(some, columns=["bucket", "blob"])

        return materialise(source.mapInPandas(dealt, "bucket long, blob binary").groupBy("bucket").applyInPandas(meet, FOUND), name)

    def asked(met: DataFrame) -> DataFrame:
        """The fragments wanted of each document, as arrays."""
        lists = met.filter(F.col("kind") == WANTED).groupBy("id").agg(F.collect_list(F.struct("start", "count", "anchor")).alias("asked"))
        return lists.select("id", *[F.col(f"asked.{c}").alias(c) for c in ("start", "count", "anchor")])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The bytes of the wanted fragments, those in a row or overlapping as one run."""
        for pdf in batches:
            out = []
            for doc, text, start, count in zip(pdf["id"], pdf["text"], pdf["start"], pdf["count"], strict=True):
                by = np.argsort(start)
                lo, hi = start[by], np.maximum.accumulate((start + count)[by])
                heads = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                starts = lo[heads]
                runs = [text[x : y - 1 + p.span] for x, y in zip(starts.tolist(), hi[np.append(heads[1:], len(lo)) - 1].tolist(), strict=True)]
                out.append((doc, starts, np.array([len(x) for x in runs], np.int64), b"".join(runs)))
            yield pd.DataFrame(out, columns=["id", "starts", "sizes", "runs"])

    met = level(searched, of_texts, p.gram, "suffix-met")
    runs = materialise(searched.join(asked(met), "id").mapInPandas(gather, "id long, starts array<long>, sizes array<long>, runs binary"), "suffix-runs")
    met_again = level(runs, of_runs, max(p.gram, p.longer), "suffix-longer")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, starts, sizes, text, start, count, anchor in zip(*(pdf[c] for c in ("id", "starts", "sizes", "runs", "start", "count", "anchor")), strict=True):
                ends = np.cumsum(sizes)
                run = np.searchsorted(starts, start, "right") - 1
                lo = (ends - sizes)[run] + start - starts[run]
                hi = np.minimum(lo + count - 1 + p.span, ends[run])
                fine = (anchor >= 0) & (hi - lo >= p.span)
                out.extend((b, doc, s, text[x:y]) for b, s, x, y in zip(*((v[fine]).tolist() for v in (anchor % sorts, start, lo, hi)), strict=True))
                crowded = (anchor < 0) & (hi - lo >= p.span)
                if crowded.any():
                    own = gram_hashes(np.frombuffer(text, np.uint8), p.span) % U(sorts)
                    for s, x, y in zip(*((v[crowded]).tolist() for v in (start, lo, hi)), strict=True):
                        out.extend((b, doc, s + i, text[x + i : x + i + p.span]) for i, b in enumerate(own[x : y - p.span + 1].tolist()))
            for lo in range(0, len(out), 5000):
                yield pd.DataFrame(out[lo : lo + 5000], columns=["bucket", "id", "start", "bytes"])

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [bytes(x) for x in pdf["bytes"]]
        doc, start = pdf["id"].to_numpy(np.int64), pdf["start"].to_numpy(np.int64)
        which, offset = repeated(found, doc, start, p.span)
        by = np.lexsort((offset, which))
        which, offset = which[by], offset[by]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(which) != 0) | (np.diff(offset) != 1)])) if len(which) else np.empty(0, np.int64)
        count = np.diff(np.append(heads, len(which))) if len(which) else heads
        return _found(SPAN, doc[which[heads]], start[which[heads]] + offset[heads], count)

    fetched = runs.join(asked(met_again), "id").mapInPandas(fetch, "bucket long, id long, start long, bytes binary")
    sorted_ = fetched.groupBy("bucket").applyInPandas(order, FOUND)
    spans = met.unionByName(met_again).filter(F.col("kind") == SPAN).unionByName(sorted_).groupBy("id").agg(F.collect_list(F.struct("start", "count")).alias("spans"))

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept, removed, runs = [], [], []
            for text, found in zip(pdf["text"], pdf["spans"], strict=True):
                rest, at, gone, n = [], 0, 0, 0
                for lo, hi in _merged(found, p.span):
                    rest.append(text[at:lo])
                    at, gone, n = hi, gone + hi - lo, n + 1
                rest.append(text[at:])
                kept.append(b"".join(rest))
                removed.append(gone)
                runs.append(n)
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": [len(t) for t in pdf["text"]], "n_removed": removed, "n_spans": runs, "kept": kept})

    out = searched.join(spans, "id", "left").select("id", "text", "spans").mapInPandas(strip, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    return out.unionByName(rows.filter("id is null").select("id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept")))


def _merged(found: object, span: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the found strings cover."""
    out: list[tuple[int, int]] = []
    if found is None:
        return out
    for lo, hi in sorted((x["start"], x["start"] + x["count"] - 1 + span) for x in found):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def brute_force(docs: dict[int, bytes], span: int) -> dict[int, tuple[int, int, int, str]]:
    """The definition, for tests: (bytes, removed, runs, sha256 of the rest) of each document."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(docs):
        text = docs[doc]
        gone = bytearray(len(text))
        for i in range(len(text) - span + 1):
            if (w := text[i : i + span]) in seen:
                gone[i : i + span] = b"\1" * span
            seen.add(w)
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        rest = bytes(b for b, x in zip(text, gone, strict=True) if not x)
        out[doc] = len(text), sum(gone), runs, hashlib.sha256(rest).hexdigest()
    return out
