"""Benchmark decontamination by CGK embedding and bit-sampling LSH."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialise, narrow, small_batches

U = np.uint64
#: Sizes of windows.  Those from ANCHORED on begin at anchors only: one word of EVERY, by its hash.
SIZES = (1, 2, 3, 4, 5, 6, 8, 11, 16, 32, 64, 128)
ANCHORED, EVERY = 16, 3
#: Windows of fewer words are sampled at a step less, such of more words at twice as many samples.
SHORT, LONG = 11, 64
#: A window may begin a word or two beside its place in the item and still share a key; at an anchor hardly more than one.
SLIP, ANCHOR_SLIP = 2, 1
#: Places of documents that are looked at together.
PIECE = 1 << 15
#: Bits of one block of the filter, and bytes of rows in a batch.
BLOCK = 16
BATCH = 4 << 20


@dataclass(frozen=True)
class DecontaminationParams:
    """similarity: 1 - edits / words of the item, for a match.

    walks, samples, bits: each walk's embedding is sampled ``samples`` times at
    ``bits`` steps.  filter_bits: the filter of the items' keys has at most
    2**filter_bits bits; a full one lets more windows through and loses none.
    """

    similarity: float = 0.8
    walks: int = 3
    samples: int = 6
    bits: int = 3
    filter_bits: int = 26
    seed: int = 11

    def edits(self, words: int) -> int:
        return int((1 - self.similarity) * words + 1e-9)


#: ASCII bytes that are no letters or digits.
MARKS = bytes(i for i in range(128) if not chr(i).isalnum())
MARKS_IN_WORDS = MARKS.translate(None, b" \t\n\r\x0b\x0c")
OTHER_MARKS = re.compile(r"[^\w\n]+|_+")


class PlainWords(dict):
    """Hashes of words in plain form (letters and digits, case-folded); 0 for a word with neither."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        form = word.lower().translate(None, MARKS).decode() if word.isascii() else "".join(c for c in word.decode("utf-8", "replace").casefold() if c.isalnum())
        self[word] = h = (xxhash.xxh3_64_intdigest(form) | 1) if form else 0
        return h


def plain_words(text: str | None, words: PlainWords) -> np.ndarray:
    raw = (text or "").encode().split()
    h = np.fromiter(map(words.__getitem__, raw), U, len(raw))
    return h[h != 0]


def plain_hashes(raw: list[str]) -> np.ndarray:
    """What PlainWords has for words that are lower-cased and free of MARKS as far as ASCII goes."""
    forms, other = raw, [i for i, w in enumerate(raw) if not w.isascii()]
    if other:
        forms = raw.copy()
        for i, form in zip(other, OTHER_MARKS.sub("", "\n".join(raw[i] for i in other).casefold()).split("\n"), strict=True):
            forms[i] = form
    return np.fromiter(((xxhash.xxh3_64_intdigest(x) | 1) if x else 0 for x in forms), U, len(forms))


def laid_words(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(``plain_words`` of all texts, a 0 after each text and one more; where each text begins; its number of words).

    Each different word of the texts is hashed once.
    """
    plain = [(t or "").encode().lower().translate(None, MARKS_IN_WORDS) for t in texts]
    split = pc.ascii_split_whitespace(pa.array(plain, pa.large_binary()).cast(pa.large_string()))
    raw = split.flatten().dictionary_encode()
    h = plain_hashes(raw.dictionary.to_numpy(zero_copy_only=False).tolist())[raw.indices.to_numpy()]
    kept = np.flatnonzero(h)
    lengths = np.diff(np.searchsorted(kept, split.offsets.to_numpy()))
    firsts = np.cumsum(lengths + 1) - lengths - 1
    laid = np.zeros(len(kept) + len(plain) + 1, U)
    laid[np.arange(len(kept)) + np.repeat(np.arange(len(plain)), lengths)] = h[kept]
    return laid, firsts, lengths


class Walks:
    """The CGK walks and the steps sampled from them, for windows of the given sizes.

    A walk copies the word at its pointer; a coin for step and word moves the
    pointer on or not.  Windows that differ by an edit fall into step again, so
    that equal words at equal steps tell of a small edit distance.  A window of
    n words is walked n steps, which never leave it.
    """

    def __init__(self, sizes: list[int], p: DecontaminationParams):
        rng = np.random.default_rng(p.seed)
        self.p, self.sizes = p, sizes
        #: Bit t of a word's product with these is the coin of step t, 64 steps each.
        self.coins = rng.integers(1, 2**63, (p.walks, -(-SIZES[-1] // 64)), U) * U(2) + U(1)
        self.factors = rng.integers(1, 2**63, p.bits, U) * U(2) + U(1)
        self.steps = {n: self._drawn(n) for n in sizes}

    def _drawn(self, n: int) -> np.ndarray:
        """The steps of each sample, apart from each other where the window has room."""
        p, rng = self.p, np.random.default_rng([self.p.seed, n])
        bits = max(1, p.bits - (n < SHORT))
        gap = max(0, min(n // 5, (n - 1) // max(1, bits - 1)))
        free = np.sort(rng.integers(0, n - gap * (bits - 1), (p.walks, p.samples * (2 if n >= LONG else 1), bits)), 2)
        return free + gap * np.arange(bits)

    def keys(self, words: np.ndarray, at: np.ndarray, telling: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(size, keys of the windows that begin at the places ``at``) of each sample; ``words`` ends with 0.

        A walk may stay on one word, and then a sample tells of fewer words:
        ``telling`` gives the number of words instead of the key.
        """
        for walk in range(self.p.walks):
            wanted = {int(t) for n in self.sizes for t in self.steps[n][walk].flat}
            pointer, seen = at.copy(), {}
            for step in range(max(wanted) + 1):
                if step % 64 == 0:
                    lo, hi = int(at.min()), min(len(words), int(at.max()) + SIZES[-1] + 1)
                    tossed = words[lo:hi] * self.coins[walk, step // 64]
                    tossed = (tossed ^ (tossed >> U(32))).view(np.int64)
                    pointer -= lo
                if step in wanted:
                    seen[step] = pointer + lo if telling else words[pointer + lo]
                pointer += (tossed[pointer] >> (step % 64)) & 1
                if step % 64 == 63:
                    pointer += lo
            for n in self.sizes:
                for sample, steps in enumerate(self.steps[n][walk].tolist()):
                    if telling:
                        yield n, 1 + sum(seen[a] != seen[b] for a, b in zip(steps[:-1], steps[1:], strict=True))
                        continue
                    key = seen[steps[0]] * self.factors[0]
                    for factor, step in zip(self.factors[1:], steps[1:], strict=False):
                        key += seen[step] * factor
                    key += U(((n * 64 + walk) * 4096 + sample) * 0x9E3779B97F4A7C15 % 2**64)
                    yield n, key


#: Factors of the probes of a filter.
FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def probe(keys: np.ndarray, width: int, factor: int) -> np.ndarray:
    return ((keys * U(factor)) >> U(64 - width)).view(np.int64)


def probes(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """The three bits of each key in a filter of 2**width bits."""
    return [probe(keys, width, f) for f in FACTORS]


def anchors(words: np.ndarray) -> np.ndarray:
    """Which words windows begin at."""
    return (words != 0) & ((words * U(0xD6E8FEB86659FD93) >> U(32)) % U(EVERY) == 0)


def word_keys(words: np.ndarray, n: int) -> np.ndarray:
    """Keys by which the filter knows the words of items whose windows have ``n`` words."""
    return words + U(n * 0xD6E8FEB86659FD93 % 2**64)


def begins(words: np.ndarray, lo: int, n: int, foreign: int, flags: np.ndarray, width: int) -> np.ndarray:
    """Which of the PIECE places from ``lo`` on may begin a window that shares a key with an item.

    A window of ``n`` words in a match has at most ``foreign`` words that are
    in no item of the size: each of them is an edit, or stands for a word that
    was taken out.  The filter knows all words of items, and some more.
    """
    here = words[lo : lo + PIECE]
    fit = anchors(here) if n >= ANCHORED else here != 0
    if foreign < n:
        known = np.zeros(len(here) + n + 1, np.int32)  # beyond the end nothing is known
        seen = flags[probe(word_keys(words[lo : lo + len(here) + n], n), width, FACTORS[0])]
        known[1 : len(seen) + 1] = np.cumsum(seen, dtype=np.int32)
        known[len(seen) + 1 :] = known[len(seen)]
        fit &= known[n : n + len(here)] - known[: len(here)] >= n - foreign
    return fit


def parts_of(words: np.ndarray) -> tuple[int, list[int]]:
    """(size of the windows, offsets of the windows of an item): the largest size that leaves room for two anchors, some distance apart."""
    for n in reversed([x for x in SIZES if x <= len(words)]):
        last = len(words) - n
        if n < ANCHORED:
            return n, [*range(0, last, n), last]
        offsets = []
        for at in np.flatnonzero(anchors(words[: last + 1])).tolist():
            if not offsets or at - offsets[-1] >= n // 8:
                offsets.append(at)
        if len(offsets) > 1:
            return n, offsets
    raise ValueError("an item without words")


def reach(n: int, longest: int, p: DecontaminationParams) -> tuple[int, int] | None:
    """Words before and after the begin of a window of size ``n`` that an item of ``longest`` words may take; None for whole documents."""
    return None if longest > 8 * SIZES[-1] else (longest - n + 2 * p.edits(longest), longest + 2 * p.edits(longest))


def shared_words(words: np.ndarray, counts: np.ndarray, region: np.ndarray) -> int:
    """How many words an item (its different words in order, and how often each is in it) and a region have in common, repeats counted."""
    at = np.minimum(np.searchsorted(words, region), len(words) - 1)
    return int(np.minimum(np.bincount(at[words[at] == region], minlength=len(words)), counts).sum())


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, first, end) of the part of ``region`` at the smallest edit distance from ``item``."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else steps.copy()
        for x in a:
            diagonal = row[:-1] + (b != x)
            row = np.concatenate([row[:1] + 1, np.minimum(diagonal, row[1:] + 1)])
            row = np.minimum.accumulate(row - steps) + steps
        return row

    row = last_row(item, region, True)
    end = int(row.argmin())
    back = last_row(item[::-1], region[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


def _batches(rows: Iterator[tuple], columns: list[str], sized: list[int]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(row[i]) * (8 if isinstance(row[i], list) else 1) for i in sized)
        if size >= BATCH:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def item_keys(walks: Walks, words: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Keys of an item's windows; of each window, those that tell of the most words."""
    laid, at = np.append(words, U(0)), np.array(offsets)
    keys = np.stack([k for _, k in walks.keys(laid, at)])
    told = np.stack([k for _, k in walks.keys(laid, at, telling=True)])
    return keys[told == told.max(0)]


def embedded_items(benchmark: DataFrame, p: DecontaminationParams) -> DataFrame:
    """(item, item_id, words, size, keys, known) of the items with a word: keys of all windows that cover the item, and of its words."""
    kind = benchmark.schema["id"].dataType.simpleString()

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, number = PlainWords(), TaskContext.get().partitionId() << 33
        walks: dict[int, Walks] = {}

        def made() -> Iterator[tuple]:
            nonlocal number
            for pdf in batches:
                for item_id, text in zip(pdf["id"], pdf["text"], strict=True):
                    w = plain_words(text, words)
                    if len(w):
                        n, offsets = parts_of(w)
                        of_size = walks.setdefault(n, Walks([n], p))
                        keys, known = np.unique(item_keys(of_size, w, offsets)), word_keys(np.unique(w), n)
                        yield number, item_id, w.tobytes(), n, keys.view(np.int64).tolist(), known.view(np.int64).tolist()
                        number += 1

        yield from _batches(made(), ["item", "item_id", "words", "size", "keys", "known"], [2, 4, 5])

    return benchmark.mapInPandas(embed, f"item long, item_id {kind}, words binary, size int, keys array<long>, known array<long>")


def key_filter(items: DataFrame, p: DecontaminationParams) -> tuple[int, bytes]:
    """(width, bits) of a Bloom filter of all keys, put together from blocks in Spark; 2**filter_bits bits at most."""
    n = items.agg(F.sum(F.size("keys"))).first()[0] or 1
    width = min(p.filter_bits, max(BLOCK, int(64 * n).bit_length()))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.unique(np.concatenate(probes(pdf["key"].to_numpy(np.int64).view(U), width)))
            yield pd.DataFrame({"block": found >> BLOCK, "slot": found & ((1 << BLOCK) - 1)})

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << BLOCK, np.uint8)
        bits[pdf["slot"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    keys = items.select(F.explode("keys").alias("key"))
    made = keys.mapInPandas(slots, "block long, slot long").distinct().groupBy("block").applyInPandas(block, "block long, bits binary").toPandas()
    out = bytearray(1 << width - 3)
    size = 1 << BLOCK - 3
    for at, bits in zip(made["block"], made["bits"], strict=True):
        out[at * size : (at + 1) * size] = bits
    return width, bytes(out)


def regions(docs: DataFrame, longest: dict[int, int], width: int, bits: bytes, p: DecontaminationParams) -> DataFrame:
    """(region, row, id, first, words, keys): the parts of documents around windows whose keys pass the filter.

    longest: words of the longest item of each size of windows.
    """
    kind = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        groups = [x for x in ([n for n in sorted(longest) if n < ANCHORED], [n for n in sorted(longest) if n >= ANCHORED]) if x]
        walks = {tuple(x): Walks(x, p) for group in groups for x in (group, *([n] for n in group))}
        foreign = {n: p.edits(x) + (ANCHOR_SLIP if n >= ANCHORED else SLIP) for n, x in longest.items()}
        reaches = {n: reach(n, x, p) for n, x in longest.items()}
        row = region = TaskContext.get().partitionId() << 33

        def lots(laid: np.ndarray) -> Iterator[tuple[Walks, np.ndarray]]:
            """Walks and the places that may begin their windows: a walk for each size, or one for all where that is shorter."""
            for lo in range(0, len(laid), PIECE):
                for group in groups:
                    fit = [begins(laid, lo, n, foreign[n], flags, width) for n in group]
                    any_size = np.logical_or.reduce(fit)
                    if group[-1] * np.count_nonzero(any_size) <= sum(n * np.count_nonzero(x) for n, x in zip(group, fit, strict=True)):
                        yield walks[tuple(group)], lo + np.flatnonzero(any_size)
                    else:
                        yield from ((walks[(n,)], lo + np.flatnonzero(x)) for n, x in zip(group, fit, strict=True))

        def found(pdf: pd.DataFrame) -> Iterator[tuple]:
            nonlocal region
            laid, firsts, lengths = laid_words(pdf["text"])  # a 0 ends each document, and holds every pointer
            hits = []
            for walk, at in lots(laid):
                for n, keys in walk.keys(laid, at) if len(at) else ():
                    left = np.flatnonzero(flags[probe(keys, width, FACTORS[0])])
                    if len(left):
                        _, second, third = probes(keys[left], width)
                        left = left[flags[second] & flags[third]]
                        hits.append((at[left], keys[left], np.full(len(left), n)))
            if not hits:
                return
            place, key, size = (np.concatenate(x) for x in zip(*hits, strict=True))
            doc = np.searchsorted(firsts, place, "right") - 1
            begin, end = firsts[doc], firsts[doc] + lengths[doc]
            lo, hi = begin.copy(), end.copy()
            for n, around in reaches.items():
                if around:
                    mine = size == n
                    lo[mine] = np.maximum(begin[mine], place[mine] - around[0])
                    hi[mine] = np.minimum(end[mine], place[mine] + around[1])
            order = np.argsort(lo, kind="stable")
            order = order[hi[order] > lo[order]]
            if not len(order):
                return
            lo, hi, key, doc = lo[order], np.maximum.accumulate(hi[order]), key[order], doc[order]
            heads = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
            for a, b in zip(heads, np.append(heads[1:], len(lo)), strict=True):
                d = int(doc[a])
                yield region, row + d, pdf["id"].iat[d], int(lo[a] - firsts[d]), laid[lo[a] : hi[b - 1]].tobytes(), np.unique(key[a:b]).view(np.int64).tolist()
                region += 1

        for pdf in batches:
            if len(pdf):
                yield from _batches(found(pdf), ["region", "row", "id", "first", "words", "keys"], [4, 5])
                row += len(pdf)

    return docs.mapInPandas(scan, f"region long, row long, id {kind}, first long, words binary, keys array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The passages of documents that are benchmark items up to a few edited words.

    Every window of an item's size is embedded by CGK walks over words, and
    samples of its steps are its keys.  One scan of the documents, by a filter
    of the items' words and keys, leaves the windows that have enough words of
    items to be in a match, and may share a key with an item;
    they join the items by key, and the edit distance of each pair that is left
    is computed exactly.  Sizes are rounded down to classes, of ``SIZES[-1]``
    words at most, so that no array is as long as the longest item; longer
    windows begin at anchor words, in items as in documents.

    Returns id, item_id, edits, first_word, end_word (in words with a letter
    or digit), a row for each pair of document and item that match.

    An exact copy is always found, as its windows have all keys of the item.
    At the most edits allowed, samples miss some: the tests measure the recall.

    Null and empty texts, and items without a letter or digit, match nothing;
    an item of few words allows no edit.  Equal items are matched each;
    repeated rows give repeated matches; rows without id are reported with a
    null id.  If either table is empty, so is the result.
    """
    p, spark = params, docs.sparkSession
    small_batches(spark)
    rows = narrow(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    entries = narrow(benchmark, id=item_col, text=item_text_col).withColumn("text", F.col("text").cast("string"))
    items = materialise(embedded_items(entries.filter("text is not null"), p), "decontaminate-items")
    longest = {r["size"]: r["n"] for r in items.groupBy("size").agg((F.max(F.octet_length("words")) / 8).cast("int").alias("n")).collect()}  # of the few in SIZES
    kinds = rows.schema["id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    if not longest:
        return spark.createDataFrame([], f"id {kinds[0]}, item_id {kinds[1]}, edits long, first_word long, end_word long")
    in_filter = key_filter(items.select(F.concat("keys", "known").alias("keys")), p)
    found = materialise(regions(rows, longest, *in_filter, p), "decontaminate-regions")
    pairs = found.select("region", F.explode("keys").alias("key")).join(items.select("item", F.explode("keys").alias("key")), "key").select("region", "item").distinct()
    met = pairs.join(items.select("item", "item_id", F.col("words").alias("of_item")), "item").join(found.drop("keys"), "region")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, counted = [], {}
            for i, (k, of_item, raw, first) in enumerate(zip(pdf["item"], pdf["of_item"], pdf["words"], pdf["first"], strict=True)):
                item, region = np.frombuffer(of_item, U), np.frombuffer(raw, U)
                most = p.edits(len(item))
                if k not in counted:
                    counted[k] = np.unique(item, return_counts=True)
                # A match has all but ``most`` words of the item, each as often.
                if shared_words(*counted[k], region) >= len(item) - most:
                    edits, lo, hi = best_match(item, region)
                    if edits <= most:
                        out.append((i, edits, first + lo, first + hi))
            at, edits, lo, hi = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else [np.empty(0, np.int64)] * 4
            yield pd.DataFrame({c: pdf[c].iloc[at].to_numpy() for c in ("row", "id", "item", "item_id")} | {"edits": edits, "first_word": lo, "end_word": hi})

    schema = f"row long, id {kinds[0]}, item long, item_id {kinds[1]}, edits long, first_word long, end_word long"
    matches = met.select("row", "id", "item", "item_id", "first", "words", "of_item").mapInPandas(verify, schema)
    best = matches.groupBy("row", "item").agg(F.min(F.struct("edits", "first_word", "end_word", "id", "item_id")).alias("m"))
    return best.select("m.id", "m.item_id", "m.edits", "m.first_word", "m.end_word")
