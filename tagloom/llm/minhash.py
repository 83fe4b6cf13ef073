"""Near-duplicate documents by one-permutation MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialise, narrow, small_batches
from tagloom.llm.graph import components

#: Distinct words that a worker remembers the hashes of.
CACHE_WORDS = 1_000_000


@dataclass(frozen=True)
class MinHashParams:
    """bands * rows bins; two sets of similarity s share a band with probability 1 - (1 - s**rows)**bands.

    margin: pairs whose signatures agree in less than the similarity minus this
    aren't compared across components; five standard deviations of the estimate
    at least, measured on sets of ten shingles (0.028).  block: hubs, and
    members of a bucket, that meet in one group.  lot: pairs of one hub that
    are verified together.  rows_per_task: of the groups.
    """

    width: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 8
    margin: float = 0.15
    block: int = 250
    lot: int = 500
    rows_per_task: int = 2000
    seed: int = 17

    @property
    def bins(self) -> int:
        return self.bands * self.rows


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased; runs of other than ASCII white space."""
    return text.encode().lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(8)
def _factors(width: int) -> np.ndarray:
    return np.random.default_rng(width).integers(1, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; with fewer words, of the whole sequence."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    f = _factors(width)
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total += _mixed(h[i : len(h) - n + 1 + i] * f[i] + np.uint64(i + 1))
    return np.unique(_mixed(total))


@lru_cache(2)
def _tables(p: MinHashParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bin, the rank of every bin in its own probing order (itself first); factors of the bands."""
    rng = np.random.default_rng(p.seed)
    order = rng.random((p.bins, p.bins))
    np.fill_diagonal(order, -1)
    rank = order.argsort(1).argsort(1).astype(np.uint16)
    return rank, rng.integers(0, 2**63, (p.bands, p.rows), np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, p.bands, np.uint64)


def signature(hashes: np.ndarray, p: MinHashParams) -> np.ndarray:
    """One minimum a bin from one permutation; an empty bin takes that of the first full bin in its own random order.

    ``hashes`` are sorted and a bin is a range of them, so a bin's minimum is its first.
    """
    bins = ((hashes >> np.uint64(32)) * np.uint64(p.bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    full, low = bins[first], hashes[first]
    out = np.empty(p.bins, np.uint64)
    out[full] = low
    if len(full) < p.bins:
        empty = np.ones(p.bins, bool)
        empty[full] = False
        out[empty] = low[_tables(p)[0][empty][:, full].argmin(1)]
    return out


def band_keys(bins: np.ndarray, p: MinHashParams) -> np.ndarray:
    _, factors, salts = _tables(p)
    rows = _mixed(bins.reshape(p.bands, p.rows))
    return _mixed((rows * factors).sum(1, dtype=np.uint64) + salts).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sign(docs: DataFrame, p: MinHashParams) -> DataFrame:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            n, digests, bands, bytes_ = [], [], [], []
            for text in pdf["text"]:
                s = shingles(text, p.width, hashes)
                bins = signature(s, p) if len(s) else None
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(bins, p) if len(s) else None)
                bytes_.append(_mixed(bins).astype(np.uint8).tobytes() if len(s) else None)
            yield pd.DataFrame({"id": pdf["id"], "n": n, "digest": digests, "bands": bands, "bins": bytes_})

    return docs.mapInPandas(sign, f"id {docs.schema['id'].dataType.simpleString()}, n long, digest binary, bands array<long>, bins binary")


def needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents with one of the ids; the only join that moves all texts."""
    return materialise(docs.join(ids.distinct().hint("merge"), "id", "left_semi"), "minhash-texts")


def _apart(members: DataFrame, docs: DataFrame, p: MinHashParams) -> DataFrame:
    """Links (a, b) between components, from buckets' members (key, band, hub, rep, n, component, bins, bands).

    A bucket's largest component needs no star of its own: each member outside
    it is the hub of a star over the bucket, and a link between components has
    such an end.  Sizes and agreement of the signatures have to allow a pair;
    it is made in the first band that it shares and nowhere else, and not if
    its bucket's own star has it.  Hubs and members are cut into blocks of
    ``block``; each block of hubs meets each block of members in a group of its
    own, so that no group is larger than two blocks.  Of a group, the members
    of pairs that are left get their texts, once each, and the pairs are
    compared on full sets.
    """
    kind = members.schema["rep"].dataType.simpleString()
    counted = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    bucket = counted.groupBy("key").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.sum("c").alias("size"), F.max("c").alias("most"))
    cut = members.join(bucket, "key").withColumns({
        "starred": F.col("hub") == F.col("rep"),
        "apart": F.col("component") != F.col("main"),
        "blocks": F.ceil(F.col("size") / p.block).cast("int"),
        "slices": F.ceil((F.col("size") - F.col("most")) / p.block).cast("int"),
    })
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    columns = ["key", "band", "starred", "rep", "n", "component", "bins", "bands"]
    as_member = cut.select(*columns, F.lit(False).alias("is_hub"), own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    as_hub = cut.filter("apart").select(*columns, F.lit(True).alias("is_hub"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("slices")).cast("int").alias("slice"))
    met = materialise(as_member.unionByName(as_hub), "minhash-apart")
    # Tasks by rows, not by bytes: a row stands for many comparisons.
    tasks, group = max(1, -(-met.count() // p.rows_per_task)), ["key", "block", "slice"]

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        hub = pdf["is_hub"].to_numpy(bool)
        bins, bands = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), p.bins), np.stack(pdf["bands"].to_list())
        n, component, rep, starred = (pdf[c].to_numpy() for c in ("n", "component", "rep", "starred"))
        band, others = int(pdf["band"].iat[0]), np.flatnonzero(~hub & ~starred.astype(bool))
        least = int(np.ceil(p.bins * (p.percent / 100 - p.margin)))
        partners: dict = {}
        for i in np.flatnonzero(hub & ~starred.astype(bool)):
            lo = np.searchsorted(n[others], -(-p.percent * n[i] // 100), "left")
            hi = np.searchsorted(n[others], 100 * n[i] // p.percent, "right")
            j = others[lo:hi]
            j = j[component[j] != component[i]]
            j = j[np.count_nonzero(bins[j] == bins[i], 1) >= least]
            j = j[(bands[j] == bands[i]).argmax(1) == band] if len(j) else j
            if len(j):
                partners[rep[i]] = rep[j].tolist()
                for r in partners[rep[i]]:
                    partners.setdefault(r, [])
        return pd.DataFrame([(*key, r, found) for r, found in partners.items()], columns=[*group, "rep", "partners"])

    schema = f"key long, block int, slice int, rep {kind}, partners array<{kind}>"
    found = materialise(met.repartition(tasks, *group).groupBy(*group).applyInPandas(pairs, schema), "minhash-more")
    texts = needed(docs, found.select(F.col("rep").alias("id"))).select(F.col("id").alias("rep"), "text")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, sets, out = WordHashes(), {}, []
        for rep, text in zip(pdf["rep"], pdf["text"], strict=True):  # an id may stand in several rows
            sets.setdefault(rep, []).append(shingles(text, p.width, hashes))
        for rep, partners in {r: x for r, x in zip(pdf["rep"], pdf["partners"], strict=True)}.items():
            out.extend((min(rep, r), max(rep, r)) for r in partners if any(linked(x, y, p.percent) for x in sets[rep] for y in sets[r]))
        return pd.DataFrame(out, columns=["a", "b"])

    joined = found.join(texts, "rep").repartition(max(1, -(-found.count() // p.rows_per_task)), *group)
    return joined.groupBy(*group).applyInPandas(check, f"a {kind}, b {kind}").distinct()


def verified(pairs: DataFrame, docs: DataFrame, p: MinHashParams) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    Pairs of one ``a`` are dealt in lots of ``lot``; each lot gets the text of
    ``a`` once, ahead of the others, so that a hub's text isn't copied for
    every pair and no hub fills a task.
    """
    kind = docs.schema["id"].dataType.simpleString()
    texts = needed(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
    lots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / p.lot).cast("int").alias("lots"))
    hubs = texts.join(lots.withColumnRenamed("a", "id"), "id").select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.col("id").alias("b"), F.lit(True).alias("first"), "text")
    dealt = pairs.join(lots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"), "b")
    others = dealt.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "lot", "b", F.lit(False).alias("first"), "text")
    met = hubs.unionByName(others).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("first").desc())

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, hub, known = WordHashes(), None, []
        for pdf in batches:
            good = []
            for a, first, text in zip(pdf["a"], pdf["first"], pdf["text"], strict=True):
                s = shingles(text, p.width, hashes)
                if first:  # the id may stand in several rows
                    hub, known = a, [*(known if a == hub else []), s]
                    good.append(False)
                else:
                    good.append(any(linked(k, s, p.percent) for k in known))
            yield pdf.loc[good, ["a", "b"]]

    return met.mapInPandas(check, f"a {kind}, b {kind}").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MinHashParams = MinHashParams()) -> DataFrame:
    """Link near-duplicate documents and name their components.

    Documents of equal shingle sets are one class, with its smallest id as
    representative.  A representative's set is hashed once into bins (optimal
    densification fills the empty ones) and bands of bins are bucket keys.  In
    a bucket the smallest member is the hub of a star: each pair with the hub
    is compared on full sets.  What a star can't see, a link between two
    members that aren't linked with the hub, is looked for afterwards, and only
    in buckets whose members are in several components: each member outside
    the bucket's largest component is the hub of one more star, over members of
    other components whose sizes and signatures allow the similarity.  Pairs
    inside a component can't change the result and are never made.

    Sets are of 64-bit hashes of shingles: two of the u shingles of a pair of
    documents are mistaken for one with a probability below u**2 / 2**65.

    Returns id, n_shingles, component_id (smallest id connected), kept.

    Null and empty texts, and texts without words, have no shingles and link
    with nothing, not even with each other.  A document without id joins its
    class but is no representative, unless the class has no id at all; then
    component_id is null.  Repeated rows have the same result.  An empty table
    gives an empty result.
    """
    p = params
    small_batches(docs.sparkSession)
    rows = narrow(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    signed = materialise(_sign(rows, p), "minhash-signed")
    classes = materialise(
        signed.filter("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bins").alias("bins")),
        "minhash-classes",
    )
    keyed = classes.filter("rep is not null").select("rep", "n", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialise(keyed.join(buckets, "key"), "minhash-members")
    star = materialise(members.filter("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "minhash-star")
    texts = rows.filter("id is not null")
    links = materialise(verified(star, texts, p), "minhash-links")
    labels = components(links)

    # Stars of what stayed apart.
    placed = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    across = placed.join(mixed, "key").join(classes.select("rep", "bins", "bands"), "rep").select("key", "band", "hub", "rep", "n", "component", "bins", "bands")
    found = materialise(_apart(across, texts, p), "minhash-links")
    if not found.isEmpty():
        labels = components(links.unionByName(found))
    named = classes.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("named"))
    out = signed.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("named"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
