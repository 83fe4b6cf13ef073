"""Vectors: top-k inner product, neighbours, centroids, convergence, cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.vectors import dot, norm
from tagloom.operators.lineage import cut


def top_k(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None, overfetch: int = 3) -> DataFrame:
    """The k memories of largest inner product of each query.

    queries: query_id, embedding (a stated, small set).  vectors: memory_id,
    chunk_index, embedding.  k * overfetch chunks are fetched, then the
    threshold applies, then the best chunk of a memory counts.
    """
    q = queries.select("query_id", F.col("embedding").alias("_q"))
    scored = vectors.crossJoin(F.broadcast(q)).select("query_id", "memory_id", "chunk_index", dot(F.col("_q"), F.col("embedding")).alias("score"))
    # The best of each task go on alone: the window's group limit keeps k * overfetch rows a query and task.
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "memory_id", "chunk_index")
    fetched = scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k * overfetch)
    if threshold is not None:
        fetched = fetched.filter(F.col("score") >= threshold)
    best = fetched.groupBy("query_id", "memory_id").agg(F.max("score").alias("score"))
    v = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "memory_id")
    return best.withColumn("rank", F.row_number().over(v).cast("long")).filter(F.col("rank") <= k)


class _Best:
    """The ``keep`` best vectors of each query of a block so far; equal scores go by memory and chunk."""

    def __init__(self, queries: int, keep: int):
        self.keep, self.least = keep, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, q: np.ndarray, score: np.ndarray, memory: np.ndarray, chunk: np.ndarray) -> None:
        self.parts.append((q, score, memory, chunk))
        self.rows += len(q)
        if self.rows > max(500_000, 4 * self.keep * len(self.least)):
            self.compact()

    def compact(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        q, score, memory, chunk = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((chunk, memory, -score, q))
        firsts = np.searchsorted(q[order], q[order], "left")
        order = order[np.arange(len(order)) - firsts < self.keep]
        kept = q[order], score[order], memory[order], chunk[order]
        full = np.flatnonzero(np.bincount(kept[0], minlength=len(self.least)) == self.keep)
        last = np.searchsorted(kept[0], full, "right") - 1
        self.least[full] = kept[1][last]
        self.parts, self.rows = [kept], len(order)
        return kept


def _query_blocks(queries: DataFrame, size: int) -> Iterator[tuple[list, np.ndarray]]:
    ids, rows = [], []
    for r in queries.select("query_id", F.col("embedding").cast("array<double>").alias("_q")).filter("_q is not null").toLocalIterator():
        ids.append(r["query_id"])
        rows.append(np.array(r["_q"], float))
        if len(ids) == size:
            yield ids, np.stack(rows)
            ids, rows = [], []
    if ids:
        yield ids, np.stack(rows)


def _scan(queries: DataFrame, vectors: DataFrame, keep: int, block: int, probed: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, memory_id, chunk_index, score) of the ``keep`` best chunks of each query in each task.

    Each block of queries meets all vectors, which stay where they are.  With
    ``probed`` (queries -> queries by cells, whether the cell is searched)
    vectors have a cell, and a query is scored in its cells only.
    """
    spark, kind = vectors.sparkSession, queries.schema["query_id"].dataType
    empty = spark.createDataFrame([], f"query_id {kind.simpleString()}, memory_id long, chunk_index long, score double")
    rows = vectors.select(F.col("memory_id").cast("long").alias("memory_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("embedding").cast("array<double>").alias("embedding"), *(["cell"] if probed else [])).filter("embedding is not null")
    out = empty
    for ids, q in _query_blocks(queries, block):
        known = spark.sparkContext.broadcast((ids, q, probed(q) if probed else None))

        def search(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ids, q, cells = known.value
            best = _Best(len(ids), keep)
            for pdf in batches:
                for lo in range(0, len(pdf), 1000):
                    part = pdf.iloc[lo : lo + 1000]
                    x, memory, chunk = np.stack(part["embedding"].to_list()), part["memory_id"].to_numpy(), part["chunk_index"].to_numpy()
                    groups = [(np.arange(len(ids)), np.arange(len(x)))]
                    if cells is not None:
                        cell = part["cell"].to_numpy()
                        groups = [(np.flatnonzero(cells[:, c]), np.flatnonzero(cell == c)) for c in np.unique(cell)]
                    for mine, at in groups:
                        scores = np.round(q[mine] @ x[at].T, 9)  # sums of blocks differ in their last bits
                        i, j = np.nonzero(scores >= best.least[mine][:, None])
                        best.add(mine[i], scores[i, j], memory[at[j]], chunk[at[j]])
            i, score, memory, chunk = best.compact()
            yield pd.DataFrame({"query_id": [ids[n] for n in i], "memory_id": memory, "chunk_index": chunk, "score": score})

        out = out.unionByName(rows.mapInPandas(search, empty.schema))
    return out


def top_k_blocks(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None, overfetch: int = 3, block: int = 1000) -> DataFrame:
    """top_k for a query set that grows with the table, in blocks of queries; scores have nine digits."""
    return _ranked(_scan(queries, vectors, k * overfetch, block), k, threshold, overfetch)


def _ranked(scored: DataFrame, k: int, threshold: float | None, overfetch: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "memory_id", "chunk_index")
    fetched = scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k * overfetch)
    if threshold is not None:
        fetched = fetched.filter(F.col("score") >= threshold)
    best = fetched.groupBy("query_id", "memory_id").agg(F.max("score").alias("score"))
    v = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "memory_id")
    return best.withColumn("rank", F.row_number().over(v).cast("long")).filter(F.col("rank") <= k)


def retrieve_semantic(queries: DataFrame, vectors: DataFrame, k: int, tagged: DataFrame | None = None, find: Callable[..., DataFrame] = top_k) -> DataFrame:
    """top_k (or ``find``); with a table of tagged memories (memory_id), of the first 5 k those that are in it."""
    if tagged is None:
        return find(queries, vectors, k)
    wide = find(queries, vectors, 5 * k).join(tagged.select("memory_id").distinct(), "memory_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "memory_id")
    return wide.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def neighbours(left: DataFrame, right: DataFrame, threshold: float, k: int | None = None) -> DataFrame:
    """Pairs of left (id, v) and right (id, v) of other ids with a dot product of ``threshold`` or more, the k best of each left.

    The sides are sets that the caller has chosen (results of recent
    retrievals, centroids of tags), not whole collections.
    """
    pairs = left.select(F.col("id").alias("a"), F.col("v").alias("_a")).crossJoin(right.select(F.col("id").alias("b"), F.col("v").alias("_b"))).filter("a <> b")
    found = pairs.select("a", "b", dot(F.col("_a"), F.col("_b")).alias("similarity")).filter(F.col("similarity") >= threshold)
    if k is None:
        return found
    w = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    return found.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def mean_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Componentwise means, (key, position, mean)."""
    parts = df.select(key, F.posexplode(vector).alias("position", "x"))
    return parts.groupBy(key, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroids(df: DataFrame, key: str, vector: str = "embedding", normalise: bool = True) -> DataFrame:
    """(key, centroid): mean vector, of unit length if asked for."""
    whole = mean_vectors(df, key, vector).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "mean"))), lambda x: x["mean"]).alias("centroid"))
    if not normalise:
        return whole
    n = norm(F.col("centroid"))
    return whole.select(key, F.when(n > 0, F.transform("centroid", lambda x: x / n)).otherwise(F.col("centroid")).alias("centroid"))


def semantic_convergence(results: DataFrame, vectors: DataFrame, memory_tags: DataFrame, recent: int = 20, threshold: float = 0.7) -> DataFrame:
    """Pairs of memories of different recent retrievals that are similar and share no tag.

    results: retrieval_id, occurred_at, memory_id.  A memory belongs to the
    latest of the ``recent`` last retrievals that found it.
    """
    last = results.select("retrieval_id", "occurred_at").distinct().orderBy(F.col("occurred_at").desc(), F.col("retrieval_id").desc()).limit(recent)
    w = Window.partitionBy("memory_id").orderBy(F.col("occurred_at").desc(), F.col("retrieval_id").desc())
    firsts = results.join(F.broadcast(last.select("retrieval_id")), "retrieval_id").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("memory_id", "retrieval_id")
    placed = firsts.join(vectors, "memory_id").select("memory_id", "retrieval_id", "embedding")
    a, b = (placed.select(F.col("memory_id").alias(f"memory_{s}"), F.col("retrieval_id").alias(f"_r{s}"), F.col("embedding").alias(f"_v{s}")) for s in "ab")
    pairs = a.crossJoin(b).filter("memory_a < memory_b and _ra <> _rb").select("memory_a", "memory_b", dot(F.col("_va"), F.col("_vb")).alias("similarity")).filter(F.col("similarity") >= threshold)
    ta, tb = memory_tags.select(F.col("memory_id").alias("memory_a"), "tag_id"), memory_tags.select(F.col("memory_id").alias("memory_b"), "tag_id")
    shared = pairs.join(ta, "memory_a").join(tb, ["memory_b", "tag_id"]).select("memory_a", "memory_b").distinct()
    return pairs.join(shared, ["memory_a", "memory_b"], "left_anti")


def index_cells(rows: int) -> int:
    """Number of cells of an inverted index, 0 for a flat one: min(4 sqrt(n), n // 39), flat below 2."""
    cells = min(int(4 * rows**0.5), rows // 39)
    return cells if cells >= 2 else 0


def cell_search(queries: DataFrame, vectors: DataFrame, k: int, probe: int | None = None, seed: int = 1, recall: float = 0.95, measured: int = 256, block: int = 1000) -> DataFrame:
    """Approximate top_k: vectors in k-means cells, of which the ``probe`` nearest of each query are searched.

    Without ``probe`` it is the smallest number of cells that holds ``recall``
    of the true results of ``measured`` queries, found by brute force.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    cells = index_cells(n)
    if not cells:
        return top_k_blocks(queries, vectors, k, block=block)
    featured = vectors.withColumn("features", array_to_vector("embedding"))
    share = cells * 256 / n  # a bounded sample, as index builders take, from all over the table
    chosen = featured if share >= 1 else featured.filter(F.pmod(F.xxhash64("memory_id", "chunk_index"), F.lit(1_000_000)) < int(share * 1_000_000))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(chosen)
    centres = np.stack(model.clusterCenters())
    placed = cut(model.transform(featured).select("memory_id", "chunk_index", "embedding", F.col("prediction").alias("cell")))

    def places(q: np.ndarray) -> np.ndarray:
        order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
        return np.argsort(order, axis=1)  # of each cell, by query

    if probe is None:
        some = cut(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(measured))
        truth = top_k_blocks(some, vectors, k, block=block).join(placed.select("memory_id", "cell"), "memory_id").groupBy("query_id", "memory_id").agg(F.collect_set("cell").alias("cells")).collect()
        at = {i: row for ids, q in _query_blocks(some, block) for i, row in zip(ids, places(q), strict=True)}
        needed = sorted(int(min(at[r["query_id"]][r["cells"]])) + 1 for r in truth)
        probe = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1
    return _ranked(_scan(queries, placed, k * 3, block, lambda q: places(q) < probe), k, None, 3)


def centroid_fold(stored: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Centroid of each tag after memories were stored in order (tag_id, stored_at, memory_id, embedding).

    The first vector counts whole; then the centroid moves by alpha and is of
    unit length again after each step, so that the order matters.
    """
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        c = None
        for v in pdf.sort_values(["stored_at", "memory_id"])["embedding"]:
            v = np.asarray(v, float)
            v = v / (np.linalg.norm(v) or 1.0)
            c = v if c is None else alpha * v + (1 - alpha) * c
            c = c / (np.linalg.norm(c) or 1.0)
        return pd.DataFrame({"tag_id": [pdf["tag_id"].iat[0]], "centroid": [c.tolist()], "memories": [len(pdf)]})

    return stored.groupBy("tag_id").applyInPandas(one, "tag_id int, centroid array<double>, memories int")
