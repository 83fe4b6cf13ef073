"""Sums of Jaccard similarities over all pairs of sets, without a row for each pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.lineage import cut

#: Sides of the tiles that a task compares at once, and common tags of a tile from which a product of matrices is cheaper than their pairs.
TILE, DENSE = 2048, 40_000


def _by_tag(tag: np.ndarray, row: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their tag, and how many each of the known tags has, and where they begin."""
    at = np.searchsorted(known, tag)
    order = np.argsort(at, kind="stable")
    n = np.bincount(at, minlength=len(known))
    return row[order], n, np.cumsum(n) - n


def common(tags_a: np.ndarray, rows_a: np.ndarray, n_a: int, tags_b: np.ndarray, rows_b: np.ndarray, n_b: int) -> np.ndarray:
    """Number of common tags of each of n_a and each of n_b sets, given as (tag, row) of their members.

    Tags of many sets count by a product of 0/1 matrices, the others by their pairs of sets.
    """
    known = np.intersect1d(tags_a, tags_b)
    (rows_a, count_a, from_a), (rows_b, count_b, from_b) = (_by_tag(t[k], r[k], known) for t, r in ((tags_a, rows_a), (tags_b, rows_b)) for k in [np.isin(t, known)])
    out = np.zeros((n_a, n_b), np.float32)
    pairs = count_a * count_b
    many = np.flatnonzero(pairs > DENSE)
    for lo in range(0, len(many), 1024):
        some = many[lo : lo + 1024]
        x, y = np.zeros((n_a, len(some)), np.float32), np.zeros((n_b, len(some)), np.float32)
        for i, k in enumerate(some):
            x[rows_a[from_a[k] : from_a[k] + count_a[k]], i] = 1
            y[rows_b[from_b[k] : from_b[k] + count_b[k]], i] = 1
        out += x @ y.T
    few = np.flatnonzero(pairs <= DENSE)
    flat, ends = out.reshape(-1), np.cumsum(pairs[few])
    done = 0
    while done < len(few):  # so many tags at once that their pairs stay bounded
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 4_000_000, "right")))
        k = few[done:to]
        tag = np.repeat(np.arange(len(k)), pairs[k])
        nth = np.arange(len(tag)) - np.repeat(np.cumsum(pairs[k]) - pairs[k], pairs[k])
        i, j = np.divmod(nth, count_b[k][tag])
        flat += np.bincount(rows_a[from_a[k][tag] + i].astype(np.int64) * n_b + rows_b[from_b[k][tag] + j], minlength=len(flat)).astype(np.float32)
        done = to
    return out


class _Sets:
    """Sets of a task: their tags one after another, where each begins, their sizes and weights."""

    def __init__(self, table: pa.Table):
        lists = table["tags"].combine_chunks()
        self.values, self.offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        self.sizes, self.weights = np.diff(self.offsets), table["members"].to_numpy().astype(float)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[rows]
        first = np.cumsum(n) - n
        at = np.repeat(self.offsets[rows] - first, n) + np.arange(n.sum())
        return self.values[at], np.repeat(np.arange(len(rows)), n)

    def add(self, out: np.ndarray, left: np.ndarray, right: np.ndarray, both: bool) -> None:
        """Weighted Jaccard of the left rows with the right ones, and with ``both`` the other way round."""
        for a in range(0, len(left), TILE):
            x = left[a : a + TILE]
            tags_x = self.of(x)
            for b in range(0, len(right), TILE):
                y = right[b : b + TILE]
                c = common(*tags_x, len(x), *self.of(y), len(y)).astype(float)
                c /= (self.sizes[x][:, None] + self.sizes[y][None, :]) - c
                out[x] += c @ self.weights[y]
                if both:
                    out[y] += c.T @ self.weights[x]


def jaccard_sums(sets: DataFrame, least: int = 1024, most: int = 16_384) -> DataFrame:
    """(scope, tags, members, total): of each class of equal sets of a scope, how many there are, and the sum of one's Jaccard with all others of the scope.

    sets: (scope, item, tags), arrays of distinct longs in order.  Equal sets
    are compared once.  The classes of a scope are dealt into blocks of
    ``least`` to ``most``, and a task compares two blocks in tiles: its memory
    is bounded, and no pair becomes a row.  Small scopes share tasks.
    """
    classes = cut(sets.filter(F.size("tags") > 0).groupBy("scope", "tags").agg(F.count(F.lit(1)).alias("members")))
    many = classes.groupBy("scope").agg(F.count(F.lit(1)).alias("_m")).withColumn("_g", F.ceil(F.col("_m") / F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("_m") / 24)))).cast("int"))
    packs = max(1, (classes.count() + most - 1) // most)
    dealt = classes.join(many, "scope").withColumn("_b", F.pmod(F.xxhash64("tags"), F.col("_g")).cast("int"))
    met = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    keyed = met.select(
        "scope", "tags", "members", "_b",
        F.when(F.col("_g") == 1, F.pmod(F.xxhash64("scope"), F.lit(packs))).otherwise(-1).alias("_pack"), F.when(F.col("_g") > 1, F.col("scope")).alias("_own"),
        F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"),
    )

    def compare(table: pa.Table) -> pa.Table:
        held, out = _Sets(table), np.zeros(table.num_rows)
        scope, block = table["scope"].combine_chunks().dictionary_encode().indices.to_numpy(), table["_b"].to_numpy()
        order = np.argsort(scope, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(scope[order])) + 1):
            lo, hi = block[rows].min(), block[rows].max()
            if lo == hi and table["_lo"][0] == table["_hi"][0]:
                held.add(out, rows, rows, False)
            elif lo < hi:
                held.add(out, rows[block[rows] == lo], rows[block[rows] == hi], True)
        tags = pa.ListArray.from_arrays(pa.array(held.offsets), pa.array(held.values))
        return pa.table({"scope": table["scope"], "tags": tags, "members": table["members"], "total": out})

    kind = dict(sets.dtypes)["scope"]
    parts = keyed.groupBy("_pack", "_own", "_lo", "_hi").applyInArrow(compare, f"scope {kind}, tags array<long>, members long, total double")
    return parts.groupBy("scope", "tags", "members").agg((F.sum("total") - 1).alias("total"))  # less a set with itself
