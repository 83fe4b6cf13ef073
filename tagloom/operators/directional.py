"""Directional flow: how diverse the queries are that reach a result, and the results that a query reaches."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.scalar import jaccard, key_of

HISTORY = 50


def mean_jaccard(sets: DataFrame, key: str, id_col: str, items: str) -> DataFrame:
    """Mean Jaccard of all pairs of a key's sets, 0 for one set; pairs of empty sets count as 0.

    Keys hold a bounded history (see ``last_sets``).
    """
    a, b = (sets.select(key, F.col(id_col).alias(f"_i{s}"), F.col(items).alias(f"_s{s}")) for s in "ab")
    pairs = a.join(b, key).filter("_ia < _ib").groupBy(key).agg(F.avg(jaccard(F.col("_sa"), F.col("_sb"))).alias("mean_jaccard"))
    return sets.select(key).distinct().join(pairs, key, "left").select(key, F.coalesce("mean_jaccard", F.lit(0.0)).alias("mean_jaccard"))


def last_sets(observations: DataFrame, key: str, at: str, id_col: str, keep: int = HISTORY + 1) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(id_col).desc())
    return observations.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def pair_diversity(sets: DataFrame, key: str, id_col: str, items: str) -> DataFrame:
    """1 - mean Jaccard, times 1 - 1 / sqrt(m + 1) for m distinct sets."""
    distinct = sets.groupBy(key).agg(F.countDistinct(key_of(F.col(items))).alias("contexts"))
    j = mean_jaccard(sets, key, id_col, items).join(distinct, key)
    correction = 1 - 1 / F.sqrt(F.col("contexts") + 1)
    return j.select(key, "contexts", (1 - F.col("mean_jaccard")).alias("diversity"), ((1 - F.col("mean_jaccard")) * correction).alias("corrected"))


def outflow_reach(sets: DataFrame, key: str, id_col: str, items: str) -> DataFrame:
    """0.6 * diversity + 0.4 * reach, corrected for few clusters; reach is the mean distance of pairs with any item, 0 for one set."""
    a, b = (sets.select(key, F.col(id_col).alias(f"_i{s}"), F.col(items).alias(f"_s{s}")) for s in "ab")
    pairs = a.join(b, key).filter("_ia < _ib")
    some = F.size(F.array_union("_sa", "_sb")) > 0
    reach = pairs.groupBy(key).agg(F.avg(F.when(some, 1 - jaccard(F.col("_sa"), F.col("_sb"))).otherwise(0.0)).alias("reach"))
    d = pair_diversity(sets, key, id_col, items).join(reach, key, "left").fillna({"reach": 0.0})
    correction = 1 - 1 / F.sqrt(F.col("contexts") + 1)
    return d.select(key, "contexts", "diversity", "reach", ((0.6 * F.col("diversity") + 0.4 * F.col("reach")) * correction).alias("strength"))


def inflow_fold(observations: DataFrame, alpha: float = 0.25) -> DataFrame:
    """Strength of each block after each of its observations (block_key, observed_at, retrieval_id, query_tags, max_activations).

    Ordered by time: diversity over the last 50 sets of query tags and the new
    one, frequency against max_activations, and an EMA over observations.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        history: list[frozenset] = []
        contexts: set[frozenset] = set()
        strength, out = None, []
        for n, row in enumerate(pdf.sort_values(["observed_at", "retrieval_id"]).itertuples(index=False), 1):
            tags = frozenset(row.query_tags)
            sets = [*history[-HISTORY:], tags]
            contexts.add(tags)
            pairs = [len(x & y) / len(x | y) if x | y else 0.0 for x, y in combinations(sets, 2)]
            diversity = 1 - (sum(pairs) / len(pairs) if pairs else 0.0)
            frequency = math.log1p(n) / math.log1p(max(n, int(row.max_activations)))
            raw = (0.7 * diversity + 0.3 * frequency) * (1 - 1 / math.sqrt(len(contexts) + 1))
            strength = raw if strength is None else alpha * raw + (1 - alpha) * strength
            history.append(tags)
            out.append((row.block_key, row.retrieval_id, diversity, len(contexts), n, strength))
        return pd.DataFrame(out, columns=["block_key", "retrieval_id", "diversity", "contexts", "activations", "strength"])

    return observations.groupBy("block_key").applyInPandas(one, "block_key string, retrieval_id long, diversity double, contexts int, activations int, strength double")


def ema_fold(rows: DataFrame, key: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """Exponential mean of each key's values in order, from the first value: a weighted sum in closed form.

    The n-th of N values weighs alpha (1 - alpha)^(N - n), the first (1 - alpha)^(N - 1).
    """
    w = Window.partitionBy(key).orderBy(*order)
    numbered = rows.withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    weight = F.pow(F.lit(1 - alpha), F.col("_n") - F.col("_i")) * F.when(F.col("_i") == 1, 1.0).otherwise(alpha)
    return numbered.groupBy(key).agg(F.sum(weight * F.col(value)).alias("ema"), F.count(F.lit(1)).alias("signals"))


def burn_in_threshold(thresholds: DataFrame, now, burn_in_hours: float = 168.0) -> DataFrame:  # noqa: ANN001
    """Current threshold of each metric (current_value, baseline_value, burn_in_until): the larger, times 1.5, during burn-in."""
    inside = F.col("burn_in_until").cast("timestamp") > F.lit(now).cast("timestamp")
    value = F.when(inside, F.greatest("current_value", "baseline_value") * 1.5).otherwise(F.col("current_value"))
    return thresholds.withColumn("threshold", value)
