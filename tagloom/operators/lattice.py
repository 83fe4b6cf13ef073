"""The prime lattice: slots of an angle on many primes, and resonances by joins on slots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.scalar import angular_distance, hash_angle, slot
from tagloom.params import Params


def first_primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found if p * p <= k):
            found.append(k)
        k += 1
    return found


def proximity_threshold(primes: list[int], least: int) -> float:
    """The angle at which two positions share ``least`` slots by expectation: sum of max(0, 1 - d p / 2 pi), by bisection."""
    low, high = 0.0, math.pi
    for _ in range(60):
        middle = (low + high) / 2
        if sum(max(0.0, 1 - middle * p / (2 * math.pi)) for p in primes) > least:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def place_names(tags: DataFrame, name: str = "name") -> DataFrame:
    """An angle for each name, from its hash."""
    return tags.withColumn("angle", hash_angle(F.col(name)))


def slots(positions: DataFrame, primes: list[int], id_col: str = "id") -> DataFrame:
    """(id, prime, slot) rows of positions (id, angle)."""
    spread = positions.select(F.col(id_col).alias("id"), "angle", F.explode(F.array(*[F.lit(p) for p in primes])).alias("prime"))
    return spread.select("id", "prime", slot(F.col("angle"), F.col("prime")).alias("slot"))


def slot_populations(slot_rows: DataFrame) -> DataFrame:
    return slot_rows.groupBy("prime", "slot").agg(F.count(F.lit(1)).alias("population"))


def resonances(slot_rows: DataFrame, least: int, keep_primes: bool = False) -> DataFrame:
    """Pairs a < b that share ``least`` slots at least: number, strength (sum of ln p) and chance exp(-strength).

    An equi-join on (prime, slot).  A prime p spreads positions over p slots,
    so the pairs come from the small primes: the join is as large as a share
    sum(1 / p) of all pairs.  Positions are tags or events, not documents.
    """
    left, right = slot_rows.select(F.col("id").alias("a"), "prime", "slot"), slot_rows.select(F.col("id").alias("b"), "prime", "slot")
    aggs = [F.count(F.lit(1)).alias("shared_count"), F.sum(F.log(F.col("prime").cast("double"))).alias("strength")]
    if keep_primes:
        aggs.append(F.sort_array(F.collect_list("prime")).alias("shared_primes"))
    found = left.join(right, ["prime", "slot"]).filter("a < b").groupBy("a", "b").agg(*aggs)
    return found.filter(F.col("shared_count") >= least).withColumn("chance", F.exp(-F.col("strength")))


def near(found: DataFrame, positions: DataFrame, distance: float, id_col: str = "id") -> DataFrame:
    """Resonances whose positions are within an angular distance."""
    pa, pb = positions.select(F.col(id_col).alias("a"), F.col("angle").alias("_pa")), positions.select(F.col(id_col).alias("b"), F.col("angle").alias("_pb"))
    return found.join(pa, "a").join(pb, "b").filter(angular_distance(F.col("_pa"), F.col("_pb")) <= distance).drop("_pa", "_pb")


def capped(found: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` strongest resonances of each position, ties by id, seen from either end."""
    ends = found.select(F.col("a").alias("_e"), "a", "b", "strength").unionByName(found.select(F.col("b").alias("_e"), "a", "b", "strength"))
    w = Window.partitionBy("_e").orderBy(F.col("strength").desc(), "a", "b")
    best = ends.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).select("a", "b").distinct()
    return found.join(best, ["a", "b"], "left_semi")


def persist_resonances(positions: DataFrame, params: Params = Params(), glyph: bool = False, id_col: str = "id") -> DataFrame:
    """Resonances within the proximity threshold, the strongest n_primes // 2 of each position."""
    n, least = (params.glyph_primes, params.glyph_min_shared) if glyph else (params.lattice_primes, params.lattice_min_shared)
    primes = first_primes(n)
    found = near(resonances(slots(positions, primes, id_col), least), positions, proximity_threshold(primes, least), id_col)
    return capped(found, n // 2)


def keep_maximum(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Upsert that keeps the larger value of each column."""
    return old.select(*keys, *columns).unionByName(new.select(*keys, *columns)).groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


def parallelness(found: DataFrame, positions: DataFrame, id_col: str = "id") -> DataFrame:
    """cos of the difference of the angles of each pair (a, b)."""
    pa, pb = positions.select(F.col(id_col).alias("a"), F.col("angle").alias("_pa")), positions.select(F.col(id_col).alias("b"), F.col("angle").alias("_pb"))
    return found.join(pa, "a").join(pb, "b").select("a", "b", F.cos(F.col("_pa") - F.col("_pb")).alias("parallelness"))


def circular_mean(angle: Column) -> Column:
    return F.pmod(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle))), F.lit(2 * math.pi))


def void_profile(positions: DataFrame, event_tags: DataFrame, top: int = 10, id_col: str = "id") -> DataFrame:
    """Tags around the circular mean: of the nearest max(1, int(0.3 n)) positions, the ``top`` commonest tags.

    Nothing for fewer than three positions.  event_tags: (id, tag_id).
    """
    centre = positions.agg(circular_mean(F.col("angle")).alias("_c"), F.count(F.lit(1)).alias("_n")).filter("_n >= 3")
    at = positions.crossJoin(F.broadcast(centre)).withColumn("_d", angular_distance(F.col("angle"), F.col("_c")))
    rank = F.row_number().over(Window.orderBy("_d", id_col))
    near_by = at.withColumn("_rn", rank).filter(F.col("_rn") <= F.greatest(F.lit(1), F.floor(0.3 * F.col("_n"))))
    found = near_by.select(F.col(id_col).alias("id"), F.col("_c").alias("void_angle")).join(event_tags, "id")
    return found.groupBy("tag_id", "void_angle").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), "tag_id").limit(top)


def ramsey_depth(slot_rows: DataFrame, positions: DataFrame, params: Params = Params(), id_col: str = "id") -> DataFrame:
    """Radius of each position (id, radius) corrected by how crowded its slots are.

    Times 0.5 + 1 / (1 + exp(mean ln(population / expected))), max_radius at most.
    """
    total = positions.agg(F.count(F.lit(1)).alias("_n"))
    crowd = slot_rows.join(slot_populations(slot_rows), ["prime", "slot"]).crossJoin(F.broadcast(total))
    mean = crowd.groupBy("id").agg(F.avg(F.log(F.col("population") * F.col("prime") / F.col("_n"))).alias("_m"))
    factor = 0.5 + 1 / (1 + F.exp(F.col("_m")))
    return positions.join(mean.withColumnRenamed("id", id_col), id_col).select(id_col, F.least(F.lit(params.max_radius), F.col("radius") * factor).alias("radius"))


def strongest_resonances(found: DataFrame, names: DataFrame, limit: int = 50) -> DataFrame:
    """The strongest resonances with the names of both ends.  names: (id, name)."""
    na, nb = names.select(F.col("id").alias("a"), F.col("name").alias("name_a")), names.select(F.col("id").alias("b"), F.col("name").alias("name_b"))
    return found.join(na, "a").join(nb, "b").orderBy(F.col("strength").desc(), "a", "b").limit(limit)
