"""Event-time trends, retrieval statistics, phase space and dormant tags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.scalar import decay, hours_between, sigmoid
from tagloom.params import Params


def trend_kernels(age: Column, weight: Column, window: float) -> dict[str, Column]:
    """Decayed level, difference of halves, and second difference of thirds, as aggregates.

    An event on a boundary belongs to the newer part.
    """
    half, third = F.lit(window / 2), F.lit(window / 3)
    level = F.sum(weight * decay(age, window / 2))
    velocity = F.sum(F.when(age <= half, weight).otherwise(-weight))
    jerk = F.sum(F.when(age <= third, weight).when(age <= 2 * third, -2 * weight).otherwise(weight))
    return {"level": level, "velocity": velocity, "jerk": jerk}


def discrete_p90(scores: DataFrame, score: str) -> DataFrame:
    """One row ``norm``: element least(floor(0.9 n), n - 1) of the sorted scores, 0.01 at least, 1 if none is positive.

    The element is reached by the counts of equal scores, so that the scores
    themselves are never sorted in one task.
    """
    counts = scores.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    summed = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy(score))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    wanted = F.least(F.floor(F.lit(0.9) * F.col("_all")), F.col("_all") - 1)
    at = summed.agg(F.min(F.when(F.col("_upto") > wanted, F.col(score))).alias("_p"), F.max(score).alias("_max"))
    return at.select(F.when(F.coalesce("_max", F.lit(0.0)) <= 0, F.lit(1.0)).otherwise(F.greatest("_p", F.lit(0.01))).alias("norm"))


def trends(events: DataFrame, tags: DataFrame, params: Params = Params()) -> DataFrame:
    """level, velocity, jerk, temperature and event_count of every tag of ``tags`` (tag_id).

    events: tag_id, occurred_at, weight (1 if absent).  Only events later than
    the window's start count.  A tag without any has temperature 0.
    """
    p = params
    age = hours_between(F.lit(p.now).cast("timestamp"), F.col("occurred_at"))
    weight = F.col("weight").cast("double") if "weight" in events.columns else F.lit(1.0)
    inside = events.filter(hours_between(F.lit(p.now).cast("timestamp"), F.col("occurred_at")) < p.window_hours)
    kernels = trend_kernels(age, weight, p.window_hours)
    grouped = inside.groupBy("tag_id").agg(*[k.alias(n) for n, k in kernels.items()], F.count(F.lit(1)).alias("event_count"))
    zero = {"level": 0.0, "velocity": 0.0, "jerk": 0.0, "event_count": 0}
    every = tags.select("tag_id").distinct().join(grouped, "tag_id", "left").fillna(zero)
    raw = p.weight_level * F.col("level") + p.weight_velocity * F.greatest(F.lit(0.0), F.col("velocity")) + p.weight_jerk * F.greatest(F.lit(0.0), F.col("jerk"))
    scored = every.withColumn("raw", raw)
    temperature = F.when(F.col("event_count") == 0, F.lit(0.0)).otherwise(sigmoid(F.col("raw") / F.col("norm")))
    return scored.crossJoin(F.broadcast(discrete_p90(scored, "raw"))).select("tag_id", "level", "velocity", "jerk", temperature.alias("temperature"), "event_count")


def tag_hits_per_hour(hits: DataFrame, params: Params = Params()) -> DataFrame:
    """Hits an hour of each tag over the window.  hits: retrieval_id, tag_id, occurred_at; a tag counts once a retrieval."""
    recent = hits.filter(hours_between(F.lit(params.now).cast("timestamp"), F.col("occurred_at")) < params.window_hours)
    once = recent.select("retrieval_id", "tag_id").distinct()
    return once.groupBy("tag_id").agg(F.count(F.lit(1)).alias("hits")).withColumn("per_hour", F.col("hits") / F.lit(params.window_hours))


def retrieval_frequency(hits: DataFrame, tags: DataFrame, params: Params = Params()) -> DataFrame:
    """Each tag's hits against the mean tag's: rate / (rate + base), 0 without hits."""
    rates = tag_hits_per_hour(hits, params)
    active = tags.select("tag_id").distinct()
    base = rates.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("_hits")).crossJoin(active.agg(F.count(F.lit(1)).alias("_tags")))
    base = base.select((F.col("_hits") / (F.greatest("_tags", F.lit(1)) * F.lit(params.window_hours))).alias("base_rate"))
    joined = active.join(rates, "tag_id", "left").fillna({"hits": 0, "per_hour": 0.0}).crossJoin(F.broadcast(base))
    value = F.when(F.col("hits") == 0, 0.0).when(F.col("base_rate") <= 0, 0.9).otherwise(sigmoid(F.log(F.col("per_hour") / F.col("base_rate"))))
    return joined.select("tag_id", "hits", "base_rate", value.alias("retrieval_freq"))


def quadrant(temperature: Column, frequency: Column, params: Params = Params()) -> Column:
    hot, used = temperature >= params.temperature_threshold, frequency >= params.frequency_threshold
    return F.when(hot & used, "active_deep_work").when(hot, "novel_exploration").when(used, "dormant_reactivation").otherwise("inactive")


def phase_space(trend: DataFrame, frequency: DataFrame, params: Params = Params()) -> DataFrame:
    """Quadrant of each tag, and its distance from the diagonal: (frequency - temperature) / sqrt(2)."""
    joined = trend.join(frequency, "tag_id", "left").fillna({"retrieval_freq": 0.0})
    t, f = F.col("temperature"), F.col("retrieval_freq")
    return joined.select("tag_id", t, f, quadrant(t, f, params).alias("quadrant"), ((f - t) / F.lit(math.sqrt(2))).alias("off_diagonal_distance"))


def quadrant_populations(phase: DataFrame) -> DataFrame:
    return phase.groupBy("quadrant").agg(F.count(F.lit(1)).alias("tags"))


def off_diagonal_tags(phase: DataFrame, least: float = 0.3) -> DataFrame:
    return phase.filter(F.abs("off_diagonal_distance") >= least)


def dormant_reactivations(phase: DataFrame, previous: DataFrame | None = None, params: Params = Params()) -> DataFrame:
    """Tags of the dormant quadrant that are retrieved far more than temperature suggests.

    z-score of the distance over all tags (three at least, spread not nil)
    above sigma, temperature below the ceiling.  A tag whose previous
    temperature (previous: tag_id, temperature) was below 0.2 counts 1.5 times.
    """
    p = params
    stats = phase.agg(F.avg("off_diagonal_distance").alias("_m"), F.stddev_samp("off_diagonal_distance").alias("_s"), F.count(F.lit(1)).alias("_n"))
    z = (F.col("off_diagonal_distance") - F.col("_m")) / F.col("_s")
    found = phase.crossJoin(F.broadcast(stats)).filter((F.col("_n") >= 3) & (F.col("_s") >= 1e-6)).withColumn("z", z)
    found = found.filter((F.col("quadrant") == "dormant_reactivation") & (F.col("z") > p.sigma) & (F.col("temperature") < p.inactive_ceiling))
    if previous is not None:
        found = found.join(previous.select("tag_id", F.col("temperature").alias("_before")), "tag_id", "left")
        found = found.withColumn("z", F.when(F.col("_before") < 0.2, F.col("z") * 1.5).otherwise(F.col("z")))
    return found.select("tag_id", "temperature", "retrieval_freq", F.col("z").alias("strength"))


def latest_snapshots(snapshots: DataFrame, keep: int = 1) -> DataFrame:
    """The last ``keep`` snapshots of each tag.  snapshots: tag_id, computed_at, temperature, ..."""
    w = Window.partitionBy("tag_id").orderBy(F.col("computed_at").desc())
    return snapshots.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def cross_domain_bridges(results: DataFrame, memory_tags: DataFrame, resonant: DataFrame, memories: int, recent: int = 10, since_hours: float = 1.0, params: Params = Params()) -> DataFrame:
    """(retrieval_id, tag_a, tag_b, strength): resonant tags that a recent retrieval found together and no memory has together.

    results: (retrieval_id, occurred_at, memory_id), of which the ``recent``
    latest retrievals within ``since_hours`` count.  resonant: pairs (a, b) of
    tags, a < b.  memories: number of active memories.  strength is the
    surprise -ln(share of a * share of b), ``surprise_threshold`` at least,
    where fewer than one memory with both is expected.
    """
    p = params
    inside = results.filter(hours_between(F.lit(p.now).cast("timestamp"), F.col("occurred_at")) <= since_hours)
    last = inside.groupBy("retrieval_id").agg(F.max("occurred_at").alias("at")).orderBy(F.col("at").desc(), F.col("retrieval_id").desc()).limit(recent)
    mt = memory_tags.select("memory_id", "tag_id").distinct()
    found = inside.join(F.broadcast(last.select("retrieval_id")), "retrieval_id").join(mt, "memory_id").select("retrieval_id", "tag_id").distinct()
    a, b = (found.select("retrieval_id", F.col("tag_id").alias(f"tag_{s}")) for s in "ab")
    pairs = resonant.select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b")).distinct()
    met = pairs.join(a, "tag_a").join(b, ["retrieval_id", "tag_b"])
    # Pairs of the few recent retrievals meet their memories; co-occurrence of all tags isn't computed.
    wanted = met.select("tag_a", "tag_b").distinct()
    both = wanted.join(mt.withColumnRenamed("tag_id", "tag_a"), "tag_a").join(mt.withColumnRenamed("tag_id", "tag_b"), ["memory_id", "tag_b"]).select("tag_a", "tag_b").distinct()
    share = mt.groupBy("tag_id").agg((F.count(F.lit(1)) / F.lit(float(memories or 1))).alias("share"))
    fa, fb = share.select(F.col("tag_id").alias("tag_a"), F.col("share").alias("_a")), share.select(F.col("tag_id").alias("tag_b"), F.col("share").alias("_b"))
    out = met.join(both, ["tag_a", "tag_b"], "left_anti").join(fa, "tag_a").join(fb, "tag_b")
    out = out.filter(F.col("_a") * F.col("_b") * memories < 1).withColumn("strength", -F.log(F.greatest(F.col("_a") * F.col("_b"), F.lit(1e-10))))
    return out.filter(F.col("strength") >= p.surprise_threshold).select("retrieval_id", "tag_a", "tag_b", "strength")


def sync_velocity(events: DataFrame, strength: Column, window_hours: float = 168.0, params: Params = Params()) -> DataFrame:
    """One row level, velocity, jerk, event_count of the synchronicity events (detected_at) within the window.

    strength: an event's weight as a column, such as ``effective_strength``.
    """
    age = hours_between(F.lit(params.now).cast("timestamp"), F.col("detected_at"))
    inside = events.filter(age < window_hours)
    kernels = trend_kernels(age, strength, window_hours)
    return inside.agg(*[F.round(F.coalesce(k, F.lit(0.0)), 3).alias(n) for n, k in kernels.items()], F.count(F.lit(1)).alias("event_count"))
