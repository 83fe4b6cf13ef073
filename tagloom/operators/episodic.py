"""Episodic edges between memories, their life, and the clusters that grow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.scalar import clamp, jaccard, temporal_proximity
from tagloom.operators.graph import connected_components
from tagloom.operators.lineage import cut
from tagloom.operators.overlap import jaccard_sums

CHANNELS = ["cooccurrence", "synchronicity", "semantic", "semiotic", "glyph"]
OVERLAP_WEIGHT = 0.5
PRESSURE = {"co_retrieval": 0.65, "bridge": 0.35}
#: How much the flow of a cluster adds to its pressure.
FLOW_WEIGHTS = {"outflow": 0.5, "inflow": 0.4}


def project_channels(pairs: DataFrame, memory_tags: DataFrame, tensor: DataFrame) -> DataFrame:
    """Mean of each channel of the tensor over the pairs of tags of two memories (memory_a, memory_b) that have an edge."""
    t = memory_tags.select("memory_id", "tag_id").distinct()
    spread = pairs.join(t.select(F.col("memory_id").alias("memory_a"), F.col("tag_id").alias("_x")), "memory_a").join(t.select(F.col("memory_id").alias("memory_b"), F.col("tag_id").alias("_y")), "memory_b").filter("_x <> _y")
    keyed = spread.select("memory_a", "memory_b", F.least("_x", "_y").alias("tag_a_id"), F.greatest("_x", "_y").alias("tag_b_id"))
    flat = tensor.select("tag_a_id", "tag_b_id", *[c for c in CHANNELS if c != "semiotic"], F.greatest("semiotic_forward", "semiotic_reverse").alias("semiotic"))
    return keyed.join(flat, ["tag_a_id", "tag_b_id"]).groupBy("memory_a", "memory_b").agg(*[F.avg(c).alias(c) for c in CHANNELS])


def score_edges(pairs: DataFrame, memory_tags: DataFrame, projected: DataFrame, created: DataFrame, least: float = 0.05) -> DataFrame:
    """Edges of similar memories (memory_a, memory_b, similarity): bridge = similarity * (1 - Jaccard of the tags), and what else holds them.

    Kept where similarity, projected mean and bridge are ``least`` together.
    """
    sets = memory_tags.groupBy("memory_id").agg(F.sort_array(F.collect_set("tag_id")).alias("tags"))
    a, b = (sets.join(created.select("memory_id", "created_at"), "memory_id", "left").select(F.col("memory_id").alias(f"memory_{s}"), F.col("tags").alias(f"_t{s}"), F.col("created_at").alias(f"_c{s}")) for s in "ab")
    joined = pairs.join(a, "memory_a", "left").join(b, "memory_b", "left").join(projected, ["memory_a", "memory_b"], "left")
    none = F.array().cast("array<long>")
    j = jaccard(F.coalesce(F.col("_ta").cast("array<long>"), none), F.coalesce(F.col("_tb").cast("array<long>"), none))
    mean = sum((F.coalesce(c, F.lit(0.0)) for c in CHANNELS[1:]), F.coalesce(CHANNELS[0], F.lit(0.0))) / len(CHANNELS)
    hours = F.abs(F.unix_micros(F.col("_ca").cast("timestamp")) - F.unix_micros(F.col("_cb").cast("timestamp"))) / F.lit(3.6e9)
    out = joined.select("memory_a", "memory_b", F.col("similarity").alias("semantic"), j.alias("jaccard"), mean.alias("projected"), (F.col("similarity") * (1 - j)).alias("bridge"), temporal_proximity(hours).alias("temporal"))
    return out.filter(F.col("semantic") + F.col("projected") + F.col("bridge") >= least)


def activate(edges: DataFrame, activated: DataFrame, alpha: float = 0.15) -> DataFrame:
    """Co-retrieval of activated edges by EMA, their status by the strength before: mature from 0.575, warm from 0.15.

    An edge that isn't there is not made.
    """
    hit = activated.select("memory_a", "memory_b").distinct().withColumn("_hit", F.lit(True))
    s = F.col("co_retrieval")
    status = F.when(s >= 0.575, "mature").when(s >= 0.15, "warm").otherwise(F.col("status"))
    joined = edges.join(hit, ["memory_a", "memory_b"], "left")
    return joined.withColumns({"status": F.when(F.col("_hit"), status).otherwise(F.col("status")), "co_retrieval": F.when(F.col("_hit"), alpha + (1 - alpha) * s).otherwise(s)}).drop("_hit")


def prune(edges: DataFrame, now, least: float = 0.05, decay_hours: float = 720.0, archive_hours: float = 2160.0, prune_nulls: bool = True) -> DataFrame:  # noqa: ANN001
    """Weak edges go; candidates not active for long decay, decaying ones are archived.

    With ``prune_nulls`` an edge that never was active counts as inactive, and
    passes through both steps at once.
    """
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_activated_at").cast("timestamp"))) / F.lit(3.6e9)
    old = {h: F.coalesce(age > h, F.lit(prune_nulls)) for h in (decay_hours, archive_hours)}
    kept = edges.filter(F.greatest("semantic", "projected", "bridge", "co_retrieval") >= least)
    kept = kept.withColumn("status", F.when((F.col("status") == "candidate") & old[decay_hours], "decaying").otherwise(F.col("status")))
    return kept.withColumn("status", F.when((F.col("status") == "decaying") & old[archive_hours], "archived").otherwise(F.col("status")))


def backfill_bridge(edges: DataFrame) -> DataFrame:
    """Bridge of edges that have none: max(semantic, co-retrieval) * (1 - Jaccard)."""
    return edges.withColumn("bridge", F.when(F.col("bridge") == 0, F.greatest("semantic", "co_retrieval") * (1 - F.col("jaccard"))).otherwise(F.col("bridge")))


def neighbours(edges: DataFrame, memory_id: int, top: int = 20) -> DataFrame:
    """Partners of a memory by the best of its edges' strengths, archived ones aside."""
    live = edges.filter("status <> 'archived'")
    both = live.filter(F.col("memory_a") == memory_id).select(F.col("memory_b").alias("memory_id"), *CH)
    both = both.unionByName(live.filter(F.col("memory_b") == memory_id).select(F.col("memory_a").alias("memory_id"), *CH))
    total = sum((F.col(c) for c in CH[1:]), F.col(CH[0]))
    return both.groupBy("memory_id").agg(F.max(total).alias("score")).orderBy(F.col("score").desc(), "memory_id").limit(top)


CH = ["semantic", "projected", "bridge", "co_retrieval"]


def canopy_clusters(edges: DataFrame) -> DataFrame:
    """Connected components of edges that were co-retrieved or bridge: (memory_id, cluster)."""
    strong = edges.filter("co_retrieval > 0 or bridge > 0").select(F.col("memory_a").alias("a"), F.col("memory_b").alias("b"))
    return connected_components(strong).select(F.col("node").alias("memory_id"), F.col("component").alias("cluster"))


def canopy_scores(edges: DataFrame, clusters: DataFrame, memory_tags: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """Pressure, inhibition and growth of each cluster.

    Pressure is the weighted mean of the positive strengths, over the channels
    that have any; ``flow`` (cluster, outflow, inflow) raises it.  Inhibition is half the mean Jaccard of the tags of all its
    pairs of memories; memories with the same tags are compared as one, and the
    number of all pairs comes from the cluster's size.
    """
    c = clusters.select(F.col("memory_id").alias("memory_a"), "cluster")
    inside = edges.join(c, "memory_a").join(clusters.select(F.col("memory_id").alias("memory_b"), F.col("cluster").alias("_o")), "memory_b").filter("cluster = _o")
    positive = {k: F.avg(F.when(F.col(k) > 0, F.col(k))) for k in PRESSURE}
    means = inside.groupBy("cluster").agg(*[positive[k].alias(f"mean_{k}") for k in PRESSURE], F.avg("semantic").alias("mean_semantic"), F.count(F.lit(1)).alias("edges"))
    weight = sum((F.when(F.col(f"mean_{k}").isNotNull(), w).otherwise(0.0) for k, w in PRESSURE.items()), F.lit(0.0))
    value = sum((w * F.coalesce(f"mean_{k}", F.lit(0.0)) for k, w in PRESSURE.items()), F.lit(0.0))
    t = memory_tags.select("memory_id", "tag_id").distinct().join(clusters, "memory_id").groupBy(F.col("cluster").alias("scope"), F.col("memory_id").alias("item")).agg(F.sort_array(F.collect_list(F.col("tag_id").cast("long"))).alias("tags"))
    overlap = jaccard_sums(t).groupBy(F.col("scope").alias("cluster")).agg((F.sum(F.col("members") * F.col("total")) / 2).alias("_sum"))
    members = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    mean_jaccard = F.coalesce("_sum", F.lit(0.0)) / (F.col("members") * (F.col("members") - 1) / 2)
    out = means.join(members, "cluster").filter("members > 1").join(overlap, "cluster", "left")
    boost = F.lit(1.0)
    if flow is not None:
        out = out.join(flow.select("cluster", *FLOW_WEIGHTS), "cluster", "left")
        for name, w in FLOW_WEIGHTS.items():
            boost *= 1 + w * F.greatest(F.coalesce(name, F.lit(0.0)), F.lit(0.0))
    out = out.withColumns({"pressure": F.when(weight > 0, value / weight).otherwise(0.0) * boost, "inhibition": OVERLAP_WEIGHT * mean_jaccard})
    growth = F.col("pressure") - F.col("inhibition")
    return out.select("cluster", "members", "edges", clamp(F.col("pressure")).alias("pressure"), clamp(F.col("inhibition")).alias("inhibition"), growth.alias("growth_potential"), F.greatest(F.lit(0.0), growth).alias("canopy_growth"))


def canopy_merge(edges: DataFrame, memory_tags: DataFrame, depth: int = 2) -> DataFrame:
    """Clusters level by level: of level d those that grow beyond 0.5 d (0 at level 0) feed the next."""
    out, live = None, edges
    for level in range(depth + 1):
        clusters = canopy_clusters(live)
        scores = canopy_scores(live, clusters, memory_tags).withColumn("depth", F.lit(level))
        out = scores if out is None else out.unionByName(scores)
        grown = scores.filter(F.col("growth_potential") > OVERLAP_WEIGHT * level).select("cluster")
        members = clusters.join(grown, "cluster", "left_semi").select("memory_id")
        live = cut(live.join(members.withColumnRenamed("memory_id", "memory_a"), "memory_a", "left_semi").join(members.withColumnRenamed("memory_id", "memory_b"), "memory_b", "left_semi"))
    return out


def peaks(observations: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Observations rolled up: the largest value of each column, and how many there are."""
    return observations.groupBy(key).agg(*[F.max(c).alias(c) for c in columns], F.count(F.lit(1)).alias("evidence_count"))


def meta_patterns(tensor_scores: DataFrame, event_tags: DataFrame, active_tags: DataFrame, least: float = 0.05, ratio: float = 3.0, min_events: int = 3) -> DataFrame:
    """Components of the tensor (a, b, score > least) in which events gather more than their share of tags explains.

    event_tags: (event_id, tag_id); an event votes for the component of most of
    its tags, the smallest of equals.
    """
    parts = connected_components(tensor_scores.filter(F.col("score") > least).select("a", "b"))
    votes = event_tags.join(parts.select(F.col("node").alias("tag_id"), "component"), "tag_id").groupBy("event_id", "component").agg(F.count(F.lit(1)).alias("_v"))
    best = votes.groupBy("event_id").agg(F.max(F.struct("_v", (-F.col("component")).alias("_c"))).alias("_b")).select("event_id", (-F.col("_b._c")).alias("component"))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("tags"))
    counted = best.groupBy("component").agg(F.count(F.lit(1)).alias("events"))
    totals = event_tags.agg(F.countDistinct("event_id").alias("_n")).crossJoin(active_tags.agg(F.countDistinct("tag_id").alias("_t")))
    value = F.col("events") / (F.col("_n") * F.col("tags") / F.col("_t"))
    return counted.join(sizes, "component").crossJoin(F.broadcast(totals)).select("component", "tags", "events", value.alias("base_rate_ratio")).filter((F.col("events") >= min_events) & (F.col("base_rate_ratio") >= ratio))
