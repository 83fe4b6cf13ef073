"""Pairs of tags: co-occurrence, PMI, conditional probabilities, PPMI, blocks and bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.scalar import jaccard


def item_pairs(baskets: DataFrame, basket: str, item: str = "tag_id") -> DataFrame:
    """Number of baskets that hold both items, for each pair a < b.  A basket's items are distinct and bounded by its size."""
    once = baskets.select(basket, item).distinct()
    left, right = once.select(basket, F.col(item).alias("tag_a_id")), once.select(basket, F.col(item).alias("tag_b_id"))
    return left.join(right, basket).filter("tag_a_id < tag_b_id").groupBy("tag_a_id", "tag_b_id").agg(F.count(F.lit(1)).alias("cnt"))


def item_counts(baskets: DataFrame, basket: str, item: str = "tag_id") -> DataFrame:
    return baskets.select(basket, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n"))


def _with_counts(pairs: DataFrame, counts: DataFrame, item: str = "tag_id") -> DataFrame:
    a, b = counts.select(F.col(item).alias("tag_a_id"), F.col("n").alias("n_a")), counts.select(F.col(item).alias("tag_b_id"), F.col("n").alias("n_b"))
    return pairs.join(a, "tag_a_id").join(b, "tag_b_id")


def pmi(baskets: DataFrame, basket: str, min_count: int = 2, gate: DataFrame | None = None) -> DataFrame:
    """Positive pointwise mutual information of the pairs that are in ``min_count`` baskets at least.

    gate: (tag_a_id, tag_b_id) of the pairs that may be.
    """
    pairs = item_pairs(baskets, basket).filter(F.col("cnt") >= min_count)
    if gate is not None:
        pairs = pairs.join(gate.select("tag_a_id", "tag_b_id"), ["tag_a_id", "tag_b_id"], "left_semi")
    total = baskets.agg(F.countDistinct(basket).alias("total")).filter("total >= 2")
    joined = _with_counts(pairs, item_counts(baskets, basket)).crossJoin(F.broadcast(total))
    value = F.log(F.col("cnt") * F.col("total") / (F.col("n_a") * F.col("n_b")))
    return joined.select("tag_a_id", "tag_b_id", "cnt", value.alias("pmi")).filter("pmi > 0")


def combined_cooccurrence(memory: DataFrame, retrieval: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """Sum of the PMI over memories and over retrievals, for pairs in either."""
    m = pmi(memory, "memory_id", gate=gate).select("tag_a_id", "tag_b_id", F.col("pmi").alias("of_memories"))
    r = pmi(retrieval, "retrieval_id", gate=gate).select("tag_a_id", "tag_b_id", F.col("pmi").alias("of_retrievals"))
    both = m.join(r, ["tag_a_id", "tag_b_id"], "full_outer")
    return both.select("tag_a_id", "tag_b_id", (F.coalesce("of_memories", F.lit(0.0)) + F.coalesce("of_retrievals", F.lit(0.0))).alias("cooccurrence"))


def bridged_pmi(pairs: DataFrame, bridges: DataFrame, bonus: float = 1.0, least: float = 0.1) -> DataFrame:
    """Pairs whose PMI with the bonus of their bridge (tag_a_id, tag_b_id, bridge) is ``least`` or more."""
    joined = pairs.join(bridges, ["tag_a_id", "tag_b_id"], "left")
    return joined.withColumn("weight", F.col("pmi") + bonus * F.coalesce("bridge", F.lit(0.0))).filter(F.col("weight") >= least)


def conditional(memory: DataFrame, retrieval: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """Directed strengths: forward = P(b | a), reverse = P(a | b), over memories plus over retrievals (two at least)."""

    def shares(baskets: DataFrame, basket: str, least: int, name: str) -> DataFrame:
        pairs = _with_counts(item_pairs(baskets, basket).filter(F.col("cnt") >= least), item_counts(baskets, basket))
        return pairs.select("tag_a_id", "tag_b_id", (F.col("cnt") / F.col("n_a")).alias(f"f_{name}"), (F.col("cnt") / F.col("n_b")).alias(f"r_{name}"))

    both = shares(memory, "memory_id", 1, "m").join(shares(retrieval, "retrieval_id", 2, "r"), ["tag_a_id", "tag_b_id"], "full_outer").fillna(0.0)
    if gate is not None:
        both = both.join(gate.select("tag_a_id", "tag_b_id"), ["tag_a_id", "tag_b_id"], "left_semi")
    return both.select("tag_a_id", "tag_b_id", (F.col("f_m") + F.col("f_r")).alias("semiotic_forward"), (F.col("r_m") + F.col("r_r")).alias("semiotic_reverse"))


def ppmi(baskets: DataFrame, basket: str, scope: str) -> DataFrame:
    """Expected count and PPMI of every pair of a scope, without a least count."""
    total = baskets.agg(F.greatest(F.countDistinct(basket), F.lit(1)).alias("total"))
    joined = _with_counts(item_pairs(baskets, basket), item_counts(baskets, basket)).crossJoin(F.broadcast(total))
    expected = F.col("n_a") * F.col("n_b") / F.col("total")
    return joined.select("tag_a_id", "tag_b_id", F.lit(scope).alias("scope"), "cnt", expected.alias("expected"), F.greatest(F.lit(0.0), F.log(F.col("cnt") / expected)).alias("ppmi"))


def strongest_scope(edges: DataFrame) -> DataFrame:
    return edges.groupBy("tag_a_id", "tag_b_id").agg(F.max("ppmi").alias("strength"))


def blocks(edges: DataFrame, memory_tags: DataFrame) -> DataFrame:
    """Density of each memory's set of tags: mean strength of its pairs that have an edge, and how many have."""
    once = memory_tags.select("memory_id", "tag_id").distinct()
    pairs = once.select("memory_id", F.col("tag_id").alias("tag_a_id")).join(once.select("memory_id", F.col("tag_id").alias("tag_b_id")), "memory_id").filter("tag_a_id < tag_b_id")
    present = pairs.join(edges, ["tag_a_id", "tag_b_id"])
    return present.groupBy("memory_id").agg(F.avg("strength").alias("density"), F.count(F.lit(1)).alias("pairs"))


def block_membership(edges: DataFrame, memory_tags: DataFrame) -> DataFrame:
    """Membership of each tag in its memory's block: the sum of its strengths over the number of other tags."""
    once = memory_tags.select("memory_id", "tag_id").distinct()
    sizes = once.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    directed = edges.select(F.col("tag_a_id").alias("tag_id"), F.col("tag_b_id").alias("other"), "strength").unionByName(edges.select(F.col("tag_b_id").alias("tag_id"), F.col("tag_a_id").alias("other"), "strength"))
    sums = once.join(once.withColumnRenamed("tag_id", "other"), "memory_id").join(directed, ["tag_id", "other"]).groupBy("memory_id", "tag_id").agg(F.sum("strength").alias("s"))
    return sums.join(sizes, "memory_id").select("memory_id", "tag_id", (F.col("s") / (F.col("n") - 1)).alias("membership"))


def bridge_scores(members: DataFrame, activations: DataFrame, frequency: DataFrame, top: int = 5) -> DataFrame:
    """Strength of the bridge between blocks (members: block_id, tag_id), the ``top`` best of each block.

    Connection (half Jaccard, half share of common retrievals), distance,
    rarity of the tags and a penalty for blocks with more links than the upper
    median.  activations: block_id, retrieval_id.  frequency: tag_id, freq.
    Blocks meet by a common tag; the pairs of a tag are bounded by the number
    of blocks.
    """
    sets = members.groupBy("block_id").agg(F.sort_array(F.collect_set("tag_id")).alias("tags"))
    shared = members.select("tag_id", F.col("block_id").alias("l")).join(members.select("tag_id", F.col("block_id").alias("r")), "tag_id").filter("l < r").select("l", "r").distinct()
    act = activations.select("block_id", "retrieval_id").distinct()
    runs = act.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    common = act.withColumnRenamed("block_id", "l").join(act.withColumnRenamed("block_id", "r"), "retrieval_id").filter("l < r").groupBy("l", "r").agg(F.count(F.lit(1)).alias("c"))
    rarity = members.join(frequency, "tag_id").groupBy("block_id").agg(F.avg("freq").alias("avg_freq"))
    degree = shared.select(F.col("l").alias("block_id")).unionByName(shared.select(F.col("r").alias("block_id"))).groupBy("block_id").agg(F.count(F.lit(1)).alias("degree"))
    median = upper_median(degree, "degree").select(F.col("median"))

    def of(side: str) -> DataFrame:
        joined = sets.join(runs, "block_id", "left").join(rarity, "block_id", "left").join(degree, "block_id", "left").fillna(0)
        return joined.select(F.col("block_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("tags", "n", "avg_freq", "degree")])

    joined = shared.join(of("l"), "l").join(of("r"), "r").join(common, ["l", "r"], "left").fillna({"c": 0}).crossJoin(F.broadcast(median))
    j = jaccard(F.col("tags_l"), F.col("tags_r"))
    share = F.when(F.least("n_l", "n_r") > 0, F.col("c") / F.least("n_l", "n_r")).otherwise(0.0)
    excess = F.greatest(F.lit(0), F.greatest("degree_l", "degree_r") - F.col("median"))
    score = (0.5 * j + 0.5 * share) * (1 - j) * (1 / (1 + 10 * (F.col("avg_freq_l") + F.col("avg_freq_r")) / 2)) * (1 / (1 + 0.5 * excess))
    scored = joined.select("l", "r", score.alias("bridge")).filter("bridge > 0")
    ends = scored.select(F.col("l").alias("block"), "l", "r", "bridge").unionByName(scored.select(F.col("r").alias("block"), "l", "r", "bridge"))
    w = Window.partitionBy("block").orderBy(F.col("bridge").desc(), "l", "r")
    return ends.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top).select("l", "r", "bridge").distinct()


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """Element n // 2 of the sorted values, one row ``median``; reached by counts of equal values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    summed = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy(column))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    return summed.agg(F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col(column))).alias("median"))


def bridge_sum(bridges: DataFrame) -> DataFrame:
    """Sum of the bridges at each block."""
    ends = bridges.select(F.col("l").alias("block_id"), "bridge").unionByName(bridges.select(F.col("r").alias("block_id"), "bridge"))
    return ends.groupBy("block_id").agg(F.sum("bridge").alias("bridge_strength"))


def tag_pair_bridges(members: DataFrame, bridges: DataFrame) -> DataFrame:
    """Strongest bridge between blocks that hold the two tags, for tag pairs a < b."""
    left, right = members.select(F.col("block_id").alias("l"), F.col("tag_id").alias("x")), members.select(F.col("block_id").alias("r"), F.col("tag_id").alias("y"))
    pairs = bridges.join(left, "l").join(right, "r").filter("x <> y")
    return pairs.groupBy(F.least("x", "y").alias("tag_a_id"), F.greatest("x", "y").alias("tag_b_id")).agg(F.max("bridge").alias("bridge"))
