"""The forest: edges between items that are active in one scope, blocks of tags, and snapshots, a batch of scopes at a time.

Scopes are stores, retrievals or synchronicities.  Each function takes the
stored table (or None) and returns the table after the batch; the caller
writes it beside the old one.  active: (scope_id, target_type, target_id), ids
as strings, target_type ``tag`` or ``memory``; repeated rows count once, rows
with nulls not at all.  gate: the tag pairs (tag_a_id, tag_b_id), a < b, that
may have an edge; memories need none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.tensor import PAIR

ENDS = ["left_type", "left_id", "right_type", "right_id"]
EDGE = [*ENDS, "scope_type"]


def _once(active: DataFrame) -> DataFrame:
    return active.select("scope_id", "target_type", "target_id").dropna().distinct()


def scope_pairs(active: DataFrame, gate: DataFrame) -> DataFrame:
    """(scope_id and both ends) of the pairs of each scope.

    The tags of a scope meet each other or their partners in the gate,
    whichever makes fewer rows; both give the gated pairs.
    """
    rows = _once(active)
    pairs = gate.select(*[F.col(c).cast("long").alias(c) for c in PAIR]).distinct()
    partners = pairs.groupBy("tag_a_id").agg(F.count(F.lit(1)).alias("_p"))
    scope = Window.partitionBy("scope_id")
    tags = rows.filter("target_type = 'tag'").select("scope_id", F.col("target_id").cast("long").alias("tag_a_id")).join(partners, "tag_a_id", "left")
    tags = tags.withColumns({"_k": F.count(F.lit(1)).over(scope), "_p": F.sum(F.coalesce("_p", F.lit(0))).over(scope)}).withColumn("_near", F.col("_k") * (F.col("_k") - 1) / 2 <= F.col("_p"))
    near, far = (tags.filter(f).select("scope_id", "tag_a_id") for f in ("_near", "not _near"))
    of_tags = near.join(near.withColumnRenamed("tag_a_id", "tag_b_id"), "scope_id").filter("tag_a_id < tag_b_id").join(pairs, PAIR, "left_semi").select("scope_id", *PAIR)
    through = far.join(pairs, "tag_a_id").join(far.withColumnRenamed("tag_a_id", "tag_b_id"), ["scope_id", "tag_b_id"]).select("scope_id", *PAIR)
    of_tags = of_tags.unionByName(through)
    memories = rows.filter("target_type = 'memory'").select("scope_id", F.col("target_id").alias("left_id"))
    of_memories = memories.join(memories.withColumnRenamed("left_id", "right_id"), "scope_id").filter("left_id < right_id")

    def ends(pairs: DataFrame, kind: str, left: str, right: str) -> DataFrame:
        return pairs.select("scope_id", F.lit(kind).alias("left_type"), F.col(left).cast("string").alias("left_id"), F.lit(kind).alias("right_type"), F.col(right).cast("string").alias("right_id"))

    return ends(of_tags, "tag", *PAIR).unionByName(ends(of_memories, "memory", "left_id", "right_id"))


def grow_edges(stored: DataFrame | None, active: DataFrame, scope_type: str, gate: DataFrame, counts: DataFrame, total: DataFrame) -> DataFrame:
    """Edges after the batch: raw and expected count, lift, PMI, strength (PMI, or 0), evidence.

    counts: (target_type, target_id, n), scopes of this type that hold the
    item, the batch included, 1 where absent.  total: one row, the number of
    scopes.  Edges that the batch doesn't touch stay as they are.
    """
    added = scope_pairs(active, gate).groupBy(*ENDS).agg(F.count(F.lit(1)).alias("_add")).withColumn("scope_type", F.lit(scope_type))
    kept = None
    if stored is None:
        grown = added.withColumns({"_raw": F.lit(0.0), "_seen": F.lit(0).cast("long")})
    else:
        grown = added.join(stored.select(*EDGE, F.col("raw_count").alias("_raw"), F.col("evidence_count").alias("_seen")), EDGE, "left").fillna({"_raw": 0.0, "_seen": 0})
        kept = stored.join(added.select(*EDGE), EDGE, "left_anti")
    for side in ("left", "right"):
        n = counts.select(F.col("target_type").alias(f"{side}_type"), F.col("target_id").alias(f"{side}_id"), F.col("n").alias(f"_{side}"))
        grown = grown.join(n, [f"{side}_type", f"{side}_id"], "left")
    one = total.select(F.greatest(F.col(total.columns[0]), F.lit(1)).alias("_total")).limit(1)
    at_least = {s: F.greatest(F.coalesce(f"_{s}", F.lit(1)), F.lit(1)) for s in ("left", "right")}
    expected = at_least["left"] * at_least["right"] / F.col("_total")
    grown = grown.crossJoin(F.broadcast(one)).withColumns({"raw_count": F.col("_raw") + F.col("_add"), "expected_count": expected})
    grown = grown.withColumn("lift", F.col("raw_count") / F.col("expected_count")).withColumn("pmi", F.log("lift"))
    out = grown.select(*EDGE, "raw_count", "expected_count", "lift", "pmi", F.greatest(F.lit(0.0), "pmi").alias("co_strength"), (F.col("_seen") + F.col("_add")).alias("evidence_count"))
    return out if kept is None else out.unionByName(kept.select(*out.columns))


def block_keys(active: DataFrame) -> DataFrame:
    """(scope_id, block_key): hash of each scope's sorted tags."""
    tags = _once(active).filter("target_type = 'tag'").groupBy("scope_id").agg(F.sort_array(F.collect_list("target_id")).alias("_t"))
    return tags.select("scope_id", F.substring(F.sha2(F.concat(F.lit("cooccurrence:tag_set:"), F.array_join("_t", ",")), 256), 1, 32).alias("block_key"))


def _strengths(edges: DataFrame) -> DataFrame:
    return edges.filter("left_type = 'tag'").groupBy(*ENDS).agg(F.max("co_strength").alias("strength"))


def grow_blocks(stored: DataFrame | None, active: DataFrame, edges: DataFrame, gate: DataFrame) -> DataFrame:
    """(block_key, density, evidence_count) after the batch.

    A scope with tags and at least one pair is evidence of the block of its
    tags; density is the mean of the strongest edge of its gated pairs.
    edges: as after the batch.
    """
    pairs = scope_pairs(active, gate)
    density = pairs.filter("left_type = 'tag'").join(_strengths(edges), ENDS).groupBy("scope_id").agg(F.avg("strength").alias("_d"))
    fresh = block_keys(active).join(pairs.select("scope_id").distinct(), "scope_id", "left_semi").join(density, "scope_id", "left")
    fresh = fresh.groupBy("block_key").agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("density"), F.count(F.lit(1)).alias("evidence_count"))
    if stored is None:
        return fresh
    old = stored.select("block_key", F.col("density").alias("_d"), F.col("evidence_count").alias("_e"))
    return fresh.join(old, "block_key", "full_outer").select("block_key", F.coalesce("density", "_d").alias("density"), (F.coalesce("evidence_count", F.lit(0)) + F.coalesce("_e", F.lit(0))).alias("evidence_count"))


def memberships(active: DataFrame, edges: DataFrame, gate: DataFrame) -> DataFrame:
    """(block_key, target_type, target_id, strength, evidence_count) of the batch's blocks.

    A tag belongs by the sum of its strengths inside the block over the number
    of other tags, a memory wholly.
    """
    pairs, rows = scope_pairs(active, gate), _once(active)
    keyed = block_keys(active).join(pairs.select("scope_id").distinct(), "scope_id", "left_semi")
    sizes = rows.filter("target_type = 'tag'").groupBy("scope_id").agg(F.count(F.lit(1)).alias("_n"))
    met = pairs.filter("left_type = 'tag'").join(_strengths(edges), ENDS)
    sums = met.select("scope_id", F.col("left_id").alias("target_id"), "strength").unionByName(met.select("scope_id", F.col("right_id").alias("target_id"), "strength")).groupBy("scope_id", "target_id").agg(F.sum("strength").alias("_s"))
    joined = rows.join(keyed, "scope_id").join(sizes, "scope_id").join(sums, ["scope_id", "target_id"], "left")
    share = F.when(F.col("target_type") == "memory", 1.0).otherwise(F.coalesce("_s", F.lit(0.0)) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return joined.groupBy("block_key", "target_type", "target_id").agg(F.max(share).alias("strength"), F.count(F.lit(1)).alias("evidence_count"))


def snapshots(active: DataFrame, scope_type: str, gate: DataFrame, edges: DataFrame, bridges: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row a scope that changed the forest: what it touched, and the sizes of the forest after the batch."""
    rows = _once(active).join(scope_pairs(active, gate).select("scope_id").distinct(), "scope_id", "left_semi")

    def ids(kind: str, order: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("target_type") == kind, F.struct(F.expr(order).alias("o"), F.col("target_id").alias("i"))))), lambda x: x["i"])

    touched = rows.groupBy("scope_id").agg(ids("memory", "target_id").alias("memory_ids"), ids("tag", "try_cast(target_id AS long)").alias("tag_ids"))
    sizes = None
    for name, table in (("co_edge_count", edges), ("bridge_edge_count", bridges), ("block_count", blocks)):
        one = table.agg(F.count(F.lit(1)).alias(name))
        sizes = one if sizes is None else sizes.crossJoin(one)
    out = touched.join(block_keys(active), "scope_id", "left").crossJoin(F.broadcast(sizes))
    return out.select(F.lit(scope_type).alias("trigger_type"), F.col("scope_id").alias("trigger_id"), "memory_ids", "tag_ids", "block_key", "co_edge_count", "bridge_edge_count", "block_count")
