"""Balanced label propagation over shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import bucket_of, materialise, narrow, partitions, running_before


def _spread(amounts: DataFrame, room: list[int], before: str, amount: str) -> Column:
    """Shares of the interval [before, before + amount) in the rooms laid end to end: array of (shard, c)."""
    parts, lo = [], 0
    for s, r in enumerate(room):
        c = F.least(F.col(before) + F.col(amount), F.lit(lo + r)) - F.greatest(F.col(before), F.lit(lo))
        parts.append(F.struct(F.lit(s).alias("shard"), c.cast("long").alias("c")))
        lo += r
    return F.filter(F.array(*parts), lambda x: x["c"] > 0)


def balanced_label_propagation(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rounds: int = 6, seed: int = 5) -> DataFrame:
    """Put documents into shards of equal row counts, keeping equal texts together.

    Documents with equal texts are linked in a star through their group.  A
    document's first label is a hash of its id.  In each round every group
    moves members towards the open shard that already holds most of it; moves
    are admitted while the shard's quota lasts, so a group larger than a shard
    fills several.  Labels are propagated as counts for each group and shard
    (at most ``shards`` rows a group, however many copies), so that a group of
    a third of all rows costs no more than any other.  At the end documents
    without a linked partner fill what is left of the quotas.

    Row counts of the shards differ by one at most (the quotas are exact).

    Returns id, size (UTF-8 bytes + 1, 1 for null), text_crc32, shard, slot
    (gapless from 0 in each shard).  Null and empty texts form one group; null
    ids and repeated rows are documents like others; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = materialise(
        narrow(docs, id=id_col, text=text_col).select("id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("gid")),
        "shard-base",
    )
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    counts = base.groupBy("gid", bucket_of("id", shards, seed).alias("shard")).agg(F.count(F.lit(1)).alias("c"))
    sized = counts.withColumn("members", F.sum("c").over(Window.partitionBy("gid")))
    sized = materialise(sized, "shard-labels")
    state = sized.filter("members > 1").select("gid", "shard", "c")
    for step in range(rounds):
        load = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("c").alias("n")).collect()}  # one row a shard
        free = [max(0, quota[s] - load.get(s, 0)) for s in range(shards)]
        opened = F.array(*[F.lit(x) for x in free])[F.col("shard")] > 0
        ranked = F.struct("c", F.xxhash64("gid", "shard").alias("tie"), "shard")
        target = state.groupBy("gid").agg(F.max(F.when(opened, ranked)).alias("best"), F.sum("c").alias("members")).filter("best is not null")
        # The smaller part goes to the larger; a part in a full shard too, if all of the group has room where it goes.
        fits = ~opened & (F.col("members") <= F.array(*[F.lit(x) for x in free])[F.col("best.shard")])
        asked = (
            state.join(target, "gid")
            .filter((ranked < F.col("best")) | (fits & (F.col("shard") != F.col("best.shard"))))
            .select("gid", "shard", "c", F.col("best.shard").alias("to"))
        )
        asked = running_before(asked, "c", ["to"], [F.col("c"), F.col("gid"), F.col("shard")], bucket_of("gid", buckets, seed + step), "before")
        limit = F.array(*[F.lit(x) for x in free])[F.col("to")]
        moved = asked.withColumn("m", F.greatest(F.lit(0), F.least(F.col("c"), limit - F.col("before"))).cast("long")).filter("m > 0")
        moved = materialise(moved.select("gid", "shard", "to", "m"), "shard-moves")
        if moved.isEmpty():
            break
        state = materialise(
            state.unionByName(moved.select("gid", "shard", (-F.col("m")).alias("c"))).unionByName(moved.select("gid", F.col("to").alias("shard"), F.col("m").alias("c")))
            .groupBy("gid", "shard").agg(F.sum("c").alias("c")).filter("c > 0"),
            "shard-labels",
        )
    # What stands above a quota, and documents without partner, fill the rooms that are left.
    over = running_before(state, "c", ["shard"], [F.col("c").desc(), F.col("gid")], bucket_of("gid", buckets, seed), "before")
    allowed = F.array(*[F.lit(q) for q in quota])[F.col("shard")]
    over = materialise(over.withColumn("stay", F.greatest(F.lit(0), F.least(F.col("c"), allowed - F.col("before"))).cast("long")), "shard-kept")
    stays = over.filter("stay > 0").select("gid", "shard", F.col("stay").alias("c"))
    load = {r.shard: r.n for r in stays.groupBy("shard").agg(F.sum("c").alias("n")).collect()}
    room = [quota[s] - load.get(s, 0) for s in range(shards)]
    pool = over.select("gid", (F.col("c") - F.col("stay")).alias("c")).filter("c > 0").unionByName(sized.filter("members = 1").select("gid", "c"))
    pool = running_before(pool.withColumn("one", F.lit(1)), "c", ["one"], [F.col("gid"), F.col("c")], bucket_of("gid", buckets, seed + 99), "before")
    filled = pool.select("gid", F.explode(_spread(pool, room, "before", "c")).alias("x")).select("gid", "x.shard", "x.c")
    labels = stays.unionByName(filled).groupBy("gid", "shard").agg(F.sum("c").alias("c"))
    # Ends of the shards' shares of each group, in order: one row a group.
    ends = labels.withColumn("hi", F.sum("c").over(Window.partitionBy("gid").orderBy("shard"))).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("hi", "shard"))).alias("ends"))
    parts = base.groupBy("gid", bucket_of("id", buckets, seed + 1).alias("mb")).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("start", F.sum("n").over(Window.partitionBy("gid").orderBy("mb")) - F.col("n")).join(ends, "gid").select("gid", "mb", "start", "ends")
    local = Window.partitionBy("gid", "mb").orderBy("id")
    member = base.withColumn("mb", bucket_of("id", buckets, seed + 1)).withColumn("r", F.row_number().over(local) - 1).join(parts, ["gid", "mb"])
    placed = member.select("id", "size", "text_crc32", F.element_at(F.filter("ends", lambda e: e["hi"] > F.col("start") + F.col("r")), 1)["shard"].alias("shard"))
    placed = materialise(placed, "shard-placed").withColumn("one", F.lit(1))
    slots = running_before(placed, "one", ["shard"], [F.col("id")], bucket_of("id", buckets, seed + 2), "slot")
    return slots.select("id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
