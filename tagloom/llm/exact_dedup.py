"""Exact deduplication by a content sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import narrow, partitions

#: Characters of a text that splitters hold; ties of these are parted by a hash, so that samples sent to the driver are small.
PREFIX = 64
#: A text is hot when its copies exceed one part in HOT_SHARE of the mean partition.
HOT_SHARE = 8


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Group equal texts by sorting them; one row of each group is kept.

    Sampled splitters range-partition the texts (by their first characters, then
    a hash), an external sort puts equal texts side by side, and full comparison
    of neighbours finds the groups.  A
    text with so many copies that it would fill a partition is dealt over
    several by a salt from its id: each share finds its best row, and only
    those rows are sorted again.

    Returns one row per input row: id, norm (the text compared), keep_id (id
    that stays: the ``smallest`` or the ``largest``), group_size, kept.

    Null text counts as empty.  Null ids come last, and are the keep_id only
    where a group has no other.  Of repeated rows (same id and text) exactly
    one is kept.  An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(keep)
    rows = narrow(docs, id=id_col, norm=text_col).withColumn("norm", F.coalesce(F.col("norm").cast("string"), F.lit("")))
    parts = partitions(docs.sparkSession)
    share = max(1, rows.count() // (HOT_SHARE * parts))
    # At most HOT_SHARE * partitions texts have more copies than `share`: that bounds the broadcasts.
    hot = rows.groupBy(F.xxhash64("norm").alias("h")).count().filter(F.col("count") > share).select("h", F.ceil(F.col("count") / share).alias("shares"))
    salted = (
        rows.withColumns({"h": F.xxhash64("norm"), "prefix": F.substring("norm", 1, PREFIX)})
        .join(F.broadcast(hot), "h", "left")
        .select("id", "norm", "prefix", "h", F.col("shares").isNotNull().alias("hot"), F.coalesce(F.pmod(F.xxhash64(F.lit(1), "id"), F.col("shares")), F.lit(0)).alias("salt"))
        .repartitionByRange("prefix", "h", "salt")
    )
    order = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    equal = Window.partitionBy("prefix", "h", "salt", "norm").orderBy(order)
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = salted.select(
        "id", "norm", "prefix", "h", "salt", "hot",
        F.row_number().over(equal).alias("rn"), F.first("id").over(whole).alias("best"), F.count(F.lit(1)).over(whole).alias("n"),
        F.when(F.col("hot"), F.sha2("norm", 256)).alias("digest"),
    )
    best = F.min("best") if keep == "smallest" else F.max("best")
    again = Window.partitionBy("prefix", "h", "norm")
    merged = (
        placed.filter(F.col("hot") & (F.col("rn") == 1))
        .repartitionByRange("prefix", "h")
        .select(F.col("digest").alias("d"), F.col("salt").alias("s"), best.over(again).alias("all_best"), F.sum("n").over(again).alias("all_n"))
    )
    joined = placed.join(F.broadcast(merged), (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    return joined.select(
        "id", "norm",
        F.when(F.col("d").isNull(), F.col("best")).otherwise(F.col("all_best")).alias("keep_id"),
        F.coalesce("all_n", "n").cast("long").alias("group_size"),
        ((F.col("rn") == 1) & (F.col("d").isNull() | F.col("best").eqNullSafe(F.col("all_best")))).alias("kept"),
    )
