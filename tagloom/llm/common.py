"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, ``narrow(df, id="doc_id")``.

    Columns are found by exact name and position, so that further columns may
    repeat a name in another case, or the names that operators use inside.
    """
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{df.columns.index(old)}").alias(new) for new, old in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on one machine, a folder of its own where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tagloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 500, size: str = "16m") -> None:
    """Bound the Arrow batches that Python workers get, as a text may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def bucket_of(column: Column | str, buckets: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(buckets)).cast("int")


def running_before(df: DataFrame, amount: str, keys: list[str], order: list[Column], bucket: Column, out: str) -> DataFrame:
    """Sum of ``amount`` over the rows before each row within ``keys``, without one task per key.

    Rows are ordered by (bucket, order).  Each bucket is summed first; the sums
    (one row for each key and bucket) give every bucket its start, and only the
    rows of one bucket are ordered together.
    """
    rows = df.withColumn("_b", bucket)
    sums = rows.groupBy(*keys, "_b").agg(F.sum(amount).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_sb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_l", F.coalesce(F.sum(amount).over(local), F.lit(0)))
    on = F.col("_b") == F.col("_sb")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(starts, on)
    return joined.withColumn(out, F.col("_start") + F.col("_l")).drop("_b", "_sb", "_start", "_l", *[f"_k{i}" for i in range(len(keys))])
