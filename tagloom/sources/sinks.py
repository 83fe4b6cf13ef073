"""Signals, JSON lines and the middle layer as sinks and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIGNAL_KEYS = ["project", "operation", "tag_set_hash", "occurred_at"]
MIDDLE_SCHEMA = "middle-layer/1"
CELL = "scope string, anchor string, layer_a string, layer_b string, score double"


def signals(events: DataFrame) -> DataFrame:
    """Signals of events (project, operation, tags, occurred_at): sorted tags, their hash, each once."""
    tags = F.array_sort("tags")
    return events.select("project", "operation", tags.alias("tags"), F.substring(F.sha2(F.to_json(tags), 256), 1, 16).alias("tag_set_hash"), "occurred_at").dropDuplicates(SIGNAL_KEYS)


def emit(new: DataFrame, path: str) -> None:
    """Append the signals that the folder doesn't have yet."""
    spark = new.sparkSession
    found = signals(new)
    try:
        found = found.join(spark.read.schema(found.schema).parquet(path).select(*SIGNAL_KEYS), SIGNAL_KEYS, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    found.write.mode("append").parquet(path)


def pending(found: DataFrame, processed: DataFrame, project: str | None = None, limit: int = 100) -> DataFrame:
    """The oldest signals that aren't processed (same keys)."""
    out = found.join(processed.select(*SIGNAL_KEYS), SIGNAL_KEYS, "left_anti")
    out = out if project is None else out.filter(F.col("project") == project)
    return out.orderBy("occurred_at", "project", "tag_set_hash").limit(limit)


def project_rollup(found: DataFrame, processed: DataFrame) -> DataFrame:
    """Signals, processed ones, first and last of each project."""
    done = processed.select(*SIGNAL_KEYS).distinct().withColumn("_done", F.lit(1))
    joined = found.join(done, SIGNAL_KEYS, "left")
    return joined.groupBy("project").agg(F.count(F.lit(1)).alias("signals"), F.sum(F.coalesce("_done", F.lit(0))).alias("processed"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def record_events(events: DataFrame, path: str) -> None:
    """Append tag events (tag_id, event_type; memory_id, weight, metadata, occurred_at if there), none dropped.

    A missing weight is 1, a missing time is now.
    """
    have = set(events.columns)

    def column(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)

    weight = F.coalesce(column("weight", "double"), F.lit(1.0)).alias("weight")
    at = F.coalesce(column("occurred_at", "timestamp"), F.current_timestamp()).alias("occurred_at")
    events.select(column("tag_id", "long"), column("event_type", "string"), column("memory_id", "string"), weight, column("metadata", "string"), at).write.mode("append").parquet(path)


def log_retrievals(results: DataFrame, folder: str, method: str, model_version: str) -> None:
    """Append retrievals and their results to ``retrievals`` and ``results`` under the folder.

    results: (retrieval_id, query_text, memory_id, score), a row a result, ids
    chosen by the caller; a retrieval without results is a row whose memory_id
    is null.  Ranks run from 1 by falling score, ties by memory_id.
    """
    found = F.count("memory_id").alias("result_count")
    heads = results.groupBy("retrieval_id").agg(F.min("query_text").alias("query_text"), found)
    w = Window.partitionBy("retrieval_id").orderBy(F.col("score").desc_nulls_last(), "memory_id")
    ranked = results.filter("memory_id is not null").select("retrieval_id", "memory_id", F.row_number().over(w).alias("rank"), "score")
    heads.withColumns({"method": F.lit(method), "model_version": F.lit(model_version), "occurred_at": F.current_timestamp()}).write.mode("append").parquet(f"{folder.rstrip('/')}/retrievals")
    ranked.write.mode("append").parquet(f"{folder.rstrip('/')}/results")


def log_tag_hits(hits: DataFrame, path: str) -> None:
    """Append the hits (retrieval_id, tag_id, hit_type) that the folder doesn't have yet, each once."""
    keys = ["retrieval_id", "tag_id", "hit_type"]
    found = hits.select(*keys).dropDuplicates()
    try:
        stored = hits.sparkSession.read.schema(found.schema).parquet(path)
        found = found.alias("new").join(stored.alias("old"), [F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}")) for k in keys], "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    found.write.mode("append").parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def unprocessed(questions: DataFrame, results: DataFrame, key: str = "question_id") -> DataFrame:
    return questions.join(results.select(key), key, "left_anti")


def write_middle_layer(cells: DataFrame, path: str, left: str, right: str) -> None:
    """Cells of an alignment as JSON lines, each with the schema's name and the projects."""
    cells.select(F.lit(MIDDLE_SCHEMA).alias("schema"), F.lit(left).alias("left"), F.lit(right).alias("right"), "scope", "anchor", "layer_a", "layer_b", "score").write.mode("overwrite").json(path)


def load_middle_layer(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.schema(f"schema string, left string, right string, {CELL}").json(path)
    if not found.filter(~F.col("schema").eqNullSafe(MIDDLE_SCHEMA)).isEmpty():
        raise ValueError(f"{path} is not {MIDDLE_SCHEMA}")
    return found.drop("schema")
