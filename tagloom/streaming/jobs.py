"""Streams: windowed trends, watched folders, a bus of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tagloom.sources.files import ingest, parse_files
from tagloom.sources.sinks import SIGNAL_KEYS, signals

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def windowed_counts(events: DataFrame, window: str = "168 hours", slide: str = "24 hours", late: str = "168 hours") -> DataFrame:
    """Events and their weight by tag in sliding windows (tag_id, occurred_at, weight); the watermark is no shorter than the window."""
    return (
        events.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", window, slide), "tag_id").agg(F.count(F.lit(1)).alias("events"), F.sum("weight").alias("weight"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "tag_id", "events", "weight")
    )


def watch_folder(spark: SparkSession, folder: str, stored: str, checkpoint: str) -> StreamingQuery:
    """New and changed files of a folder, chunked, those chunks appended to ``stored`` that it doesn't have."""
    raw = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(folder)

    def add(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        try:
            have = session.read.parquet(stored).select("content_hash")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have = session.createDataFrame([], "content_hash string")
        ingest(parse_files(batch, folder), have).write.mode("append").parquet(stored)

    return raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signal_bus(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Signals of a stream of events, each once within the watermark, appended to a folder."""
    found = signals(events.withWatermark("occurred_at", late)).dropDuplicates(SIGNAL_KEYS)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
