"""Queries of the training-data operators, and SQL for them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import table
from tagloom.llm.decontaminate import contaminated
from tagloom.llm.exact_dedup import exact_dedup
from tagloom.llm.minhash import MinHashParams, near_dedup
from tagloom.llm.mixing import mix
from tagloom.llm.ppm import identify, split
from tagloom.llm.quality import score_quality
from tagloom.llm.sharding import balanced_label_propagation
from tagloom.llm.suffix_dedup import remove_repeats
from tagloom.llm.toxicity import score_toxicity
from tagloom.llm.warc import archive_pages


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of ``documents``; the largest id stays."""
    out = exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.sha2("norm", 256).alias("text_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its repeated 100-byte strings."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of equal row counts (law ``rows``) for all documents."""
    out = balanced_label_propagation(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``documents`` that are items of ``benchmark``."""
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", "edits", "first_word", "end_word")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a similarity of 0.85 or more."""
    out = near_dedup(table(spark, sf_dir, "documents"), params=MinHashParams(percent=85))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows without id are neither held out nor labelled."""
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=split(F.col("id"), 4) != 2)
    return out.select(F.col("id").alias("doc_id"), (split(F.col("id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows without id aren't held out."""
    out = identify(table(spark, sf_dir, "documents"), learn_from=split(F.col("id"), 4) != 2)
    return out.select(F.col("id").alias("doc_id"), (split(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows without id are neither held out nor labelled."""
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=split(F.col("id"), 5) != 0)
    return out.select(F.col("id").alias("doc_id"), (split(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ``pages``, written to archives and read back."""
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op4_decontaminate": op4_decontaminate,
    "op5_minhash": op5_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_language": op7_language,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op10_warc": """
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INT) << CAST(4 - j AS INT))) AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
        FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits,
                     min(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages)""",
}
