"""Corpus pipeline: language, near duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next one's docs.  All but the last return the columns of
``documents``.  Stages see what their predecessor kept and nothing else.

In all stages further columns may have any names, also such that differ from
others in case only; repeated rows and rows without id are documents like
others, unless a stage says what it does with them; an empty table gives an
empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tagloom.llm.common import materialise, shared_dir, table
from tagloom.llm.decontaminate import contaminated
from tagloom.llm.minhash import near_dedup
from tagloom.llm.mixing import mix
from tagloom.llm.ppm import UNKNOWN, identify
from tagloom.llm.sharding import balanced_label_propagation

#: A document in no learned language needs more bits a byte than this to code.
MOST_BITS = 5.0
#: Ids that are broadcast at most; more are joined in a shuffle.
BROADCAST_IDS = 1_000_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns by position, so that no two names clash, and the new name of each that is used."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain, {name: f"c{docs.columns.index(name)}" for name in ("doc_id", "text", "lang", "source")}


def _keyed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``_numbered`` with a ``key``: the id as text that sorts like the id, and of a row without id a number of its own after all ids, written down so that it stays."""
    plain, at = _numbered(docs)
    named = F.col(at["doc_id"])
    as_text = named.cast("string")
    if isinstance(plain.schema[at["doc_id"]].dataType, IntegralType):
        as_text = F.lpad((named.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    unnamed = materialise(plain.filter(named.isNull()).withColumn("key", F.concat(F.lit("~"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))), "unnamed")
    return plain.filter(named.isNotNull()).withColumn("key", as_text).unionByName(unnamed), at


def _renamed(plain: DataFrame, docs: DataFrame) -> DataFrame:
    return plain.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those that no learned language codes well.

    The column ``lang`` becomes the predicted language.
    """
    plain, at = _numbered(docs)
    found = identify(plain, id_col=at["doc_id"], text_col=at["text"], lang_col=at["lang"], keep=tuple(plain.columns))
    good = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") <= MOST_BITS))
    return _renamed(good.withColumn(at["lang"], F.col("lang_pred")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; one without id only where none has an id.

    Of repeated rows (same id and text) one stays.
    """
    keyed, at = _keyed(docs)
    kept = near_dedup(keyed, id_col="key", text_col=at["text"]).filter("kept").select(F.col("id").alias("key"))
    one = keyed.join(kept.distinct(), "key", "left_semi").withColumn("hash", F.sha2(at["text"], 256)).dropDuplicates(["key", "hash"])
    return _renamed(one, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; each document without id by its own text."""
    keyed, at = _keyed(docs)
    found = materialise(contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="key", text_col=at["text"]).select(F.col("id").alias("key")).distinct(), "contaminated")
    if found.count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    return _renamed(keyed.join(found, "key", "left_anti"), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: taken / size, rounded up or down by a hash of the id.

    The chance of rounding up is the fraction, so that each source's words come
    near its target.  Documents of sources that are at their target are so
    thinned out, and those of sources below it repeated; a document without
    words is not taken.
    """
    keyed, at = _keyed(docs)
    taken = mix(keyed, id_col="key", text_col=at["text"], source_col=at["source"]).filter("taken > 0")
    drawn = F.pmod(F.xxhash64(F.lit("copies"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = taken.select(F.col("id").alias("key"), "size", F.floor(F.col("taken") / F.col("size") + drawn).cast("int").alias("copies")).filter("copies > 0")
    # Repeated rows of an id have equal shares up to their blocks; each takes the share of one of them.
    chosen = copies.groupBy("key").agg(F.max("copies").alias("copies"))
    out = keyed.join(chosen, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return _renamed(out, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mixture."""
    return balanced_label_propagation(docs).select(F.col("id").alias("doc_id"), "size", "text_crc32", "shard", "slot")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("shard", shard),
]

#: Stages of trained models and of hashed search have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
