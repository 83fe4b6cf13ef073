"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import materialise, narrow

#: Words: runs of other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Fractional part of the golden ratio, and of that times 2**24.
GOLDEN = 0.6180339887498949
GOLDEN_24 = (GOLDEN * 2**24) % 1.0
#: Cells of [0, 1) through which slots meet their source's interval.
CELLS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Targets of each source from (source, source_size).

    Sources in order of code points, null last, take the weights in turn and
    share the sum of all sizes.  A target stops at ``cap`` times its source's
    size and the rest is shared again by weight.  With sources in order of
    cap/weight the level at which this ends is a running sum: the first source
    that its own level doesn't cap ends the search.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("ord", F.row_number().over(one) - 1)
    ranked = ranked.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[F.pmod("ord", F.lit(len(weights)))])
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(cap))
    upto = Window.orderBy(F.col("most") / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.col("most") / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - (F.sum("most").over(upto) - F.col("most"))) / (F.sum("weight").over(everything) - (F.sum("weight").over(upto) - F.col("weight")))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("final", F.min(F.when(F.col("level") <= F.col("most") / F.col("weight") * (1 + 1e-12), F.struct(F.col("most") / F.col("weight"), F.col("ord"), F.col("level").alias("level")))).over(everything)["level"])
    return ranked.select("source", "ord", "source_size", F.least(F.col("most"), F.col("final") * F.col("weight")).cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 64, seed: str = "mix") -> DataFrame:
    """Mix sources to target weights.

    Each source's documents are laid end to end in a shuffled order and cut
    into blocks of ``block_words`` words.  Slot j of the schedule has the
    golden-ratio point frac(j * phi); the cumulative targets map it to a
    source.  A source's slots, ranked, take its blocks in turn, beginning
    again after the last; a block is taken ``cap`` times at most.

    Returns id, source, size (words), source_size, target, taken (words that
    the mix takes of the document, repeats counted).

    Null text has size 0; a document without words is never taken.  A null
    source is a source of its own, last in order.  Repeated rows are documents
    like others.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    # A row's place in the shuffled order; equal rows are told apart by a number so that every row has an offset of its own.
    rows = narrow(docs, id=id_col, text=text_col, source=source_col).select("id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialise(rows.withColumn("place", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))))), "mix-rows")
    sources = materialise(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, float(cap)), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    slots_n = -(-total // block_words)

    # Laid end to end: the first two digits of the place are the bucket, so that a source isn't ordered in one task.
    keyed = rows.withColumn("b", F.substring("place", 1, 2))
    sums = keyed.groupBy("source", "b").agg(F.sum("size").alias("s"))
    starts = sums.withColumn("start", F.sum("s").over(Window.partitionBy("source").orderBy("b")) - F.col("s"))
    starts = starts.join(sources.select(F.col("source").alias("src"), "ord", "source_size", "target"), F.col("source").eqNullSafe(F.col("src"))).select(F.col("source").alias("src"), F.col("b").alias("sb"), "start", "ord", "source_size", "target")
    local = Window.partitionBy("source", "b").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = keyed.withColumn("upto", F.sum("size").over(local) - F.col("size")).join(starts, F.col("source").eqNullSafe(F.col("src")) & (F.col("b") == F.col("sb")))
    laid = materialise(laid.select("id", "source", "ord", "size", "source_size", "target", (F.col("start") + F.col("upto")).alias("at")), "mix-laid")

    # Intervals of the cumulative targets, by cell.
    run = Window.orderBy("ord")
    reach = sources.withColumn("hi", F.sum("target").over(run) / F.lit(float(total or 1)))
    reach = reach.select("ord", F.coalesce(F.lag("hi").over(run), F.lit(0.0)).alias("lo"), F.when(F.lead("ord").over(run).isNull(), F.lit(2.0)).otherwise(F.col("hi")).alias("hi"), F.ceil(F.col("source_size") / block_words).alias("blocks"))
    cells = reach.filter("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))))).filter("blocks > 0")
    j = F.col("slot")
    point = F.pmod(F.floor(j / F.lit(2**24)) * F.lit(GOLDEN_24) + F.pmod(j, F.lit(2**24)) * F.lit(GOLDEN), F.lit(1.0))
    points = spark.range(slots_n).withColumnRenamed("id", "slot").withColumn("u", point).withColumn("cell", F.floor(F.col("u") * CELLS))
    slots = points.join(cells, "cell").filter("u >= lo and u < hi").select("slot", "ord", "blocks", F.floor(j / F.lit(2**16)).alias("chunk"))
    # Rank of each slot in its source: runs of slots are counted first.
    chunk_sums = slots.groupBy("ord", "chunk").agg(F.count(F.lit(1)).alias("n"))
    chunk_starts = chunk_sums.withColumn("start", F.sum("n").over(Window.partitionBy("ord").orderBy("chunk")) - F.col("n")).select("ord", "chunk", "start")
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("ord", "chunk").orderBy("slot")) - 1).join(chunk_starts, ["ord", "chunk"]).withColumn("rank", F.col("start") + F.col("r"))
    times = ranked.filter(F.col("rank") < cap * F.col("blocks")).groupBy("ord", F.pmod("rank", "blocks").alias("block")).agg(F.count(F.lit(1)).alias("times"))

    pieces = laid.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))))
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("at"), F.col("block") * block_words)
    joined = pieces.select("id", "ord", "at", "block", words.alias("words")).join(times, ["ord", "block"])
    taken = joined.groupBy("ord", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = laid.join(taken.select(F.col("ord").alias("o"), F.col("at").alias("a"), "taken"), (F.col("ord") == F.col("o")) & (F.col("at") == F.col("a")) & (F.col("size") > 0), "left")
    return out.select("id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
