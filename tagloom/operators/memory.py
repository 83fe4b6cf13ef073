"""Memories and their tags: look-ups, retrieval by tags, merging of tags, salience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.scalar import normalize_tag


def active(memories: DataFrame) -> DataFrame:
    return memories.filter(~F.coalesce(F.col("is_archived"), F.lit(False)))


def by_id(df: DataFrame, ids: DataFrame | list, column: str) -> DataFrame:
    """Rows with the ids, given as a short list or as a table with the column."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(ids))


def list_recent(memories: DataFrame, limit: int = 20) -> DataFrame:
    return active(memories).orderBy(F.col("created_at").desc(), F.col("memory_id")).limit(limit)


def count_active(memories: DataFrame) -> DataFrame:
    return active(memories).agg(F.count(F.lit(1)).alias("active_memories"))


def archive(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft deletion: the memories of ``ids`` (memory_id) become archived."""
    marked = ids.select("memory_id").distinct().withColumn("_hit", F.lit(True))
    return memories.join(marked, "memory_id", "left").withColumn("is_archived", F.coalesce("_hit", "is_archived")).drop("_hit")


def retrieve_by_tags(memories: DataFrame, memory_tags: DataFrame, tags: list, match_all: bool = False) -> DataFrame:
    """Active memories with any of the tags, or with all of them (relational division)."""
    hits = memory_tags.filter(F.col("tag_id").isin(tags))
    if match_all:
        hits = hits.groupBy("memory_id").agg(F.countDistinct("tag_id").alias("_n")).filter(F.col("_n") == len(set(tags)))
    return active(memories).join(hits, "memory_id", "left_semi")


def tags_of_memories(memory_tags: DataFrame) -> DataFrame:
    """Sorted tags, and their number, of each memory."""
    return memory_tags.groupBy("memory_id").agg(F.sort_array(F.collect_set("tag_id")).alias("tag_ids"), F.countDistinct("tag_id").alias("tag_count"))


def get_or_create_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Names (column name) that are new after normalisation."""
    wanted = names.select(normalize_tag(F.col("name")).alias("name")).filter("name <> ''").distinct()
    return wanted.join(tags.select("name"), "name", "left_anti")


def list_active_names(tags: DataFrame) -> DataFrame:
    """Names of the active tags, in order; a tag without the flag is active."""
    return tags.filter(F.coalesce(F.col("is_active"), F.lit(True))).select("name").orderBy("name")


def overview(**tables: DataFrame) -> DataFrame:
    """(name, total): rows of each table, counted in one pass each."""
    counts = [df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("name"), "total") for name, df in tables.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def split_compounds(tags: DataFrame) -> DataFrame:
    """Parts of compound names (name) that aren't names already: over one letter, not numeric."""
    parts = tags.select(F.explode(F.split("name", "[-_]")).alias("name")).filter((F.length("name") > 1) & ~F.col("name").rlike("^[0-9]+$")).distinct()
    return parts.join(tags.select("name"), "name", "left_anti")


def letter_tags(texts: DataFrame, id_col: str = "memory_id", text_col: str = "content") -> DataFrame:
    """Each letter of a text as a tag, its confidence the number of times that it occurs."""
    # The texts of an id come together first, so that no task holds a counter for each letter of its ids.
    whole = texts.select(F.col(id_col), F.lower(F.col(text_col)).alias("_t")).repartition(id_col).groupBy(id_col).agg(F.concat_ws("", F.collect_list("_t")).alias("_t"))
    letters = whole.select(id_col, "_t", F.explode(F.filter(F.array_distinct(F.split("_t", "")), lambda c: c.rlike(r"^\p{L}$"))).alias("letter"))
    return letters.select(id_col, "letter", (F.length("_t") - F.length(F.replace(F.col("_t"), F.col("letter"), F.lit("")))).cast("double").alias("confidence"))


def time_tags(memories: DataFrame) -> DataFrame:
    """Month, day and minute tags of each memory."""
    at = F.col("created_at")
    names = F.array(F.concat(F.lit("month-"), F.date_format(at, "MM")), F.concat(F.lit("day-"), F.date_format(at, "dd")), F.concat(F.lit("minute-"), F.date_format(at, "mm")))
    return memories.select("memory_id", F.explode(names).alias("name"))


def store_memories(memories: DataFrame) -> DataFrame:
    """All tags that storing derives (memory_id, content, created_at, tags): (memory_id, name, confidence).

    Given tags normalised, parts of compound ones, time tags, and letters.
    """
    given = memories.select("memory_id", F.explode("tags").alias("name")).select("memory_id", normalize_tag(F.col("name")).alias("name")).filter("name <> ''").distinct()
    parts = given.select("memory_id", F.explode(F.split("name", "[-_]")).alias("name")).filter((F.length("name") > 1) & ~F.col("name").rlike("^[0-9]+$"))
    words = given.unionByName(parts).unionByName(time_tags(memories)).distinct().withColumn("confidence", F.lit(1.0))
    return words.unionByName(letter_tags(memories).withColumnRenamed("letter", "name")).groupBy("memory_id", "name").agg(F.max("confidence").alias("confidence"))


LAYERS = ("cooccurrence", "synchronicity", "semantic", "glyph")


def merge_tags(tensor: DataFrame, source: int, target: int) -> DataFrame:
    """Edges after tag ``source`` became ``target``: (tag_a_id < tag_b_id, layers, semiotic_forward, semiotic_reverse).

    Where the order of an edge's ends flips, its directions do; each layer
    keeps the larger value; edges from a tag to itself go.
    """

    def renamed(c: str) -> Column:
        return F.when(F.col(c) == source, F.lit(target)).otherwise(F.col(c))

    a, b = renamed("tag_a_id"), renamed("tag_b_id")
    moved = tensor.withColumns({"_a": a, "_b": b}).filter("_a <> _b").withColumn("_flip", F.col("_a") > F.col("_b"))
    kept = moved.select(
        F.least("_a", "_b").alias("tag_a_id"), F.greatest("_a", "_b").alias("tag_b_id"), *LAYERS,
        F.when(F.col("_flip"), F.col("semiotic_reverse")).otherwise(F.col("semiotic_forward")).alias("semiotic_forward"),
        F.when(F.col("_flip"), F.col("semiotic_forward")).otherwise(F.col("semiotic_reverse")).alias("semiotic_reverse"),
    )
    return kept.groupBy("tag_a_id", "tag_b_id").agg(*[F.max(c).alias(c) for c in (*LAYERS, "semiotic_forward", "semiotic_reverse")])


def merge_memory_tags(memory_tags: DataFrame, source: int, target: int) -> DataFrame:
    return memory_tags.select("memory_id", F.when(F.col("tag_id") == source, F.lit(target)).otherwise(F.col("tag_id")).alias("tag_id")).distinct()


def keep_strongest(events: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the strongest, then the latest, then the smallest id."""
    w = Window.partitionBy(*keys).orderBy(F.col("strength").desc(), F.col("detected_at").desc(), F.col("event_id"))
    return events.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """(x - min) / (max - min) over the table, 0.5 where all are equal."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.when(spread < 1e-9, 0.5).otherwise((F.col(column) - F.col("_lo")) / spread)).drop("_lo", "_hi")


def ranked(df: DataFrame, keys: list[str], score: str, tie: str, out: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(out, F.row_number().over(w).cast("long"))


def compare_traces(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two scored lists (memory_id, score) side by side: scores, shift of score and rank, and where a memory is."""

    def listed(df: DataFrame, suffix: str) -> DataFrame:
        # Result lists are bounded by the limit of a retrieval.
        w = Window.orderBy(F.col("score").desc(), F.col("memory_id"))
        return df.select("memory_id", F.col("score").alias(f"score_{suffix}"), F.row_number().over(w).cast("long").alias(f"rank_{suffix}"))

    both = listed(before, "before").join(listed(after, "after"), "memory_id", "full_outer")
    where = F.when(F.col("score_before").isNull(), "added").when(F.col("score_after").isNull(), "removed").otherwise("both")
    return both.select("memory_id", "score_before", "score_after", (F.col("score_after") - F.col("score_before")).alias("score_shift"), (F.col("rank_before") - F.col("rank_after")).alias("rank_shift"), where.alias("found_in"))


def ids_by_source(memories: DataFrame, source: str = "source_model") -> DataFrame:
    """Sorted ids of each source, and how many; the inverse is the table itself."""
    return memories.groupBy(source).agg(F.sort_array(F.collect_list("memory_id")).alias("memory_ids"), F.count(F.lit(1)).alias("cnt"))


def rows_by_source(memories: DataFrame, source: str = "source_model") -> DataFrame:
    """A row for each memory, with the number of memories of its source; no list grows with the table."""
    counts = memories.groupBy(F.col(source).alias("_s")).agg(F.count(F.lit(1)).alias("cnt"))
    return memories.join(F.broadcast(counts), F.col(source).eqNullSafe(F.col("_s"))).select(source, "memory_id", "cnt")


def first_chunks(vectors: DataFrame) -> DataFrame:
    """The vector of the first chunk of each memory."""
    return vectors.groupBy("memory_id").agg(F.min("chunk_index").alias("chunk_index"), F.min_by("embedding", "chunk_index").alias("embedding"))


def replace_chunks(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the memories in ``new`` replaced by these."""
    return vectors.join(new.select("memory_id").distinct(), "memory_id", "left_anti").unionByName(new)


def record_usefulness(results: DataFrame, marks: DataFrame) -> DataFrame:
    """Results with the flag was_useful (true, false or unknown) of ``marks`` (retrieval_id, memory_id, was_useful)."""
    m = marks.groupBy("retrieval_id", "memory_id").agg(F.max("was_useful").alias("was_useful"))
    return results.join(m, ["retrieval_id", "memory_id"], "left")


def results_by_retrieval(results: DataFrame) -> DataFrame:
    """Memories of each retrieval by rank of their score."""
    w = Window.partitionBy("retrieval_id").orderBy(F.col("score").desc(), F.col("memory_id"))
    ranked_ = results.withColumn("_r", F.row_number().over(w))
    return ranked_.groupBy("retrieval_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "memory_id"))), lambda s: s["memory_id"]).alias("memory_ids"))


def feedback_tags(patterns: DataFrame) -> DataFrame:
    """Emergent tag of each pattern (pattern_id, name, weight rows): the two heaviest names as ``a-x-b``."""
    w = Window.partitionBy("pattern_id").orderBy(F.col("weight").desc(), F.col("name"))
    top = patterns.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    return top.groupBy("pattern_id").agg(F.concat_ws("-x-", F.array_sort(F.collect_list("name"))).alias("name"), F.count(F.lit(1)).alias("_n")).filter("_n = 2").drop("_n")


def boost_salience(memories: DataFrame, involved: DataFrame, step: float = 0.05) -> DataFrame:
    """Salience of involved memories raised by a step, 1 at most."""
    hit = involved.select("memory_id").distinct().withColumn("_hit", F.lit(True))
    raised = F.when(F.col("_hit"), F.least(F.lit(1.0), F.col("salience") + step)).otherwise(F.col("salience"))
    return memories.join(hit, "memory_id", "left").withColumn("salience", raised).drop("_hit")
