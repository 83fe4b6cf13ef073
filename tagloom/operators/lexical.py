"""Retrieval by the words of tag names: index, match, and expansion over the tensor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.graph import prune_by_inward, walk
from tagloom.operators.lineage import cut
from tagloom.operators.tensor import best_of_memories
from tagloom.params import Params

#: Names that begin so, and one-letter and numeric names, are no words to look for.
SKIPPED = ("month-", "day-")


def lexical_index(tags: DataFrame, p: Params = Params()) -> DataFrame:
    """(term, tag_id, exact) of the active tags: whole names, and the parts of compound names that are long enough.

    tags: (tag_id, name), with is_active if some aren't.
    """
    if "is_active" in tags.columns:
        tags = tags.filter("is_active")
    skipped = F.lit(False)
    for prefix in SKIPPED:
        skipped |= F.col("name").startswith(prefix)
    named = tags.filter(~skipped & (F.length("name") > 1) & ~F.col("name").rlike("^[0-9]+$")).select("tag_id", "name")
    parts = named.select("tag_id", F.split("name", "[-_]").alias("parts")).filter(F.size("parts") > 1).select("tag_id", F.explode("parts").alias("term")).filter(F.length("term") >= p.lexical_length)
    whole = named.select(F.col("name").alias("term"), "tag_id", F.lit(True).alias("exact"))
    return whole.unionByName(parts.select("term", "tag_id", F.lit(False).alias("exact"))).groupBy("term", "tag_id").agg(F.max("exact").alias("exact"))


def tokens(queries: DataFrame, p: Params = Params()) -> DataFrame:
    """(query_id, position, token, compound) of texts (query_id, text): the words that are long enough, and each with the next."""
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")), lambda w: F.length(w) >= p.lexical_length)
    rows = queries.select("query_id", found.alias("_w")).select("query_id", "_w", F.posexplode("_w").alias("position", "token"))
    return rows.select("query_id", "position", "token", F.concat_ws("-", "token", F.try_element_at("_w", F.col("position") + 2)).alias("_both"), (F.col("position") + 1 < F.size("_w")).alias("_more")).select(
        "query_id", "position", "token", F.when(F.col("_more"), F.col("_both")).alias("compound")
    )


def lexical_match(queries: DataFrame, tags: DataFrame, p: Params = Params()) -> DataFrame:
    """(query_id, tag_id) of the tags that a word of the query, or two in a row, name wholly or in part."""
    words = tokens(queries, p)
    terms = words.select("query_id", F.col("token").alias("term")).unionByName(words.filter("compound is not null").select("query_id", F.col("compound").alias("term"))).distinct()
    return terms.join(lexical_index(tags, p).select("term", "tag_id"), "term").select("query_id", "tag_id").distinct()


def score_lexical(queries: DataFrame, tags: DataFrame, tensor: DataFrame, memory_tags: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Memories (query_id, memory_id, score) by the words of the query in turn, and the seeds (query_id, tag_id).

    A word names its exact tag; a word without one names all compounds that it
    is part of, and a word that is part of more than twice as many compounds as
    it is a whole name names nothing.  Two words in a row name their compound.
    A word also names tags that earlier words have expanded to, if it is part
    of them.  New tags of a word fan out over the tensor before the next word
    is read, so all queries go word by word together: as many rounds as the
    longest query has words, and queries of the same words as one.  Seeds have score 1, other tags are scaled by the
    inward ratio, and memories have their best tag's score over the query's
    best memory.
    """
    index = cut(lexical_index(tags, p))
    sizes = index.groupBy("term").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("exact").cast("int")).alias("_e"))
    named = cut(index.join(sizes, "term").filter((F.col("_e") == 0) | (F.col("exact") & (F.col("_n") <= 2 * F.col("_e")))).select("term", "tag_id"))
    all_words = cut(tokens(queries, p))
    texts = all_words.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "token"))).alias("_w"))
    own = texts.groupBy("_w").agg(F.min("query_id").alias("_of"))
    of = cut(texts.join(own, "_w").select("query_id", "_of"))
    words = cut(all_words.join(of.select(F.col("_of").alias("query_id")).distinct(), "query_id", "left_semi"))
    rounds = words.agg(F.max("position")).first()[0]
    empty = words.select("query_id").join(index.select("tag_id"), how="cross").filter("false") if rounds is None else None
    if rounds is None:
        none = empty.select("query_id", "tag_id")
        return none.join(memory_tags, "tag_id").select("query_id", "memory_id", F.lit(0.0).alias("score")), none
    pair = ["query_id", "tag_id"]
    seeds = scores = None
    for position in range(rounds + 1):
        now = words.filter(F.col("position") == position)
        direct = now.join(named, F.col("token") == F.col("term")).select(*pair)
        direct = direct.unionByName(now.join(index, F.col("compound") == F.col("term")).select(*pair))
        if scores is not None:
            expanded = scores.select(*pair).join(seeds, pair, "left_anti")
            direct = direct.unionByName(now.join(index.select("term", "tag_id"), F.col("token") == F.col("term")).select(*pair).join(expanded, pair, "left_semi"))
        direct = direct.distinct()
        new = cut(direct if seeds is None else direct.join(seeds, pair, "left_anti"))
        seeds = new if seeds is None else cut(seeds.unionByName(new))
        found = walk(tensor, new, p=p)
        found = found if scores is None else scores.unionByName(found)
        scores = cut(found.groupBy(*pair).agg(F.max("score").alias("score")))
    whole = scores.unionByName(seeds.withColumn("score", F.lit(1.0))).groupBy(*pair).agg(F.max("score").alias("score"))
    kept = prune_by_inward(tensor, seeds, cut(whole), p=p)
    best = best_of_memories(memory_tags, cut(kept).withColumnRenamed("tag_id", "partner"))
    each, named = (of.join(x.withColumnRenamed("query_id", "_of"), "_of").drop("_of") for x in (best, seeds))
    return each.select("query_id", "memory_id", "score"), named.select("query_id", "tag_id")
