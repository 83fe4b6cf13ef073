"""Retrieval from the query to its memories: words, vectors, tags, partners, glyphs, convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.vectors import dot
from tagloom.operators.graph import filter_hubs, hybrid, semiotic_convergence
from tagloom.operators.lexical import score_lexical
from tagloom.operators.lineage import cut
from tagloom.operators.tensor import best_of_memories, by_context, glyph_associations, partner_scores
from tagloom.operators.vector_search import top_k_blocks
from tagloom.params import Params


def centroid_match(queries: DataFrame, centroids: DataFrame, threshold: float) -> DataFrame:
    """(query_id, tag_id) of the tags whose centroid has an inner product of ``threshold`` with the query; in blocks of queries."""
    vectors = centroids.select(F.col("tag_id").alias("memory_id"), F.lit(0).alias("chunk_index"), F.col("centroid").alias("embedding"))
    n = max(1, centroids.count())
    return top_k_blocks(queries, vectors, n, threshold, overfetch=1).select("query_id", F.col("memory_id").alias("tag_id"))


def episodic_path(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, memory_id, score): the best sum of channels of an edge, not archived, from a seed memory to one that is none."""
    score = (F.col("semantic") + F.col("projected") + F.col("co_retrieval") + F.col("bridge")).alias("score")
    live = edges.filter("status <> 'archived'")
    both = live.select(F.col("memory_a").alias("_m"), F.col("memory_b").alias("memory_id"), score).unionByName(live.select(F.col("memory_b").alias("_m"), F.col("memory_a").alias("memory_id"), score))
    met = seeds.select("query_id", F.col("memory_id").alias("_m")).join(both, "_m").groupBy("query_id", "memory_id").agg(F.max("score").alias("score"))
    return met.join(seeds.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")


def resonant(tensor: DataFrame, context: DataFrame, candidate_tags: DataFrame, co_retrieval: DataFrame | None, edges: DataFrame | None, seeds: DataFrame, p: Params = Params()) -> DataFrame:
    """Candidates by partner tags of the context, plus episodic neighbours of the seeds, over the query's best."""
    out = by_context(context, candidate_tags, lambda own, rows: best_of_memories(rows, partner_scores(tensor, own, co_retrieval, p)))
    if edges is not None:
        out = out.unionByName(episodic_path(edges, seeds)).groupBy("query_id", "memory_id").agg(F.sum("score").alias("score"))
    top = F.max("score").over(Window.partitionBy("query_id"))
    return out.withColumn("_top", top).filter("_top > 0").select("query_id", "memory_id", (F.col("score") / F.col("_top")).alias("score"))


def retrieve(queries: DataFrame, vectors: DataFrame, memory_tags: DataFrame, tags: DataFrame, tensor: DataFrame, centroids: DataFrame, co_retrieval: DataFrame | None = None, edges: DataFrame | None = None, query_tags: DataFrame | None = None, k: int = 10, p: Params = Params()) -> DataFrame:
    """(query_id, memory_id, score, rank): the k best memories of each query (query_id, text, embedding).

    Words of the text score memories by tag names; the embedding fetches 3 k
    candidates (5 k where query_tags are given).  Tags of the five best, less
    hubs, are the context: their partners, glyph edges and semiotic convergence
    score the candidates further.  query_tags: (query_id, tag_id).
    """
    lexical, words = score_lexical(queries.select("query_id", "text"), tags, tensor, memory_tags, p)
    found = cut(top_k_blocks(queries, vectors, k * (5 if query_tags is not None else 3), p.similarity_threshold).select("query_id", "memory_id", "score", "rank"))
    channels = {"similarity": found, "lexical": lexical}
    if query_tags is not None:
        channels["tags"] = query_tags.join(memory_tags, "tag_id").select("query_id", "memory_id").distinct()
    candidate_tags = cut(found.select("query_id", "memory_id").join(memory_tags, "memory_id").select("query_id", "memory_id", "tag_id"))
    first = found.filter(F.col("rank") <= p.context_memories).select("query_id", "memory_id")
    context = candidate_tags.join(first, ["query_id", "memory_id"], "left_semi").select("query_id", "tag_id").distinct()
    seeds = words.select("query_id", "tag_id").unionByName(centroid_match(queries, centroids, p.context_threshold)).distinct()
    context = cut(filter_hubs(tensor, context, seeds, p.hub_degree))
    channels["resonant"] = resonant(tensor, context, candidate_tags, co_retrieval, edges, first, p)
    channels["glyph"] = glyph_associations(tensor, context, candidate_tags, co_retrieval, p)
    channels["convergence"] = semiotic_convergence(tensor, context, candidate_tags, p).withColumnRenamed("convergence", "score")
    return hybrid(channels, k, p)
