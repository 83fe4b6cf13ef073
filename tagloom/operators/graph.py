"""Retrieval over the tag graph: fan-out, inward ratio, convergence, hub filter, components, hybrid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.lineage import cut
from tagloom.operators.tensor import by_context, contexts, degree, direct_score, directed, per_query, touching
from tagloom.params import Params


def _both(tensor: DataFrame, *columns: Column | str) -> DataFrame:
    """(source, partner, columns) of each edge, from either end."""
    ends = [("tag_a_id", "tag_b_id"), ("tag_b_id", "tag_a_id")]
    one, two = (tensor.select(F.col(x).alias("source"), F.col(y).alias("partner"), *columns) for x, y in ends)
    return one.unionByName(two)


def fan_out(tensor: DataFrame, seeds: DataFrame, depth: int | None = None, p: Params = Params()) -> DataFrame:
    """(query_id, tag_id, score) of the tags that a breadth-first walk over the edges finds from the seeds.

    An edge counts by its direct score, halved at each further hop, of
    ``min_tensor`` at least; a tag counts where it is first found.  Scores are
    divided by the tag's number of edges, so that hubs don't stand out.

    seeds: (tag_id), or (query_id, tag_id) for many queries at once; without
    query_id the result has none.  Seeds aren't in the result.  Queries with
    the same seeds walk once.
    """
    seeds, single = per_query(seeds)
    of, own = contexts(seeds)
    out = of.join(walk(tensor, own, depth, p).withColumnRenamed("query_id", "_of"), "_of").select("query_id", "tag_id", "score")
    return out.drop("query_id") if single else out


def walk(tensor: DataFrame, seeds: DataFrame, depth: int | None = None, p: Params = Params()) -> DataFrame:
    """``fan_out`` of each query (query_id, tag_id) by itself."""
    edges = _both(tensor, direct_score(p).alias("_s"))
    visited = front = seeds.select("query_id", "tag_id").distinct()
    found = None
    for hop in range(p.fan_depth if depth is None else depth):
        met = front.join(edges, F.col("tag_id") == F.col("source")).withColumn("_s", F.col("_s") * 0.5**hop).filter(F.col("_s") >= p.min_tensor)
        new = met.groupBy("query_id", F.col("partner").alias("_t")).agg(F.max("_s").alias("score")).withColumnRenamed("_t", "tag_id").join(visited, ["query_id", "tag_id"], "left_anti")
        new = cut(new.select("query_id", "tag_id", "score"))
        found = new if found is None else found.unionByName(new)
        front = new.select("query_id", "tag_id")
        visited = visited.unionByName(front)
    if found is None:
        found = front.filter("false").withColumn("score", F.lit(0.0))
    size = degree(tensor).select("tag_id", F.greatest("degree", F.lit(1)).alias("_d"))
    return found.join(size, "tag_id").select("query_id", "tag_id", (F.col("score") / F.col("_d")).alias("score"))


def inward_ratio(tensor: DataFrame, seeds: DataFrame, scores: DataFrame, depth: int | None = None, p: Params = Params()) -> DataFrame:
    """(query_id, tag_id, score, convergence, inward, ratio) of the scored tags that aren't seeds.

    convergence: share of the query's seeds that reach the tag over scored tags
    in ``depth`` hops.  inward: edges to seeds over all edges.  ratio is their
    product.  Queries with the same seeds and the same scored tags walk once.
    """
    seeds, _ = per_query(seeds)
    scores, single = per_query(scores)
    of, seeds, scored = contexts(seeds.select("query_id", "tag_id"), scores.select("query_id", "tag_id"))
    edges = _both(tensor)
    inside = scored.select("query_id", F.col("tag_id").alias("partner")).unionByName(seeds.select("query_id", F.col("tag_id").alias("partner"))).distinct()
    reached = front = seeds.select("query_id", "tag_id", F.col("tag_id").alias("seed"))
    visited = seeds
    for _ in range(p.fan_depth if depth is None else depth):
        step = front.join(edges, F.col("tag_id") == F.col("source")).select("query_id", "partner", "seed").join(inside, ["query_id", "partner"], "left_semi")
        step = cut(step.select("query_id", F.col("partner").alias("tag_id"), "seed").distinct())
        reached = reached.unionByName(step)
        front = step.join(visited, ["query_id", "tag_id"], "left_anti")
        visited = visited.unionByName(front.select("query_id", "tag_id").distinct())
    of_query = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    meet = reached.distinct().groupBy("query_id", "tag_id").agg(F.count(F.lit(1)).alias("_c"))
    to_seeds = seeds.join(edges, F.col("tag_id") == F.col("source")).groupBy("query_id", F.col("partner").alias("_t")).agg(F.count(F.lit(1)).alias("_e")).withColumnRenamed("_t", "tag_id")
    rest = scored.join(seeds, ["query_id", "tag_id"], "left_anti")
    out = rest.join(of_query, "query_id").join(meet, ["query_id", "tag_id"], "left").join(to_seeds, ["query_id", "tag_id"], "left").join(degree(tensor), "tag_id", "left")
    none = F.lit(0)
    out = out.withColumns({"convergence": F.coalesce("_c", none) / F.col("_n"), "inward": F.when(F.col("degree") > 0, F.coalesce("_e", none) / F.col("degree")).otherwise(0.0)})
    out = out.select(F.col("query_id").alias("_of"), "tag_id", "convergence", "inward", (F.col("convergence") * F.col("inward")).alias("ratio"), "_n")
    out = scores.select("query_id", "tag_id", "score").join(of, "query_id").join(out, ["_of", "tag_id"]).drop("_of").select("query_id", "tag_id", "score", "convergence", "inward", "ratio", "_n")
    return out.drop("query_id") if single else out


def prune_by_inward(tensor: DataFrame, seeds: DataFrame, scores: DataFrame, depth: int | None = None, p: Params = Params()) -> DataFrame:
    """Scores times the inward ratio, of ``min_inward`` * sqrt(seeds / 4) at least; seeds keep their score."""
    seeds, single = per_query(seeds)
    scores, _ = per_query(scores)
    kept = scores.join(seeds.select("query_id", "tag_id").distinct(), ["query_id", "tag_id"], "left_semi").select("query_id", "tag_id", "score")
    rest = inward_ratio(tensor, seeds, scores, depth, p).filter(F.col("ratio") >= p.min_inward * F.sqrt(F.col("_n") / 4))
    out = kept.unionByName(rest.select("query_id", "tag_id", (F.col("score") * F.col("ratio")).alias("score")))
    return out.drop("query_id") if single else out


def semiotic_convergence(tensor: DataFrame, seeds: DataFrame, memory_tags: DataFrame, p: Params = Params()) -> DataFrame:
    """(query_id, memory_id, convergence): how often what the query's tags signify signifies a memory's tags in turn.

    Tags of the query count neither on the way nor at the memory; memories
    without such a path aren't in the result.  Paths are counted, whatever
    their strength above ``min_semiotic``.  memory_tags: (memory_id, tag_id),
    or (query_id, memory_id, tag_id) for candidates of each query.
    """
    if "query_id" in seeds.columns and "query_id" in memory_tags.columns:
        return by_context(seeds, memory_tags, lambda own, rows: _convergence(tensor, own, rows, p))
    return _convergence(tensor, seeds, memory_tags, p)


def _convergence(tensor: DataFrame, seeds: DataFrame, memory_tags: DataFrame, p: Params) -> DataFrame:
    seeds, single = per_query(seeds)
    s = seeds.select("query_id", "tag_id").distinct()
    d = directed(tensor).filter(F.col("strength") > p.min_semiotic).select("source", "target")
    middle = s.join(d, F.col("tag_id") == F.col("source")).select("query_id", F.col("target").alias("tag_id")).distinct().join(s, ["query_id", "tag_id"], "left_anti")
    ends = middle.join(d, F.col("tag_id") == F.col("source")).groupBy("query_id", F.col("target").alias("_t")).agg(F.count(F.lit(1)).alias("_c")).withColumnRenamed("_t", "tag_id").join(s, ["query_id", "tag_id"], "left_anti")
    on = ["query_id", "tag_id"] if "query_id" in memory_tags.columns else ["tag_id"]
    out = memory_tags.join(ends, on).groupBy("query_id", "memory_id").agg(F.sum("_c").cast("double").alias("convergence"))
    return out.drop("query_id") if single and "query_id" not in memory_tags.columns else out


def filter_hubs(tensor: DataFrame, context: DataFrame, seeds: DataFrame, most: int = 25) -> DataFrame:
    """Context tags with no more than ``most`` edges to seeds; one without any stays.  With query_id, each query by itself."""
    context, single = per_query(context)
    seeds, _ = per_query(seeds)
    edges = touching(tensor.select("tag_a_id", "tag_b_id"), context).join(seeds.select("query_id", F.col("tag_id").alias("partner")).distinct(), ["query_id", "partner"], "left_semi")
    hubs = edges.groupBy("query_id", F.col("seed").alias("tag_id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    out = context.join(hubs, ["query_id", "tag_id"], "left_anti")
    return out.drop("query_id") if single else out


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) of edges (a, b), the smallest node of each: labels and pointers in turn, cut by checkpoints."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_m"))
        step = labels.join(near, "node").select("node", F.least("component", "_m").alias("component"), F.col("component").alias("_old"))
        jump = step.select(F.col("node").alias("_p"), F.col("component").alias("_to"))
        new = cut(step.join(jump, F.col("component") == F.col("_p")).select("node", F.least("component", "_to").alias("component"), "_old"))
        labels = new.select("node", "component")
        if new.filter("component <> _old").isEmpty():
            return labels
    raise RuntimeError(f"components unfinished after {max_rounds} rounds")


#: Weights of the channels of retrieval; similarity and tags have theirs in Params.
CHANNEL_WEIGHTS = {"lexical": 0.15, "resonant": 0.15, "glyph": 0.10, "convergence": 0.12}


def hybrid(channels: dict[str, DataFrame], k: int, params: Params = Params()) -> DataFrame:
    """Sum of weighted channels, the k best memories of each query.

    channels: name -> (query_id, memory_id, score) for similarity, tags,
    lexical, resonant, glyph, convergence.  Tags count by the similarity of the
    memory, convergence over the best of the query.  A memory of any channel
    is a candidate.
    """
    parts = []
    for name, c in channels.items():
        c = c.select("query_id", "memory_id", *(["score"] if name != "tags" else []))
        if name == "similarity":
            c = c.withColumn("score", params.weight_similarity * F.col("score"))
        elif name == "tags":
            c = channels["similarity"].select("query_id", "memory_id", (params.weight_tags * F.col("score")).alias("score")).join(c.distinct(), ["query_id", "memory_id"], "left_semi")
        elif name == "convergence":
            top = F.max("score").over(Window.partitionBy("query_id"))
            c = c.withColumn("_top", top).filter("_top > 0").select("query_id", "memory_id", (CHANNEL_WEIGHTS[name] * F.col("score") / F.col("_top")).alias("score"))
        else:
            c = c.withColumn("score", CHANNEL_WEIGHTS[name] * F.col("score"))
        parts.append(c)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    scored = out.groupBy("query_id", "memory_id").agg(F.round(F.sum("score"), 9).alias("score"))  # sums in any order rank alike
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "memory_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def deep_retrieve(start: DataFrame, similar: DataFrame, decay_of: DataFrame, levels: int = 3, per_level: int = 5, damping: float = 0.7, novelty: float = 0.3) -> DataFrame:
    """Results of a retrieval, and of what is similar to them, level by level.

    start: (memory_id, score).  similar: (a, b, similarity) edges between
    memories.  decay_of: (memory_id, decay) of salience.  At depth d a memory
    scores similarity * damping^d * (1 + novelty * d * (1 - decay)); a memory
    counts where it was first seen, also if the level's cut dropped it.  With a
    query_id in ``start``, each query goes its own way.
    """
    by = ["query_id"] if "query_id" in start.columns else []
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "memory_id")
    level = start.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_level).select(*by, "memory_id", "score", F.lit(0).alias("depth"))
    seen, out = start.select(*by, "memory_id"), level
    for depth in range(1, levels + 1):
        near = level.select(*by, F.col("memory_id").alias("a")).join(similar, "a").groupBy(*by, F.col("b").alias("memory_id")).agg(F.max("similarity").alias("_s"))
        fresh = near.join(seen, [*by, "memory_id"], "left_anti").join(decay_of, "memory_id", "left").fillna({"decay": 0.0})
        scored = fresh.select(*by, "memory_id", (F.col("_s") * damping**depth * (1 + novelty * depth * (1 - F.col("decay")))).alias("score"))
        seen = seen.unionByName(scored.select(*by, "memory_id"))
        level = cut(scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_level).select(*by, "memory_id", "score", F.lit(depth).alias("depth")))
        out = out.unionByName(level)
    return out
