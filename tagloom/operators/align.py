"""Alignment of two projects' tag graphs by canonical names, the middle layer, and hidden bridges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.scalar import canonical_tag

LAYER_BONUS = {"shared-anchor": 0.35, "exact-pair": 0.30, "layer-crossing": 0.15}


def named_edges(edges: DataFrame, names: DataFrame, prefix: str = "") -> DataFrame:
    """Edges (a, b, layer, score) under canonical names x < y; of edges whose names collide the weakest stays."""
    na, nb = names.select(F.col("tag_id").alias("a"), canonical_tag(F.col("name"), prefix).alias("_x")), names.select(F.col("tag_id").alias("b"), canonical_tag(F.col("name"), prefix).alias("_y"))
    named = edges.join(na, "a").join(nb, "b").filter("_x <> _y").select(F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y"), "layer", "score")
    w = Window.partitionBy("x", "y").orderBy("score", "layer")
    return named.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def anchor_profiles(edges: DataFrame) -> DataFrame:
    """Share of each layer in the scores at each name: (anchor, layer, share)."""
    ends = edges.select(F.col("x").alias("anchor"), "layer", "score").unionByName(edges.select(F.col("y").alias("anchor"), "layer", "score"))
    sums = ends.groupBy("anchor", "layer").agg(F.sum("score").alias("s"))
    return sums.select("anchor", "layer", (F.col("s") / F.sum("s").over(Window.partitionBy("anchor"))).alias("share"))


def anchor_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells (anchor, layer_a, layer_b) of the names that both graphs have: product of the shares."""
    a = anchor_profiles(left).select("anchor", F.col("layer").alias("layer_a"), F.col("share").alias("_sa"))
    b = anchor_profiles(right).select("anchor", F.col("layer").alias("layer_b"), F.col("share").alias("_sb"))
    return a.join(b, "anchor").select(F.lit("anchor").alias("scope"), "anchor", "layer_a", "layer_b", (F.col("_sa") * F.col("_sb")).alias("score"))


def exact_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of names with an edge in both graphs: the smaller score."""
    a = left.select("x", "y", F.col("layer").alias("layer_a"), F.col("score").alias("_sa"))
    b = right.select("x", "y", F.col("layer").alias("layer_b"), F.col("score").alias("_sb"))
    return a.join(b, ["x", "y"]).select(F.lit("pair").alias("scope"), F.concat_ws("|", "x", "y").alias("anchor"), "layer_a", "layer_b", F.least("_sa", "_sb").alias("score"))


def alignment(left: DataFrame, right: DataFrame) -> DataFrame:
    return anchor_cells(left, right).unionByName(exact_pairs(left, right))


def layer_matrix(cells: DataFrame) -> DataFrame:
    """Sum and number of the cells of each pair of layers."""
    return cells.groupBy("scope", "layer_a", "layer_b").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("cells"))


def top_neighbours(edges: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` best neighbours of each name as one text."""
    ends = edges.select(F.col("x").alias("name"), F.col("y").alias("other"), "layer", "score").unionByName(edges.select(F.col("y").alias("name"), F.col("x").alias("other"), "layer", "score"))
    w = Window.partitionBy("name").orderBy(F.col("score").desc(), "other")
    ranked = ends.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
    listed = ranked.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("_rn", F.format_string("%s (%s)", "other", "layer").alias("t")))).alias("l"))
    return listed.select("name", F.concat_ws(", ", F.transform("l", lambda s: s["t"])).alias("neighbours"))


def lexical_score(terms: list[str], anchor: Column, layers: Column, text: Column) -> Column:
    """5 for each term in the anchor, 3 in the layers, 1 anywhere in the text."""
    parts = [F.when(F.lower(anchor).contains(t), 5).when(F.lower(layers).contains(t), 3).when(F.lower(text).contains(t), 1).otherwise(0) for t in terms]
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def query_terms(query: str) -> list[str]:
    """Words of a query of three letters or more, lower-cased, each once."""
    words = "".join(c if c.isalnum() or c in "-_" else " " for c in query.lower()).split()
    return list(dict.fromkeys(w for w in words if len(w) > 2))


def query_middle(cells: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Cells by lexical score and then score; without a hit for any term a cell isn't in."""
    terms = query_terms(query)
    lex = lexical_score(terms, F.col("anchor"), F.concat_ws(" ", "layer_a", "layer_b"), F.concat_ws(" ", "scope", "anchor", "layer_a", "layer_b"))
    found = cells.withColumn("lexical", lex)
    if terms:
        found = found.filter("lexical > 0")
    return found.orderBy(F.col("lexical").desc(), F.col("score").desc(), "anchor", "layer_a", "layer_b").limit(limit)


def hidden_bridges(raw: DataFrame, visible: DataFrame, limit: int = 50) -> DataFrame:
    """Cells of the raw alignment that the visible one lacks, with the reason and its bonus, by score."""
    keys = ["scope", "anchor", "layer_a", "layer_b"]
    only = raw.join(visible.select(*keys), keys, "left_anti")
    known = visible.select("anchor").distinct().withColumn("_known", F.lit(True))
    reason = F.when(F.col("_known"), "shared-anchor").when(F.col("scope") == "pair", "exact-pair").when(F.col("layer_a") != F.col("layer_b"), "layer-crossing").otherwise("raw-only")
    bonus = reduce(lambda c, kv: c.when(F.col("reason") == kv[0], kv[1]), list(LAYER_BONUS.items())[1:], F.when(F.col("reason") == "shared-anchor", LAYER_BONUS["shared-anchor"])).otherwise(0.10)
    scored = only.join(known, "anchor", "left").withColumn("reason", reason).withColumn("bridge_score", F.col("score") + bonus)
    return scored.select(*keys, "score", "reason", "bridge_score").orderBy(F.col("bridge_score").desc(), *keys).limit(limit)


def bridge_context(bridges: DataFrame) -> DataFrame:
    """Each bridge as a line of text."""
    return bridges.select(F.format_string("%s [%s] %s -> %s (%.3f)", "anchor", "reason", "layer_a", "layer_b", "bridge_score").alias("line"))
