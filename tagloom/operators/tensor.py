"""The tag-pair tensor: assembly of its layers, partner scores, inhibition, online reweighting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.scalar import ball_distance, exp_origin
from tagloom.functions.vectors import dot
from tagloom.operators.lineage import cut
from tagloom.params import Params

PAIR = ["tag_a_id", "tag_b_id"]
LAYERS = ["cooccurrence", "synchronicity", "semantic", "semiotic_forward", "semiotic_reverse", "glyph", "inhibition", "parallelness"]


def assemble(*layers: DataFrame) -> DataFrame:
    """One row a pair from tables of (tag_a_id, tag_b_id, some layers); absent layers are 0."""
    keys = layers[0].select(*PAIR)
    for layer in layers[1:]:
        keys = keys.unionByName(layer.select(*PAIR))
    out, have = keys.distinct(), set()
    for layer in layers:
        columns = [c for c in LAYERS if c in layer.columns and c not in have]
        have |= set(columns)
        out = out.join(layer.select(*PAIR, *columns), PAIR, "left")
    return out.select(*PAIR, *[F.coalesce(c, F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in LAYERS])


def semantic_layer(projected: DataFrame, gate: DataFrame) -> DataFrame:
    """exp(-hyperbolic distance) of the gated pairs' points; projected: (tag_id, point) in the plane, gate: pairs a < b."""
    ball = projected.select("tag_id", exp_origin(F.col("point")).alias("p"))
    joined = gate.join(ball.select(F.col("tag_id").alias("tag_a_id"), F.col("p").alias("_a")), "tag_a_id").join(ball.select(F.col("tag_id").alias("tag_b_id"), F.col("p").alias("_b")), "tag_b_id")
    return joined.select(*PAIR, F.exp(-ball_distance(F.col("_a"), F.col("_b"))).alias("semantic")).filter("semantic > 1e-6")


def principal_plane(vectors: DataFrame, column: str = "centroid", seed: int = 7) -> list[list[float]]:
    """Two principal directions, the largest component of each positive; a seeded random plane for fewer than 20 vectors.

    The d x d covariance is summed in Spark; only it comes to the driver.
    """
    import numpy as np

    n = vectors.count()
    if n == 0:
        return []
    d = vectors.select(F.size(column).alias("d")).first()["d"]
    if n < 20:
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, 2)))[0].T
    else:
        x = vectors.select(F.transform(column, lambda v: v.cast("double")).alias("v"))
        mean = x.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").toPandas()["m"].to_numpy()
        outer = x.select(F.posexplode("v").alias("i", "a"), "v").select("i", "a", F.posexplode("v").alias("j", "b"))
        sums = outer.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s")).toPandas()
        second = np.zeros((d, d))
        second[sums["i"], sums["j"]] = sums["s"] / n
        basis = np.linalg.eigh(second - np.outer(mean, mean))[1][:, ::-1][:, :2].T
    return [(v * np.sign(v[np.abs(v).argmax()])).tolist() for v in basis]


def project(vectors: DataFrame, plane: list[list[float]], column: str = "centroid") -> DataFrame:
    """Coordinates in the plane, as ``point``."""
    axes = [F.array(*[F.lit(x) for x in axis]) for axis in plane]
    return vectors.withColumn("point", F.array(*[dot(F.col(column), a) for a in axes]))


def held(p: Params = Params()) -> Column:
    """What inhibition takes of an antiparallel edge."""
    return F.when((F.col("inhibition") > 0) & (F.col("parallelness") < 0), p.weight_inhibition * F.col("inhibition") * -F.col("parallelness")).otherwise(0.0)


def per_query(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The rows with a query_id, 0 where they have none, and whether they had none."""
    return (rows, False) if "query_id" in rows.columns else (rows.withColumn("query_id", F.lit(0)), True)


def contexts(*sides: DataFrame) -> tuple[DataFrame, ...]:
    """(query_id, _of), and for each side its rows (query_id, tag_id) of one query for all that have the same sets; _of names that query.

    What depends on the sets alone is computed once for each different context.
    Queries that one of the sides lacks are left out.
    """
    names = [f"_t{i}" for i in range(len(sides))]
    sets = None
    for side, name in zip(sides, names, strict=True):
        one = side.groupBy("query_id").agg(F.sort_array(F.collect_set("tag_id")).alias(name))
        sets = one if sets is None else sets.join(one, "query_id")
    sets = cut(sets)
    own = sets.groupBy(*names).agg(F.min("query_id").alias("_of"))
    return sets.join(own, names).select("query_id", "_of"), *[own.select(F.col("_of").alias("query_id"), F.explode(name).alias("tag_id")) for name in names]


def by_context(context: DataFrame, candidates: DataFrame, channel: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """channel(context, candidates) of (query_id, tag_id) and (query_id, memory_id, tag_id), whose scores depend on the query's context only.

    It runs once for each different context: candidates of queries that share one are told apart by both their ids.
    """
    of, own = contexts(context)
    rows = candidates.join(of, "query_id").select(F.col("_of").alias("query_id"), F.struct("query_id", "memory_id").alias("memory_id"), "tag_id")
    out = channel(own, rows)
    return out.select("memory_id.query_id", "memory_id.memory_id", *[c for c in out.columns if c not in ("query_id", "memory_id")])


def direct_score(p: Params = Params()) -> Column:
    """Weighted sum of an edge's layers, the bonus of synchronicity with glyph, less active inhibition."""
    sync, glyph = F.col("synchronicity"), F.col("glyph")
    both = F.when((sync > 0) & (glyph > 0), p.weight_meta * sync * glyph).otherwise(0.0)
    return p.weight_cooccurrence * F.col("cooccurrence") + p.weight_synchronicity * sync + p.weight_semantic * F.col("semantic") + p.weight_glyph * glyph + both - held(p)


def directed(tensor: DataFrame) -> DataFrame:
    """Both directions of every edge: (source, target, strength) of what signifies what."""
    forward = tensor.select(F.col("tag_a_id").alias("source"), F.col("tag_b_id").alias("target"), F.col("semiotic_forward").alias("strength"))
    return forward.unionByName(tensor.select(F.col("tag_b_id").alias("source"), F.col("tag_a_id").alias("target"), F.col("semiotic_reverse").alias("strength")))


def signifies(tensor: DataFrame, seeds: DataFrame, least: float = 0.05, inverse: bool = False) -> DataFrame:
    """Tags that the seeds (tag_id) signify, or that signify them, stronger than ``least``."""
    key = "target" if inverse else "source"
    return directed(tensor).filter(F.col("strength") > least).join(seeds.select(F.col("tag_id").alias(key)).distinct(), key, "left_semi")


def touching(tensor: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, partner, edge columns) of the edges at each seed, from either end; with query_id where seeds have it."""
    by = ["query_id"] if "query_id" in seeds.columns else []
    s = seeds.select(*by, F.col("tag_id").alias("seed")).distinct()
    rest = [c for c in tensor.columns if c not in PAIR]
    a = tensor.join(s, F.col("tag_a_id") == F.col("seed")).select(*by, "seed", F.col("tag_b_id").alias("partner"), *rest)
    return a.unionByName(tensor.join(s, F.col("tag_b_id") == F.col("seed")).select(*by, "seed", F.col("tag_a_id").alias("partner"), *rest))


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("tag_a_id").alias("tag_id")).unionByName(edges.select(F.col("tag_b_id").alias("tag_id")))
    return ends.groupBy("tag_id").agg(F.count(F.lit(1)).alias("degree"))


def in_through_out(tensor: DataFrame, seeds: DataFrame, p: Params = Params()) -> DataFrame:
    """(query_id, tag_id, strength, paths, score) of siblings: tags that a signifier of the seeds signifies too.

    A path's strength is the product of its two edges', the first the strongest
    from its signifier into the query.  Seeds and signifiers are no siblings.
    score is the best path times 1 + ln(paths).
    """
    seeds, single = per_query(seeds)
    s = seeds.select("query_id", "tag_id").distinct()
    d = directed(tensor).filter(F.col("strength") > p.min_semiotic)
    into = s.join(d, F.col("tag_id") == F.col("target")).groupBy("query_id", F.col("source").alias("_v")).agg(F.max("strength").alias("_in"))
    via = into.join(s.withColumnRenamed("tag_id", "_v"), ["query_id", "_v"], "left_anti")
    out = via.join(d, F.col("_v") == F.col("source")).select("query_id", F.col("target").alias("tag_id"), "_v", (F.col("_in") * F.col("strength")).alias("_path"))
    out = out.join(s, ["query_id", "tag_id"], "left_anti").join(via.select("query_id", F.col("_v").alias("tag_id")), ["query_id", "tag_id"], "left_anti")
    out = out.groupBy("query_id", "tag_id").agg(F.max("_path").alias("strength"), F.count(F.lit(1)).alias("paths"))
    out = out.withColumn("score", F.col("strength") * (1 + F.log(F.col("paths").cast("double"))))
    return out.drop("query_id") if single else out


def gated(partners: DataFrame, seeds: DataFrame, co_retrieval: DataFrame | None, p: Params = Params()) -> DataFrame:
    """Partners (query_id, partner, score) with a co-retrieval edge of ``min_edge`` to a seed; all where a query has no such partner.

    co_retrieval: (tag_a_id, tag_b_id, strength).
    """
    if co_retrieval is None:
        return partners
    met = touching(co_retrieval.filter(F.col("strength") >= p.min_edge).select(*PAIR), seeds).select("query_id", "partner").distinct()
    marked = partners.join(met.withColumn("_in", F.lit(True)), ["query_id", "partner"], "left")
    some = F.max(F.coalesce("_in", F.lit(False))).over(Window.partitionBy("query_id"))
    return marked.withColumn("_some", some).filter(F.coalesce("_in", F.lit(False)) | ~F.col("_some")).select("query_id", "partner", "score")


def partner_scores(tensor: DataFrame, seeds: DataFrame, co_retrieval: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """(query_id, partner, score): the best score of every partner of the seeds, itself no seed, of min_tensor at least.

    Siblings (``in_through_out``) count at ``weight_directed`` of their score.
    Partners have to pass the gate of ``gated``.  Without query_id in ``seeds``
    the result has none.
    """
    seeds, single = per_query(seeds)
    own = seeds.select("query_id", F.col("tag_id").alias("partner")).distinct()
    edges = touching(tensor.withColumn("_s", direct_score(p)), seeds).filter(F.col("_s") >= p.min_tensor).select("query_id", "partner", F.col("_s").alias("score"))
    siblings = in_through_out(tensor, seeds, p).select("query_id", F.col("tag_id").alias("partner"), (p.weight_directed * F.col("score")).alias("score"))
    best = edges.unionByName(siblings).join(own, ["query_id", "partner"], "left_anti").groupBy("query_id", "partner").agg(F.max("score").alias("score"))
    out = gated(best, seeds, co_retrieval, p)
    return out.drop("query_id") if single else out


def inhibition_score(tensor: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sum of inhibition * max(0, -parallelness) over the pairs (a < b)."""
    return tensor.join(pairs.select(*PAIR).distinct(), PAIR, "left_semi").agg(F.coalesce(F.sum(F.col("inhibition") * F.greatest(F.lit(0.0), -F.col("parallelness"))), F.lit(0.0)).alias("inhibition_score"))


def best_of_memories(memory_tags: DataFrame, partners: DataFrame) -> DataFrame:
    """(query_id, memory_id, score): each memory's best partner, over the best of the query.

    memory_tags: (memory_id, tag_id), or (query_id, memory_id, tag_id) for the
    candidates of each query; then the best is that of the partners, as scores
    of candidates are.  Without query_id in ``partners`` the result has none.
    """
    partners, single = per_query(partners)
    scored = partners.select("query_id", F.col("partner").alias("tag_id"), "score")
    if "query_id" in memory_tags.columns:
        top = scored.withColumn("_top", F.max("score").over(Window.partitionBy("query_id")))
        best = memory_tags.join(top, ["query_id", "tag_id"]).groupBy("query_id", "memory_id").agg(F.max("score").alias("s"), F.first("_top").alias("_top"))
    else:
        best = memory_tags.join(scored, "tag_id").groupBy("query_id", "memory_id").agg(F.max("score").alias("s"))
        held_tags = scored.join(memory_tags.select("tag_id").distinct(), "tag_id", "left_semi")  # the best memory has the best of these
        best = best.join(held_tags.groupBy("query_id").agg(F.max("score").alias("_top")), "query_id")
    out = best.select("query_id", "memory_id", F.when(F.col("_top") > 0, F.col("s") / F.col("_top")).otherwise(0.0).alias("score"))
    return out.drop("query_id") if single else out


def glyph_associations(tensor: DataFrame, seeds: DataFrame, memory_tags: DataFrame, co_retrieval: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """Memories by glyph edges of the seeds: glyph + 0.3 co-occurrence less active inhibition, where positive.

    Edges between two seeds don't count; partners pass the gate of ``gated``
    and are resolved as in ``best_of_memories``.
    """
    if "query_id" in seeds.columns and "query_id" in memory_tags.columns:
        return by_context(seeds, memory_tags, lambda own, rows: _glyph_associations(tensor, own, rows, co_retrieval, p))
    return _glyph_associations(tensor, seeds, memory_tags, co_retrieval, p)


def _glyph_associations(tensor: DataFrame, seeds: DataFrame, memory_tags: DataFrame, co_retrieval: DataFrame | None, p: Params) -> DataFrame:
    seeds, single = per_query(seeds)
    own = seeds.select("query_id", F.col("tag_id").alias("partner")).distinct()
    score = F.col("glyph") + 0.3 * F.col("cooccurrence") - held(p)
    edges = touching(tensor.filter("glyph > 0").withColumn("_s", score), seeds).filter("_s > 0")
    best = edges.join(own, ["query_id", "partner"], "left_anti").groupBy("query_id", "partner").agg(F.max("_s").alias("score"))
    out = best_of_memories(memory_tags, gated(best, seeds, co_retrieval, p))
    return out.drop("query_id") if single else out


def edge_ema(pairs: DataFrame, alpha: float = 0.15) -> DataFrame:
    """Edge weight after n equal signals: 1 - (1 - alpha) ** n; pairs: (tag_a_id, tag_b_id, cnt)."""
    return pairs.select(*PAIR, "cnt", (1 - F.pow(F.lit(1 - alpha), F.col("cnt"))).alias("strength"))


def rank_invert(pairs: DataFrame) -> DataFrame:
    """Strengths in descending order beside the same list reversed; pairs: (tag_a_id, tag_b_id, strength) of one retrieval."""
    down = Window.orderBy(F.col("strength").desc(), *PAIR)
    numbered = pairs.withColumn("rank", F.row_number().over(down).cast("long"))
    size = pairs.agg(F.count(F.lit(1)).alias("_n"))
    other = numbered.select(F.col("rank").alias("_r"), F.col("strength").alias("inverted"))
    return numbered.crossJoin(F.broadcast(size)).join(other, F.col("_r") == F.col("_n") + 1 - F.col("rank")).select(*PAIR, "strength", "rank", "inverted")


def prefix_parallelness(ranked: DataFrame, directions: DataFrame) -> DataFrame:
    """For each pair the largest |cos| to a pair of better rank, 0 for the first.

    ranked: pairs with rank (of one retrieval, a few dozen); directions: (tag_id, centroid).
    """
    a = directions.select(F.col("tag_id").alias("tag_a_id"), F.col("centroid").alias("_a"))
    b = directions.select(F.col("tag_id").alias("tag_b_id"), F.col("centroid").alias("_b"))
    d = ranked.join(a, "tag_a_id").join(b, "tag_b_id").withColumn("_d", F.zip_with("_a", "_b", lambda x, y: y.cast("double") - x.cast("double")))
    d = d.withColumn("_n", F.sqrt(dot(F.col("_d"), F.col("_d"))))
    better = d.select(F.col("rank").alias("_r"), F.col("_d").alias("_e"), F.col("_n").alias("_m"))
    cos = F.when((F.col("_n") > 0) & (F.col("_m") > 0), F.abs(dot(F.col("_d"), F.col("_e")) / (F.col("_n") * F.col("_m")))).otherwise(0.0)
    found = d.join(better, F.col("_r") < F.col("rank"), "left").groupBy(*PAIR, "rank").agg(F.max(F.coalesce(cos, F.lit(0.0))).alias("parallelness"))
    return found.select(*PAIR, "rank", "parallelness")


def symbolic_bonus(pairs: DataFrame, glyphs: DataFrame, known: DataFrame) -> DataFrame:
    """Factor of each pair: 2 with the same glyph, 1.5 for a known pair of glyphs, else 1.

    glyphs: (tag_id, glyph); known: (glyph_a, glyph_b, relation), read in either order.
    """
    a, b = glyphs.select(F.col("tag_id").alias("tag_a_id"), F.col("glyph").alias("ga")), glyphs.select(F.col("tag_id").alias("tag_b_id"), F.col("glyph").alias("gb"))
    k = known.select(F.least("glyph_a", "glyph_b").alias("_x"), F.greatest("glyph_a", "glyph_b").alias("_y"), "relation").distinct()
    joined = pairs.join(a, "tag_a_id", "left").join(b, "tag_b_id", "left").join(F.broadcast(k), (F.least("ga", "gb") == F.col("_x")) & (F.greatest("ga", "gb") == F.col("_y")), "left")
    factor = F.when(F.col("ga") == F.col("gb"), 2.0).when(F.col("relation").isNotNull(), 1.5).otherwise(1.0)
    return joined.select(*PAIR, F.col("relation"), factor.alias("factor"))


def cross_reference(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Layers that known relations of glyphs give to tag pairs (tag_a_id, tag_b_id, cnt; relation of the pair).

    Opposition inhibits (0.5) and is meant (0.6); transformation is meant (0.7);
    co-occurrence is the logistic of ln(1 + n) - 2.
    """
    joined = pairs.join(relations, PAIR)
    return joined.select(
        *PAIR,
        (1 / (1 + F.exp(-(F.log1p(F.col("cnt").cast("double")) - 2)))).alias("cooccurrence"),
        F.when(F.col("relation") == "opposition", 0.6).when(F.col("relation") == "transformation", 0.7).otherwise(0.0).alias("semantic"),
        F.when(F.col("relation") == "opposition", 0.5).otherwise(0.0).alias("inhibition"),
    )


def apply_deltas(tensor: DataFrame, deltas: DataFrame, alpha: float = 0.15) -> DataFrame:
    """EMA of inhibition and parallelness of the pairs that the tensor has; others aren't made."""
    d = deltas.select(*PAIR, F.col("inhibition").alias("_i"), F.col("parallelness").alias("_p"))
    joined = tensor.join(d, PAIR, "left")
    new = {c: F.when(F.col(x).isNull(), F.col(c)).otherwise(alpha * F.col(x) + (1 - alpha) * F.col(c)) for c, x in (("inhibition", "_i"), ("parallelness", "_p"))}
    return joined.withColumns(new).drop("_i", "_p")


def place(projected: DataFrame, id_col: str = "tag_id") -> DataFrame:
    """Angle in [0, 2 pi) and radius (tanh of the length) of points in the plane."""
    x, y = F.element_at("point", 1), F.element_at("point", 2)
    return projected.select(id_col, F.pmod(F.atan2(y, x), F.lit(6.283185307179586)).alias("angle"), F.tanh(F.sqrt(x * x + y * y)).alias("radius"))


def network(phase: DataFrame, trend: DataFrame, pairs: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (quadrant, temperature, events) and edges (pairs in ``least`` baskets at least) of a picture of the network."""
    nodes = phase.select("tag_id", "quadrant", "temperature").join(trend.select("tag_id", "event_count"), "tag_id", "left").fillna({"event_count": 0})
    return nodes, pairs.filter(F.col("cnt") >= least)
