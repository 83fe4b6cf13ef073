"""Queries of the tensor, graph, motif, episode, flow, alignment, document and stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import scalar as S
from tagloom.operators import align as A
from tagloom.operators import directional as D
from tagloom.operators import episodes as E
from tagloom.operators import episodic as EP
from tagloom.operators import forest as FO
from tagloom.operators import graph as G
from tagloom.operators import lexical as LX
from tagloom.operators import memory as M
from tagloom.operators import motifs as MO
from tagloom.operators import retrieval as RE
from tagloom.operators import tensor as T
from tagloom.operators import text as X
from tagloom.operators import trends as TR
from tagloom.operators import vector_search as VS
from tagloom.operators.lineage import cut
from tagloom.plans.catalog import P, all_queries, query
from tagloom.sources import sinks as SK

# ---- tensor -------------------------------------------------------------------------------------

_HELD = "CASE WHEN inhibition > 0 AND parallelness < 0 THEN 0.2e0 * inhibition * -parallelness ELSE 0e0 END"
_DIRECT = f"0.5e0 * cooccurrence + 0.3e0 * synchronicity + 0.2e0 * semantic + 0.2e0 * glyph + CASE WHEN synchronicity > 0 AND glyph > 0 THEN 0.4e0 * synchronicity * glyph ELSE 0e0 END - {_HELD}"
_TOUCH = "(SELECT s.tag_id AS seed, t.tag_b_id AS partner, t.* FROM tensor t JOIN seeds s ON s.tag_id = t.tag_a_id UNION ALL SELECT s.tag_id, t.tag_a_id, t.* FROM tensor t JOIN seeds s ON s.tag_id = t.tag_b_id)"
_DIRECTED = "(SELECT tag_a_id AS source, tag_b_id AS target, semiotic_forward AS strength FROM tensor UNION ALL SELECT tag_b_id, tag_a_id, semiotic_reverse FROM tensor)"
_SEEDS = "(SELECT tag_id FROM seeds)"
_INTO = f"(SELECT source AS via, max(strength) AS s FROM {_DIRECTED} WHERE strength > 0.05 AND target IN {_SEEDS} AND source NOT IN {_SEEDS} GROUP BY 1)"
_SIBLINGS = f"(SELECT target AS tag_id, max(s * strength) AS strength, count(*) AS paths, max(s * strength) * (1 + ln(count(*))) AS score FROM {_INTO} JOIN {_DIRECTED} ON source = via WHERE strength > 0.05 AND target NOT IN {_SEEDS} AND target NOT IN (SELECT via FROM {_INTO}) GROUP BY 1)"
_OPEN = f"""(SELECT partner, max(score) AS score FROM (SELECT partner, {_DIRECT} AS score FROM {_TOUCH} WHERE {_DIRECT} >= 0.3
    UNION ALL SELECT tag_id, 0.3e0 * score FROM {_SIBLINGS}) WHERE partner NOT IN {_SEEDS} GROUP BY 1)"""
_MET = f"(SELECT tag_b_id AS partner FROM co_edges WHERE strength >= 0.3 AND tag_a_id IN {_SEEDS} UNION SELECT tag_a_id FROM co_edges WHERE strength >= 0.3 AND tag_b_id IN {_SEEDS})"


def _gated(partners: str) -> str:
    return f"(SELECT * FROM {partners} WHERE partner IN {_MET} OR NOT EXISTS (SELECT 1 FROM {partners} WHERE partner IN {_MET}))"


_PARTNERS = _gated(_OPEN)


@query("partner_scores", f"SELECT * FROM {_PARTNERS}", "score")
def partner_scores(t):  # noqa: ANN001, ANN201
    return T.partner_scores(t("tensor"), t("seeds"), t("co_edges"), P)


@query("partner_scores_open_gate", f"SELECT * FROM {_OPEN}", "score")
def partner_scores_open(t):  # noqa: ANN001, ANN201
    return T.partner_scores(t("tensor"), t("seeds"), t("co_edges").filter("strength > 1"), P)


@query("expand_in_through_out", f"SELECT * FROM {_SIBLINGS}", "strength, score")
def siblings(t):  # noqa: ANN001, ANN201
    return T.in_through_out(t("tensor"), t("seeds"))


@query("signifies", f"SELECT * FROM {_DIRECTED} WHERE strength > 0.05 AND source IN (SELECT tag_id FROM seeds)", "strength")
def signifies(t):  # noqa: ANN001, ANN201
    return T.signifies(t("tensor"), t("seeds")).select("source", "target", "strength")


@query("signified_by", f"SELECT * FROM {_DIRECTED} WHERE strength > 0.05 AND target IN (SELECT tag_id FROM seeds)", "strength")
def signified_by(t):  # noqa: ANN001, ANN201
    return T.signifies(t("tensor"), t("seeds"), inverse=True).select("source", "target", "strength")


@query("tag_degree", "SELECT tag_id, count(*) AS degree FROM (SELECT tag_a_id AS tag_id FROM tensor UNION ALL SELECT tag_b_id FROM tensor) GROUP BY 1")
def degree(t):  # noqa: ANN001, ANN201
    return T.degree(t("tensor"))


@query("inhibition_score", "SELECT coalesce(sum(inhibition * greatest(0e0, -parallelness)), 0e0) AS inhibition_score FROM tensor", "inhibition_score")
def inhibition(t):  # noqa: ANN001, ANN201
    return T.inhibition_score(t("tensor"), t("pairs"))


_RESONANT = f"(SELECT memory_id, s / max(s) OVER () AS score FROM (SELECT memory_id, max(score) AS s FROM user_tags JOIN {_PARTNERS} ON partner = tag_id GROUP BY 1))"


@query("resonant_memories", f"SELECT * FROM {_RESONANT}", "score")
def resonant(t):  # noqa: ANN001, ANN201
    return T.best_of_memories(t("user_tags"), T.partner_scores(t("tensor"), t("seeds"), t("co_edges")))


_GLYPH = f"glyph + 0.3e0 * cooccurrence - {_HELD}"
_GLYPHS = _gated(f"(SELECT partner, max({_GLYPH}) AS s FROM {_TOUCH} WHERE glyph > 0 AND {_GLYPH} > 0 AND partner NOT IN {_SEEDS} GROUP BY 1)")


def _associated(memory_tags: str) -> str:
    return f"(SELECT memory_id, s / max(s) OVER () AS score FROM (SELECT memory_id, max(s) AS s FROM {memory_tags} JOIN {_GLYPHS} ON partner = tag_id GROUP BY 1))"


@query("glyph_associations", f"SELECT * FROM {_associated('user_tags')}", "score")
def glyphs(t):  # noqa: ANN001, ANN201
    return T.glyph_associations(t("tensor"), t("seeds"), t("user_tags"), t("co_edges"))


_LIST = "(SELECT tag_a_id, tag_b_id, round(cooccurrence, 9) AS strength FROM tensor)"
_RANKED = f"(SELECT *, row_number() OVER (ORDER BY strength DESC, tag_a_id, tag_b_id) AS rank, count(*) OVER () AS n FROM {_LIST})"


def _listed(t) -> DataFrame:  # noqa: ANN001
    return t("tensor").select("tag_a_id", "tag_b_id", F.round("cooccurrence", 9).alias("strength"))


@query("rank_invert", f"SELECT x.tag_a_id, x.tag_b_id, x.strength, x.rank, y.strength AS inverted FROM {_RANKED} x JOIN {_RANKED} y ON y.rank = x.n + 1 - x.rank", "strength, inverted")
def rank_invert(t):  # noqa: ANN001, ANN201
    return T.rank_invert(_listed(t))


@query(
    "prefix_parallelness",
    f"""WITH c AS (SELECT label AS tag_id, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY 1, 2),
        r AS (SELECT tag_a_id, tag_b_id, rank FROM {_RANKED}), d AS (SELECT r.*, a.i, b.x - a.x AS d FROM r JOIN c a ON a.tag_id = tag_a_id JOIN c b ON b.tag_id = tag_b_id AND b.i = a.i),
        n AS (SELECT rank, sqrt(sum(d * d)) AS n FROM d GROUP BY 1), p AS (SELECT x.rank, y.rank AS r, abs(sum(x.d * y.d)) AS s FROM d x JOIN d y ON x.i = y.i AND y.rank < x.rank GROUP BY 1, 2)
        SELECT q.tag_a_id, q.tag_b_id, q.rank, coalesce(max(s / (m.n * k.n)), 0e0) AS parallelness FROM (SELECT DISTINCT tag_a_id, tag_b_id, rank FROM d) q LEFT JOIN p ON p.rank = q.rank LEFT JOIN n m ON m.rank = p.rank LEFT JOIN n k ON k.rank = p.r GROUP BY 1, 2, 3""",
    "parallelness",
)
def prefix(t):  # noqa: ANN001, ANN201
    return T.prefix_parallelness(T.rank_invert(_listed(t)), VS.centroids(t("vectors"), "tag_id", normalise=False))


@query("symbolic_bonus", "SELECT tag_a_id, tag_b_id, CASE WHEN tag_a_id % 7 = tag_b_id % 7 THEN 2e0 WHEN least(tag_a_id % 7, tag_b_id % 7) = 1 AND greatest(tag_a_id % 7, tag_b_id % 7) = 2 THEN 1.5e0 ELSE 1e0 END AS factor FROM pairs", "factor")
def symbolic(t):  # noqa: ANN001, ANN201
    glyph = t("event_tags").select("tag_id", (F.col("tag_id") % 7).alias("glyph"))
    known = t("event_tags").filter("tag_id = 1").select(F.lit(2).alias("glyph_a"), F.lit(1).alias("glyph_b"), F.lit("opposition").alias("relation"))
    return T.symbolic_bonus(t("pairs"), glyph, known).select("tag_a_id", "tag_b_id", "factor")


@query("semantic_layer", "SELECT * FROM (SELECT tag_a_id, tag_b_id, exp(-acosh(greatest(1e0, 1e0 + 2e0 * power(tanh(tag_a_id / 100e0 + 0.01e0) - tanh(tag_b_id / 100e0 + 0.01e0), 2) / ((1 - power(tanh(tag_a_id / 100e0 + 0.01e0), 2)) * (1 - power(tanh(tag_b_id / 100e0 + 0.01e0), 2)))))) AS semantic FROM pairs) WHERE semantic > 1e-6", "semantic")
def semantic_layer(t):  # noqa: ANN001, ANN201
    points = t("event_tags").select("tag_id", F.array(F.col("tag_id") / F.lit(100.0) + 0.01, F.lit(0.0)).alias("point"))
    return T.semantic_layer(points, t("pairs").select("tag_a_id", "tag_b_id"))


@query("tensor_assembly", "SELECT tag_a_id, tag_b_id, cooccurrence, synchronicity, semiotic_forward, semiotic_reverse FROM tensor", "cooccurrence, synchronicity, semiotic_forward, semiotic_reverse")
def assembly(t):  # noqa: ANN001, ANN201
    x = t("tensor")
    parts = [x.select(*T.PAIR, c) for c in ("cooccurrence", "synchronicity")]
    return T.assemble(*parts, x.select(*T.PAIR, "semiotic_forward", "semiotic_reverse")).select(*T.PAIR, "cooccurrence", "synchronicity", "semiotic_forward", "semiotic_reverse")


@query("principal_projection")
def projection(t):  # noqa: ANN001, ANN201
    c = VS.centroids(t("vectors"), "tag_id")
    return T.project(c, T.principal_plane(c)).select("tag_id", "point")


# ---- graph --------------------------------------------------------------------------------------


_BOTH = f"(SELECT tag_a_id AS a, tag_b_id AS b, {_DIRECT} AS s FROM tensor UNION ALL SELECT tag_b_id, tag_a_id, {_DIRECT} FROM tensor)"
_DEGREE = "(SELECT tag_id, count(*) AS n FROM (SELECT tag_a_id AS tag_id FROM tensor UNION ALL SELECT tag_b_id FROM tensor) GROUP BY 1)"
_TERMS = "(SELECT tag_id, name AS term FROM tags WHERE is_active AND NOT regexp_matches(name, '^(month-|day-)') AND length(name) > 1 AND NOT regexp_full_match(name, '[0-9]+') UNION SELECT tag_id, term FROM (SELECT tag_id, name, unnest(regexp_split_to_array(name, '[-_]')) AS term FROM tags WHERE is_active AND NOT regexp_matches(name, '^(month-|day-)')) WHERE regexp_matches(name, '[-_]') AND length(term) >= 3)"
_WORDS = "(SELECT query_id, w[i] AS token, CASE WHEN i < len(w) THEN w[i] || '-' || w[i + 1] END AS compound FROM (SELECT query_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3) AS w FROM queries), (SELECT unnest(range(1, 40)) AS i) WHERE i <= len(w))"
_MATCHED = f"(SELECT DISTINCT query_id, tag_id FROM {_WORDS} JOIN {_TERMS} ON term = token OR term = compound)"
_FAN = f"(SELECT query_id, b AS tag_id, max(s) / max(n) AS score FROM {_MATCHED} q JOIN {_BOTH} ON a = q.tag_id JOIN {_DEGREE} d ON d.tag_id = b WHERE s >= 0.3 AND (query_id, b) NOT IN (SELECT (query_id, tag_id) FROM {_MATCHED}) GROUP BY 1, 2)"


@query("lexical_match", f"SELECT * FROM {_MATCHED}")
def lexical_match(t):  # noqa: ANN001, ANN201
    return LX.lexical_match(t("queries"), t("tags"))


@query("fan_out", f"SELECT * FROM {_FAN}", "score")
def fan_out(t):  # noqa: ANN001, ANN201
    return G.fan_out(t("tensor"), LX.lexical_match(t("queries"), t("tags")))


_INWARD = f"""(WITH m AS {_MATCHED}, f AS {_FAN}, c AS (SELECT query_id, count(*) AS k FROM m GROUP BY 1)
    SELECT f.query_id, f.tag_id, f.score, count(b) / CAST(max(k) AS DOUBLE) AS convergence, count(b) / CAST(max(n) AS DOUBLE) AS inward, count(b) / CAST(max(k) AS DOUBLE) * count(b) / max(n) AS ratio, max(k) AS k
    FROM f JOIN c USING (query_id) JOIN {_DEGREE} d ON d.tag_id = f.tag_id LEFT JOIN m ON m.query_id = f.query_id LEFT JOIN {_BOTH} e ON e.a = m.tag_id AND e.b = f.tag_id GROUP BY 1, 2, 3)"""


@query("inward_ratio", f"SELECT query_id, tag_id, convergence, inward, ratio FROM {_INWARD}", "convergence, inward, ratio")
def inward(t):  # noqa: ANN001, ANN201
    seeds = cut(LX.lexical_match(t("queries"), t("tags")))
    return G.inward_ratio(t("tensor"), seeds, G.fan_out(t("tensor"), seeds)).select("query_id", "tag_id", "convergence", "inward", "ratio")


@query("prune_by_inward", f"SELECT query_id, tag_id, score * ratio AS score FROM {_INWARD} WHERE ratio >= 0.01e0 * sqrt(k / 4e0) UNION ALL SELECT query_id, tag_id, 1e0 FROM {_MATCHED}", "score")
def prune_inward(t):  # noqa: ANN001, ANN201
    seeds = cut(LX.lexical_match(t("queries"), t("tags")))
    return G.prune_by_inward(t("tensor"), seeds, G.fan_out(t("tensor"), seeds).unionByName(seeds.withColumn("score", F.lit(1.0))))


@query("score_lexical")
def score_lexical(t):  # noqa: ANN001, ANN201
    return LX.score_lexical(t("queries"), t("tags"), t("tensor"), t("user_tags"))[0]


_CONVERGED = f"(SELECT target AS tag_id, count(*) AS c FROM {_DIRECTED} WHERE strength > 0.05 AND target NOT IN {_SEEDS} AND source NOT IN {_SEEDS} AND source IN (SELECT target FROM {_DIRECTED} WHERE strength > 0.05 AND source IN {_SEEDS}) GROUP BY 1)"


@query("semiotic_convergence", f"SELECT memory_id, CAST(sum(c) AS DOUBLE) AS convergence FROM user_tags JOIN {_CONVERGED} USING (tag_id) GROUP BY 1", "convergence")
def sem_convergence(t):  # noqa: ANN001, ANN201
    return G.semiotic_convergence(t("tensor"), t("seeds"), t("user_tags"))


@query("filter_hubs", "SELECT tag_id FROM event_tags WHERE tag_id NOT IN (SELECT e.a FROM (SELECT tag_a_id AS a, tag_b_id AS b FROM tensor WHERE glyph > 0.4 UNION ALL SELECT tag_b_id, tag_a_id FROM tensor WHERE glyph > 0.4) e JOIN seeds s ON s.tag_id = e.b GROUP BY 1 HAVING count(*) > 2)")
def hubs(t):  # noqa: ANN001, ANN201
    return G.filter_hubs(t("tensor").filter("glyph > 0.4"), t("event_tags"), t("seeds"), 2).select("tag_id")


_NETWORK = "(SELECT vec_id AS a, vec_id + 3 AS b FROM embeddings WHERE vec_id % 7 < 4 UNION ALL SELECT vec_id, vec_id + 10 FROM embeddings WHERE vec_id % 10 = 1)"


@query("connected_components", f"SELECT n AS node, min(m) AS component FROM (WITH RECURSIVE e AS (SELECT a, b FROM {_NETWORK} UNION SELECT b, a FROM {_NETWORK}), r(n, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n) SELECT n, m FROM r) GROUP BY 1")
def components(t):  # noqa: ANN001, ANN201
    v = F.col("vec_id")
    e = t("embeddings")
    edges = e.filter("vec_id % 7 < 4").select(v.alias("a"), (v + 3).alias("b")).unionByName(e.filter("vec_id % 10 = 1").select(v.alias("a"), (v + 10).alias("b")))
    return G.connected_components(edges)


_SCORED = f"""(WITH r AS (SELECT retrieval_id AS query_id, memory_id, score / 500e0 AS sim, tag_id, event_type FROM results JOIN event_memories USING (memory_id)),
    p AS {_PARTNERS}, g AS {_GLYPHS},
    c AS (SELECT r.*, c, max(coalesce(c, 0)) OVER (PARTITION BY query_id) AS top, p.score AS ps, max(p.score) OVER (PARTITION BY query_id) AS ptop FROM r LEFT JOIN {_CONVERGED} v ON v.tag_id = r.tag_id LEFT JOIN p ON p.partner = r.tag_id)
    SELECT query_id, memory_id, 0.7e0 * sim + CASE WHEN event_type = 'purchase' THEN 0.3e0 * sim ELSE 0e0 END + 0.15e0 * coalesce(ps / ptop, 0e0) + 0.1e0 * coalesce(g.s / (SELECT max(s) FROM g), 0e0)
      + CASE WHEN top > 0 THEN 0.12e0 * coalesce(c, 0) / top ELSE 0e0 END AS score FROM c LEFT JOIN g ON g.partner = tag_id)"""


@query("retrieve_hybrid", f"SELECT query_id, memory_id, score, rank FROM (SELECT query_id, memory_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, memory_id) AS rank FROM {_SCORED}) WHERE rank <= 5", "score")
def hybrid(t):  # noqa: ANN001, ANN201
    """Channels of the results of every retrieval, with the seeds as context of each."""
    found = t("results").select(F.col("retrieval_id").alias("query_id"), "memory_id", (F.col("score") / 500.0).alias("score"))
    tags, tensor = t("event_memories"), cut(t("tensor"))
    candidates = cut(found.join(tags, "memory_id").select("query_id", "memory_id", "tag_id"))
    context = cut(found.select("query_id").distinct().crossJoin(F.broadcast(t("seeds"))))
    bought = found.join(tags.filter("event_type = 'purchase'"), "memory_id").select("query_id", "memory_id")
    channels = {
        "similarity": found, "tags": bought,
        "resonant": RE.resonant(tensor, context, candidates, t("co_edges"), None, found),
        "glyph": T.glyph_associations(tensor, context, candidates, t("co_edges")),
        "convergence": G.semiotic_convergence(tensor, context, candidates).withColumnRenamed("convergence", "score"),
    }
    return G.hybrid(channels, 5)


@query("deep_retrieve")
def deep(t):  # noqa: ANN001, ANN201
    start = VS.top_k_blocks(all_queries(t), t("vectors"), 10).select("query_id", "memory_id", "score")
    edges = t("near_pairs").select(F.col("memory_a").alias("a"), F.col("memory_b").alias("b"), "similarity")
    return G.deep_retrieve(cut(start), cut(edges), t("embeddings").select(F.col("vec_id").alias("memory_id"), (F.col("label") / 10.0).alias("decay")))


# ---- motifs -------------------------------------------------------------------------------------

_W = {"cooccurrence": 0.5, "synchronicity": 0.3, "semantic": 0.2, "semiotic": 0.15, "glyph": 0.2, "inhibition": 0.2}
_FLAT = "(SELECT *, greatest(semiotic_forward, semiotic_reverse) AS semiotic FROM tensor)"
_SUM = " + ".join(f"{w}e0 * {k}" for k, w in _W.items())
_TOPW = "greatest(" + ", ".join(f"{w}e0 * {k}" for k, w in _W.items()) + ")"
_LAYER = "CASE " + " ".join(f"WHEN {w}e0 * {k} = {_TOPW} THEN '{k}'" for k, w in _W.items()) + " END"
_EDGES = f"(SELECT tag_a_id AS a, tag_b_id AS b, {_SUM} AS score, {_LAYER} AS layer FROM {_FLAT} WHERE {_SUM} > 0)"


def _edges(t) -> DataFrame:  # noqa: ANN001
    return MO.scored_edges(t("tensor"))


@query("scored_edges", f"SELECT * FROM {_EDGES}", "score")
def scored(t):  # noqa: ANN001, ANN201
    return _edges(t).select("a", "b", "score", "layer")


_REDGES = f"(SELECT a, b, round(score, 9) AS score, layer FROM {_EDGES})"
_SELECTED = f"(SELECT a, b, score, layer FROM (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) AS r, row_number() OVER (PARTITION BY layer ORDER BY score DESC, a, b) AS l FROM {_REDGES} WHERE score >= 0.05) WHERE r <= 500 OR l <= 100)"


def _selected(t) -> DataFrame:  # noqa: ANN001
    return MO.select_edges(_edges(t).withColumn("score", F.round("score", 9)))


def _squares(t) -> DataFrame:  # noqa: ANN001
    return MO.square_motifs(_edges(t), _selected(t))


@query("select_edges", f"SELECT * FROM {_SELECTED}", "score")
def selected(t):  # noqa: ANN001, ANN201
    return _selected(t).select("a", "b", "score", "layer")


_CYCLES = f"""(WITH s AS {_SELECTED}, d AS (SELECT a, b, score, layer FROM s UNION ALL SELECT b, a, score, layer FROM s)
    SELECT x.a AS p, x.b AS m, y.b AS q, z.b AS n, x.layer AS l1, y.layer AS l2, z.layer AS l3, w.layer AS l4, (x.score + y.score + z.score + w.score) / 4 AS side_score FROM d x JOIN d y ON y.a = x.b JOIN d z ON z.a = y.b JOIN d w ON w.a = z.b AND w.b = x.a
    WHERE x.a < x.b AND x.a < y.b AND x.b < z.b AND x.a < z.b AND x.layer <> y.layer AND y.layer <> z.layer AND z.layer <> w.layer AND w.layer <> x.layer)"""


@query("square_motifs", f"SELECT concat_ws(',', p, m, q, n) AS tag_ids, concat_ws(',', l1, l2, l3, l4) AS side_layers, side_score, CAST(len(list_distinct([l1, l2, l3, l4])) AS INT) AS diversity FROM {_CYCLES}", "side_score")
def squares(t):  # noqa: ANN001, ANN201
    return _squares(t).select(F.array_join("tag_ids", ",").alias("tag_ids"), F.array_join("side_layers", ",").alias("side_layers"), "side_score", "diversity")


@query("square_motif_diagonals")
def diagonals(t):  # noqa: ANN001, ANN201
    chosen = cut(_selected(t))
    return MO.square_motifs(_edges(t), chosen, evidence=MO.edge_evidence(chosen, t("user_tags")))


# All four-cycles, whatever the layers of their sides: what zig-zags are counted in.
_SIDES = ("x", "y", "z", "w")
_ALL_CYCLES = f"""(WITH s AS {_SELECTED}, d AS (SELECT a, b, score, layer FROM s UNION ALL SELECT b, a, score, layer FROM s)
    SELECT x.a AS p, x.b AS m, y.b AS q, z.b AS n, x.layer AS l1, y.layer AS l2, z.layer AS l3, w.layer AS l4, (x.score + y.score + z.score + w.score) / 4 AS side_score FROM d x JOIN d y ON y.a = x.b JOIN d z ON z.a = y.b JOIN d w ON w.a = z.b AND w.b = x.a
    WHERE x.a < x.b AND x.a < y.b AND x.b < z.b AND x.a < z.b)"""
_CLASSED = f"(SELECT *, len(list_distinct([l1, l2, l3, l4])) AS k, list_max(list_transform([l1, l2, l3, l4], lambda x: len(list_filter([l1, l2, l3, l4], lambda y: y = x)))) AS most FROM {_ALL_CYCLES})"
_CLASS = "CASE WHEN k = 1 THEN 'uniform' WHEN l1 = l3 AND l2 = l4 THEN 'zigzag' WHEN (l1 = l2 AND l3 = l4) OR (l2 = l3 AND l4 = l1) THEN 'banded' WHEN most = 3 THEN 'three-one' ELSE 'mixed' END"
_RING = ("1234", "2341", "3412", "4123", "4321", "3214", "2143", "1432")
_SIGNATURE = "least(" + ", ".join("concat_ws('|', " + ", ".join(f"l{i}" for i in r) + ")" for r in _RING) + ")"


def _all_squares(t) -> DataFrame:  # noqa: ANN001
    return MO.square_motifs(_edges(t), _selected(t), min_colors=1, distinct_sides=False)


@query("square_motifs_any_layer", f"SELECT concat_ws(',', p, m, q, n) AS tag_ids, concat_ws(',', l1, l2, l3, l4) AS side_layers, side_score, CAST(k AS INT) AS diversity FROM {_CLASSED}", "side_score")
def squares_any(t):  # noqa: ANN001, ANN201
    return _all_squares(t).select(F.array_join("tag_ids", ",").alias("tag_ids"), F.array_join("side_layers", ",").alias("side_layers"), "side_score", "diversity")


@query("zigzag_classes", f"SELECT {_CLASS} AS side_class, {_SIGNATURE} AS signature, count(*) AS motifs FROM {_CLASSED} GROUP BY 1, 2")
def zigzags(t):  # noqa: ANN001, ANN201
    return MO.zigzag_report(_all_squares(t))


@query("zigzag_pairs", f"SELECT least(l1, l2) || '|' || greatest(l1, l2) AS pair, count(*) AS motifs FROM {_CLASSED} WHERE {_CLASS} = 'zigzag' GROUP BY 1")
def zigzag_pairs(t):  # noqa: ANN001, ANN201
    return MO.zigzag_pairs(_all_squares(t))


_PROFILES = f"(SELECT tag_a_id AS a, tag_b_id AS b, [{', '.join(f'{w}e0 * {k}' for k, w in _W.items())}] AS v FROM {_FLAT})"
_COS = "greatest(0e0, least(1e0, list_cosine_similarity({0}.v, {1}.v)))"
_VECTOR = "(" + " + ".join(_COS.format(*e) for e in ("xz", "yw")) + ") / 2 - (" + " + ".join(_COS.format(*e) for e in ("xy", "yz", "zw", "wx")) + ") / 4"
_MEETS = " ".join(f"JOIN f {s} ON {s}.a = c.{u} AND {s}.b = c.{v}" for s, u, v in zip(_SIDES, "pmqn", "mqnp", strict=True))


@query("zigzag_vectors", f"WITH e AS {_PROFILES}, f AS (SELECT a, b, v FROM e UNION ALL SELECT b, a, v FROM e), r AS (SELECT {_VECTOR} AS s FROM {_ALL_CYCLES} c {_MEETS}) SELECT count(*) AS motifs, coalesce(avg(s), 0) AS vector_mean, coalesce(avg(CASE WHEN s > 1e-9 THEN 1e0 ELSE 0e0 END), 0) AS positive_rate FROM r", "vector_mean, positive_rate")
def zigzag_vectors(t):  # noqa: ANN001, ANN201
    return MO.zigzag_vectors(_all_squares(t))


@query("zigzag_baseline")
def zigzag_baseline(t):  # noqa: ANN001, ANN201
    return MO.zigzag_baseline(_all_squares(t))


_SOURCES = "(SELECT user_id % 30 AS source, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS tag_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1, 2)"


@query("rectangles", f"WITH s AS {_SOURCES}, p AS (SELECT x.source, x.tag_id AS ta, y.tag_id AS tb, x.n AS na, y.n AS nb FROM s x JOIN s y ON x.source = y.source AND x.tag_id < y.tag_id) SELECT x.source AS source_x, y.source AS source_y, x.ta AS tag_a, x.tb AS tag_b, ln(1e0 + x.na) + ln(1e0 + x.nb) + ln(1e0 + y.na) + ln(1e0 + y.nb) AS repetition, least(x.na, x.nb, y.na, y.nb) / CAST(greatest(x.na, x.nb, y.na, y.nb) AS DOUBLE) AS balance FROM p x JOIN p y ON x.ta = y.ta AND x.tb = y.tb AND x.source < y.source", "repetition, balance")
def rectangles(t):  # noqa: ANN001, ANN201
    s = t("tag_events").join(t("events").select("event_id", "user_id"), "event_id").filter("event_type = 'signup'").groupBy((F.col("user_id") % 30).alias("source"), "tag_id").agg(F.count(F.lit(1)).alias("n"))
    return MO.rectangles(s).select("source_x", "source_y", "tag_a", "tag_b", "repetition", "balance")


@query("longest_chains")
def chains(t):  # noqa: ANN001, ANN201
    return MO.longest_chains(_selected(t))


@query("chain_anisotropy")
def anisotropy(t):  # noqa: ANN001, ANN201
    return MO.chain_anisotropy(_selected(t))


@query("chain_baseline")
def chain_baseline(t):  # noqa: ANN001, ANN201
    scored_ = _edges(t).withColumn("score", F.round("score", 9))
    return MO.chain_baseline(MO.select_edges(scored_, overall=1500, per_layer=200))


# ---- episodic edges and clusters ----------------------------------------------------------------

_UT = "(SELECT DISTINCT vec_id AS memory_id, label AS tag_id FROM embeddings UNION SELECT vec_id, 100 + vec_id % 3 FROM embeddings)"


def _memory_tags(t) -> DataFrame:  # noqa: ANN001
    e = t("embeddings")
    return e.select(F.col("vec_id").alias("memory_id"), F.col("label").cast("long").alias("tag_id")).unionByName(e.select(F.col("vec_id").alias("memory_id"), (100 + F.col("vec_id") % 3).alias("tag_id"))).distinct()


_JAC = f"(SELECT s.memory_a, s.memory_b, similarity, count(*) FILTER (WHERE y.tag_id IS NOT NULL) / (4e0 - count(*) FILTER (WHERE y.tag_id IS NOT NULL)) AS j FROM near_pairs s JOIN {_UT} x ON x.memory_id = s.memory_a LEFT JOIN {_UT} y ON y.memory_id = s.memory_b AND y.tag_id = x.tag_id GROUP BY 1, 2, 3)"


def _episodic(t) -> DataFrame:  # noqa: ANN001
    created = t("embeddings").select(F.col("vec_id").alias("memory_id"), F.timestamp_seconds(F.col("vec_id") * 3600).alias("created_at"))
    none = t("near_pairs").select("memory_a", "memory_b", *[F.lit(0.0).alias(c) for c in EP.CHANNELS]).limit(0)
    return EP.score_edges(t("near_pairs"), _memory_tags(t), none, created)


@query("episodic_edges", f"SELECT memory_a, memory_b, similarity AS semantic, j AS jaccard, similarity * (1 - j) AS bridge, exp(-0.693e0 * (memory_b - memory_a) / 720e0) AS temporal FROM {_JAC} WHERE similarity + similarity * (1 - j) >= 0.05", "semantic, jaccard, bridge, temporal")
def episodic(t):  # noqa: ANN001, ANN201
    return _episodic(t).drop("projected")


def _live(t) -> DataFrame:  # noqa: ANN001
    at = F.when(F.col("memory_a") % 3 > 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("memory_a") * 7200))
    return t("near_pairs").select("memory_a", "memory_b", F.col("similarity").alias("semantic"), F.lit(0.0).alias("projected"), (F.col("similarity") * (F.col("tag_b") > F.col("tag_a") + 3).cast("int")).alias("bridge"), ((F.col("memory_b") % 10) / F.lit(12.0)).alias("co_retrieval"), F.lit("candidate").alias("status"), at.alias("last_activated_at"), F.lit(0.5).alias("jaccard"))


@query("activate_edges", "SELECT memory_a, memory_b, CASE WHEN memory_a % 2 = 0 THEN 0.15e0 + 0.85e0 * s ELSE s END AS co_retrieval, CASE WHEN memory_a % 2 = 0 AND s >= 0.575 THEN 'mature' WHEN memory_a % 2 = 0 AND s >= 0.15 THEN 'warm' ELSE 'candidate' END AS status FROM (SELECT *, (memory_b % 10) / 12e0 AS s FROM near_pairs)", "co_retrieval")
def activate(t):  # noqa: ANN001, ANN201
    return EP.activate(_live(t), t("near_pairs").filter("memory_a % 2 = 0")).select("memory_a", "memory_b", "co_retrieval", "status")


@query("prune_edges", "SELECT memory_a, memory_b, CASE WHEN coalesce(age > 2160, true) THEN 'archived' WHEN age > 720 THEN 'decaying' ELSE 'candidate' END AS status FROM (SELECT *, CASE WHEN memory_a % 3 > 0 THEN (1706659200 - 1700000000 - memory_a * 7200) / 3600e0 END AS age FROM near_pairs WHERE greatest(similarity, CASE WHEN tag_b > tag_a + 3 THEN similarity ELSE 0e0 END, (memory_b % 10) / 12e0) >= 0.05)")
def prune(t):  # noqa: ANN001, ANN201
    return EP.prune(_live(t), P.now).select("memory_a", "memory_b", "status")


@query("backfill_bridge", "SELECT memory_a, memory_b, CASE WHEN b = 0 THEN greatest(similarity, (memory_b % 10) / 12e0) * 0.5e0 ELSE b END AS bridge FROM (SELECT *, CASE WHEN tag_b > tag_a + 3 THEN similarity ELSE 0e0 END AS b FROM near_pairs)", "bridge")
def backfill(t):  # noqa: ANN001, ANN201
    return EP.backfill_bridge(_live(t)).select("memory_a", "memory_b", "bridge")


@query("episodic_neighbours", "SELECT memory_id, max(s) AS score FROM (SELECT memory_b AS memory_id, similarity + CASE WHEN tag_b > tag_a + 3 THEN similarity ELSE 0e0 END + (memory_b % 10) / 12e0 AS s, memory_a AS k FROM near_pairs UNION ALL SELECT memory_a, similarity + CASE WHEN tag_b > tag_a + 3 THEN similarity ELSE 0e0 END + (memory_b % 10) / 12e0, memory_b FROM near_pairs) WHERE k = 42 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "score")
def neighbours(t):  # noqa: ANN001, ANN201
    return EP.neighbours(_live(t), 42)


@query("canopy_scores")
def canopy(t):  # noqa: ANN001, ANN201
    live = _live(t)
    return EP.canopy_scores(live, EP.canopy_clusters(live), _memory_tags(t))


@query("canopy_merge")
def canopy_merge(t):  # noqa: ANN001, ANN201
    return EP.canopy_merge(_live(t), _memory_tags(t), 1)


@query("observation_peaks", "SELECT tag_id, max(value) AS value, count(*) AS evidence_count FROM tag_events GROUP BY tag_id", "value")
def peaks(t):  # noqa: ANN001, ANN201
    return EP.peaks(t("tag_events"), "tag_id", ["value"])


@query("meta_patterns")
def meta(t):  # noqa: ANN001, ANN201
    scores = t("tensor").select(F.col("tag_a_id").alias("a"), F.col("tag_b_id").alias("b"), (F.col("glyph") * F.col("synchronicity")).alias("score"))
    return EP.meta_patterns(scores, t("tag_events").select("event_id", "tag_id"), t("event_tags"), least=0.3, ratio=0.5)


# ---- directional flow ---------------------------------------------------------------------------

_OBS = "(SELECT user_id % 25 AS block_key, CAST(extract(day FROM ts) AS BIGINT) AS obs, list_sort(list(DISTINCT CAST(regexp_extract(props, '([0-9]+)', 1) AS INT))) AS items FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"
_JPAIR = f"(SELECT x.block_key, len(list_intersect(x.items, y.items)) / CAST(len(list_distinct(list_concat(x.items, y.items))) AS DOUBLE) AS j FROM {_OBS} x JOIN {_OBS} y ON x.block_key = y.block_key AND x.obs < y.obs)"
_DIV = f"(SELECT b.block_key, contexts, 1 - coalesce(mj, 0e0) AS diversity FROM (SELECT block_key, count(DISTINCT array_to_string(items, ',')) AS contexts FROM {_OBS} GROUP BY 1) b LEFT JOIN (SELECT block_key, avg(j) AS mj FROM {_JPAIR} GROUP BY 1) USING (block_key))"


def _observed(t) -> DataFrame:  # noqa: ANN001
    return t("events").filter("event_type = 'purchase'").selectExpr("user_id % 25 AS block_key", "CAST(extract(day FROM ts) AS BIGINT) AS obs", "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS tag_id").groupBy("block_key", "obs").agg(F.sort_array(F.collect_set("tag_id")).alias("items"))


@query("inflow_diversity", f"SELECT block_key, contexts, diversity, diversity * (1 - 1 / sqrt(contexts + 1)) AS corrected FROM {_DIV}", "diversity, corrected")
def inflow_diversity(t):  # noqa: ANN001, ANN201
    return D.pair_diversity(_observed(t), "block_key", "obs", "items")


@query("outflow_strength", f"SELECT block_key, contexts, diversity, reach, (0.6e0 * diversity + 0.4e0 * reach) * (1 - 1 / sqrt(contexts + 1)) AS strength FROM (SELECT d.*, coalesce(r, 0e0) AS reach FROM {_DIV} d LEFT JOIN (SELECT block_key, avg(1 - j) AS r FROM {_JPAIR} GROUP BY 1) USING (block_key))", "diversity, reach, strength")
def outflow(t):  # noqa: ANN001, ANN201
    return D.outflow_reach(_observed(t), "block_key", "obs", "items")


@query("inflow_fold")
def inflow_fold(t):  # noqa: ANN001, ANN201
    obs = _observed(t).select(F.col("block_key").cast("string").alias("block_key"), F.col("obs").alias("retrieval_id"), F.timestamp_seconds(F.col("obs") * 86400).alias("observed_at"), F.col("items").alias("query_tags"), F.lit(40).alias("max_activations"))
    return D.inflow_fold(obs)


@query("ema_fold", "SELECT user_id, sum(w * value) AS ema, count(*) AS signals FROM (SELECT user_id, value, power(0.75e0, n - i) * CASE WHEN i = 1 THEN 1e0 ELSE 0.25e0 END AS w FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)) GROUP BY 1", "ema")
def ema(t):  # noqa: ANN001, ANN201
    return D.ema_fold(t("events"), "user_id", ["ts", "event_id"], "value", 0.25)


@query("adaptive_threshold", "SELECT p_partkey, CASE WHEN p_size > 25 THEN greatest(p_retailprice, 1200e0) * 1.5e0 ELSE p_retailprice END AS threshold FROM part", "threshold")
def thresholds(t):  # noqa: ANN001, ANN201
    until = F.when(F.col("p_size") > 25, F.lit("2024-02-10")).otherwise(F.lit("2024-01-10")).cast("timestamp")
    rows = t("part").select("p_partkey", F.col("p_retailprice").alias("current_value"), F.lit(1200.0).alias("baseline_value"), until.alias("burn_in_until"))
    return D.burn_in_threshold(rows, P.now).select("p_partkey", "threshold")


# ---- episodes -----------------------------------------------------------------------------------


def _operations(t) -> DataFrame:  # noqa: ANN001
    e = t("tag_events").join(t("events").select("event_id", "user_id"), "event_id")
    ops = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("op_id"), F.col("occurred_at").cast("timestamp").alias("occurred_at"), (F.col("tag_id") % 10).alias("tag_id"))
    return E.operation_centroids(ops, VS.centroids(t("vectors"), "tag_id", normalise=False))


@query("operation_centroids", "SELECT event_id AS op_id, i AS position, x FROM (SELECT label, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY 1, 2) JOIN tag_events ON tag_id % 10 = label", "x")
def operation_centroids(t):  # noqa: ANN001, ANN201
    return _operations(t).select("op_id", F.posexplode("centroid").alias("position", "x")).withColumn("position", F.col("position").cast("long"))


@query("assign_episodes")
def assign(t):  # noqa: ANN001, ANN201
    return E.assign_episodes(_operations(t))


@query("cross_episode_bridges", "SELECT memory_a, memory_b, memory_a % 4 AS episode_a, memory_b % 4 AS episode_b, b AS bridge FROM (SELECT *, CASE WHEN tag_b > tag_a + 3 THEN similarity ELSE 0e0 END AS b FROM near_pairs) WHERE memory_a % 4 <> memory_b % 4 ORDER BY b DESC, memory_a, memory_b LIMIT 20", "bridge")
def cross_bridges(t):  # noqa: ANN001, ANN201
    assigned = t("embeddings").select(F.col("vec_id").alias("memory_id"), (F.col("vec_id") % 4).alias("episode_id"))
    return E.cross_episode_bridges(_live(t), assigned)


# ---- alignment ----------------------------------------------------------------------------------



def _project_sql(cond: str) -> str:
    return f"(SELECT least('tag-' || a, 'tag-' || b) AS x, greatest('tag-' || a, 'tag-' || b) AS y, layer, score FROM {_REDGES} WHERE {cond})"


_LEFT, _RIGHT = _project_sql("(a + b) % 2 = 0 AND score > 0.6"), _project_sql("(a + b) % 3 = 0 AND score > 0.6")


def _profile_sql(edges: str) -> str:
    return f"(SELECT anchor, layer, s / sum(s) OVER (PARTITION BY anchor) AS share FROM (SELECT anchor, layer, sum(score) AS s FROM (SELECT x AS anchor, layer, score FROM {edges} UNION ALL SELECT y, layer, score FROM {edges}) GROUP BY 1, 2))"


_CELLS = f"(SELECT 'anchor' AS scope, a.anchor, a.layer AS layer_a, b.layer AS layer_b, a.share * b.share AS score FROM {_profile_sql(_LEFT)} a JOIN {_profile_sql(_RIGHT)} b USING (anchor))"
_EXACT = f"(SELECT 'pair' AS scope, a.x || '|' || a.y AS anchor, a.layer AS layer_a, b.layer AS layer_b, least(a.score, b.score) AS score FROM {_LEFT} a JOIN {_RIGHT} b ON a.x = b.x AND a.y = b.y)"
_ALL = f"(SELECT * FROM {_CELLS} UNION ALL SELECT * FROM {_EXACT})"


def _project(t, cond: str) -> DataFrame:  # noqa: ANN001
    names = t("event_tags").select("tag_id", F.concat(F.lit("P-Tag_"), "tag_id").alias("name"))
    edges = _edges(t).withColumn("score", F.round("score", 9)).filter(cond)
    return A.named_edges(edges, names, "p")


def _aligned(t) -> DataFrame:  # noqa: ANN001
    return A.alignment(_project(t, "(a + b) % 2 = 0 and score > 0.6"), _project(t, "(a + b) % 3 = 0 and score > 0.6"))


@query("alignment_cells", f"SELECT * FROM {_ALL}", "score")
def cells(t):  # noqa: ANN001, ANN201
    return _aligned(t)


@query("layer_matrix", f"SELECT scope, layer_a, layer_b, sum(score) AS total, count(*) AS cells FROM {_ALL} GROUP BY 1, 2, 3", "total")
def matrix(t):  # noqa: ANN001, ANN201
    return A.layer_matrix(_aligned(t))


_RALL = f"(SELECT scope, anchor, layer_a, layer_b, round(score, 9) AS score FROM {_ALL})"


@query("hidden_bridges", f"SELECT scope, anchor, layer_a, layer_b, score, reason, score + CASE reason WHEN 'shared-anchor' THEN 0.35e0 WHEN 'exact-pair' THEN 0.30e0 WHEN 'layer-crossing' THEN 0.15e0 ELSE 0.10e0 END AS bridge_score FROM (SELECT *, CASE WHEN anchor IN (SELECT anchor FROM {_RALL} WHERE score > 0.3 AND scope = 'anchor') THEN 'shared-anchor' WHEN scope = 'pair' THEN 'exact-pair' WHEN layer_a <> layer_b THEN 'layer-crossing' ELSE 'raw-only' END AS reason FROM {_RALL} WHERE NOT (score > 0.3 AND scope = 'anchor')) ORDER BY bridge_score DESC, scope, anchor, layer_a, layer_b LIMIT 50", "score, bridge_score")
def hidden(t):  # noqa: ANN001, ANN201
    raw = _aligned(t).withColumn("score", F.round("score", 9))
    return A.hidden_bridges(raw, raw.filter("score > 0.3 and scope = 'anchor'"))


@query("query_middle_layer", f"SELECT * FROM (SELECT *, CASE WHEN contains(anchor, 'tag-4') THEN 5 WHEN contains(layer_a || ' ' || layer_b, 'tag-4') THEN 3 ELSE 0 END + CASE WHEN contains(anchor, 'glyph') THEN 5 WHEN contains(layer_a || ' ' || layer_b, 'glyph') THEN 3 ELSE 0 END AS lexical FROM {_RALL}) WHERE lexical > 0 ORDER BY lexical DESC, score DESC, anchor, layer_a, layer_b LIMIT 20", "score")
def middle(t):  # noqa: ANN001, ANN201
    return A.query_middle(_aligned(t).withColumn("score", F.round("score", 9)), "tag-4 glyph")


@query("top_neighbours", f"SELECT name, string_agg(other || ' (' || layer || ')', ', ' ORDER BY k) AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, other) AS k FROM (SELECT x AS name, y AS other, layer, score FROM {_LEFT} UNION ALL SELECT y, x, layer, score FROM {_LEFT})) WHERE k <= 5 GROUP BY 1")
def top_neighbours(t):  # noqa: ANN001, ANN201
    return A.top_neighbours(_project(t, "(a + b) % 2 = 0 and score > 0.6"))


# ---- documents ----------------------------------------------------------------------------------


@query("chunk_documents")
def chunk(t):  # noqa: ANN001, ANN201
    return X.chunk_documents(t("documents"))


@query("deduplicate_by_hash", "SELECT content_hash, min(doc_id) AS doc_id FROM (SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents) WHERE content_hash NOT IN (SELECT substr(sha256(text), 1, 16) FROM documents WHERE doc_id < 10) GROUP BY 1")
def dedup(t):  # noqa: ANN001, ANN201
    d = t("documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk"))
    stored = d.filter("id < 10").select(S.content_hash(F.col("chunk")).alias("content_hash"))
    return X.new_chunks(d, stored).select("content_hash", F.col("id").alias("doc_id"))


@query(
    "criticality",
    """WITH k AS (SELECT tag_id, ln(1e0 + count(*)) AS w FROM memory_tags GROUP BY 1), n AS (SELECT memory_id, count(*) AS n FROM user_tags GROUP BY 1),
        rel AS (SELECT u.memory_id, CASE WHEN count(k.w) > 0 THEN count(k.w) / CAST(count(*) AS DOUBLE) * (0.6e0 + 0.4e0 * avg(k.w) / max(k.w)) ELSE 0e0 END AS r FROM user_tags u LEFT JOIN k USING (tag_id) GROUP BY 1),
        c AS (SELECT x.memory_id AS x, y.memory_id AS y, count(*) AS c FROM user_tags x JOIN user_tags y ON x.tag_id = y.tag_id AND x.memory_id <> y.memory_id GROUP BY 1, 2),
        d AS (SELECT x AS memory_id, sum(c / CAST(nx.n + ny.n - c AS DOUBLE)) AS j FROM c JOIN n nx ON nx.memory_id = x JOIN n ny ON ny.memory_id = y GROUP BY 1),
        s AS (SELECT memory_id, 0.6e0 * r + 0.4e0 * coalesce(j, 0e0) / ((SELECT count(*) FROM n) - 1) AS score FROM rel LEFT JOIN d USING (memory_id))
        SELECT memory_id AS doc_id, score, CASE WHEN score >= 0.3 THEN 'critical' ELSE 'reference' END AS class FROM s""",
    "score",
)
def criticality(t):  # noqa: ANN001, ANN201
    docs = t("user_tags").groupBy(F.col("memory_id").alias("doc_id")).agg(F.collect_set(F.concat(F.lit("t"), "tag_id")).alias("tags"))
    known = t("memory_tags").groupBy("tag_id").agg(F.count(F.lit(1)).alias("cnt")).select(F.concat(F.lit("t"), "tag_id").alias("name"), "cnt")
    return X.criticality(docs, known)


_PLAIN = "regexp_replace(split_part(url, '?', 1), '#.*$', '')"
# A page as a file of a mirror.
_FILE = f"(regexp_replace(regexp_replace({_PLAIN}, '^[a-z]+://', ''), '/+$', '') || '.html')"


def _path_sql(first: str, plain: tuple[str, ...], last: str) -> str:
    folders = f"list_filter(list_transform(string_split({_FILE}, '/')[:-2], lambda x: translate(lower(x), ' _', '--')), lambda n: length(n) > 1 AND n NOT IN {plain})"
    return f"SELECT page_id, array_to_string(list_filter(list_concat({first}, {folders}, {last}), lambda n: n IS NOT NULL), ',') AS tags FROM pages"


_STEM = f"translate(lower(regexp_extract({_FILE}, '([^/]+)\\.html$', 1)), ' _', '--')"


def _mirrored(t) -> DataFrame:  # noqa: ANN001
    plain = F.regexp_replace(F.substring_index("url", "?", 1), "#.*$", "")
    return t("pages").withColumn("path", F.concat(F.regexp_replace(F.regexp_replace(plain, "^[a-z]+://", ""), "/+$", ""), F.lit(".html")))


@query("file_tags", _path_sql("['html']", X.PLAIN_FOLDERS, "['document']"))
def file_tags(t):  # noqa: ANN001, ANN201
    return _mirrored(t).select("page_id", F.array_join(X.file_tags(F.col("path")), ",").alias("tags"))


@query("document_tags", _path_sql(f"['document', 'html', 'ext:html', CASE WHEN length({_STEM}) > 2 AND {_STEM} NOT IN {X.PLAIN_STEMS} THEN {_STEM} END]", X.PLAIN_DOCUMENT_FOLDERS, "[]"))
def document_tags(t):  # noqa: ANN001, ANN201
    return _mirrored(t).select("page_id", F.array_join(X.document_tags(F.col("path")), ",").alias("tags"))


@query("document_parts")
def document_parts(t):  # noqa: ANN001, ANN201
    return X.document_parts(t("documents").withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))


@query("list_active_names", "SELECT name FROM tags WHERE is_active")
def active_names(t):  # noqa: ANN001, ANN201
    return M.list_active_names(t("tags"))


_COUNTED = {"active_memories": "memories WHERE NOT is_archived", "active_tags": "tags WHERE is_active", "tag_events": "tag_events", "retrievals": "(SELECT DISTINCT retrieval_id FROM hits)", "tensor_edges": "tensor"}


@query("overview", " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS total FROM {v}" for k, v in _COUNTED.items()))
def overview(t):  # noqa: ANN001, ANN201
    return M.overview(active_memories=M.active(t("memories")), active_tags=t("tags").filter("is_active"), tag_events=t("tag_events"), retrievals=t("hits").select("retrieval_id").distinct(), tensor_edges=t("tensor"))


# ---- forest -------------------------------------------------------------------------------------

_GATED = "(SELECT s.retrieval_id, tag_a_id AS a, tag_b_id AS b FROM tensor JOIN session_tags s ON s.tag_id = tag_a_id JOIN session_tags r ON r.tag_id = tag_b_id AND r.retrieval_id = s.retrieval_id)"
_FOREST = f"""(SELECT a, b, raw, n.c * m.c / CAST(t.c AS DOUBLE) AS expected, greatest(0e0, ln(raw * t.c / CAST(n.c * m.c AS DOUBLE))) AS strength
    FROM (SELECT a, b, CAST(count(*) AS DOUBLE) AS raw FROM {_GATED} GROUP BY 1, 2) JOIN (SELECT tag_id, count(*) AS c FROM session_tags GROUP BY 1) n ON n.tag_id = a JOIN (SELECT tag_id, count(*) AS c FROM session_tags GROUP BY 1) m ON m.tag_id = b
    CROSS JOIN (SELECT count(DISTINCT retrieval_id) AS c FROM session_tags) t)"""


def _grown(t) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    hits = t("session_tags")
    active = hits.select(F.col("retrieval_id").cast("string").alias("scope_id"), F.lit("tag").alias("target_type"), F.col("tag_id").cast("string").alias("target_id"))
    counts = active.groupBy("target_type", "target_id").agg(F.count(F.lit(1)).alias("n"))
    total = hits.agg(F.countDistinct("retrieval_id").alias("total"))
    gate = cut(t("tensor").select(*T.PAIR))
    return active, gate, FO.grow_edges(None, active, "retrieval", gate, counts, total)


@query("forest_edges", f"SELECT CAST(a AS VARCHAR) AS left_id, CAST(b AS VARCHAR) AS right_id, raw AS raw_count, expected AS expected_count, strength AS co_strength FROM {_FOREST}", "raw_count, expected_count, co_strength")
def forest_edges(t):  # noqa: ANN001, ANN201
    return _grown(t)[2].select("left_id", "right_id", "raw_count", "expected_count", "co_strength")


@query(
    "forest_blocks",
    f"""SELECT left(sha256('cooccurrence:tag_set:' || tags), 32) AS block_key, avg(density) AS density, count(*) AS evidence_count
        FROM (SELECT retrieval_id, string_agg(CAST(tag_id AS VARCHAR), ',' ORDER BY CAST(tag_id AS VARCHAR)) AS tags FROM session_tags GROUP BY 1)
        JOIN (SELECT retrieval_id, avg(strength) AS density FROM {_GATED} JOIN {_FOREST} USING (a, b) GROUP BY 1) USING (retrieval_id) GROUP BY 1""",
    "density",
)
def forest_blocks(t):  # noqa: ANN001, ANN201
    active, gate, edges = _grown(t)
    return FO.grow_blocks(None, active, edges, gate)


_DETAIL = " OR ".join(f"regexp_matches(text, '(?i){x}')" for x in X.DETAIL)


@query("classify_questions", f"SELECT conv_id, turn, CASE WHEN {_DETAIL} THEN 'detail' ELSE 'broad' END AS question_type FROM conversations")
def questions(t):  # noqa: ANN001, ANN201
    return X.classify_questions(t("conversations"), "text").select("conv_id", "turn", "question_type")


_RESONANT_TAGS = "(SELECT tag_a_id AS a, tag_b_id AS b FROM tensor WHERE synchronicity > 0.3)"


@query(
    "cross_domain_bridges",
    f"""WITH l AS (SELECT retrieval_id FROM (SELECT retrieval_id, max(occurred_at) AS last_at FROM hits GROUP BY 1) WHERE (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_at)) / 3.6e9 <= 24 ORDER BY last_at DESC, retrieval_id DESC LIMIT 10),
        f AS (SELECT DISTINCT r.retrieval_id, tag_id FROM results r JOIN event_memories USING (memory_id) WHERE retrieval_id IN (SELECT retrieval_id FROM l)),
        n AS (SELECT tag_id, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM event_memories) AS share FROM event_memories GROUP BY 1)
        SELECT x.retrieval_id, a AS tag_a, b AS tag_b, -ln(greatest(p.share * q.share, 1e-10)) AS strength FROM {_RESONANT_TAGS} JOIN f x ON x.tag_id = a JOIN f y ON y.tag_id = b AND y.retrieval_id = x.retrieval_id JOIN n p ON p.tag_id = a JOIN n q ON q.tag_id = b
        WHERE p.share * q.share * (SELECT count(*) FROM event_memories) < 1 AND -ln(greatest(p.share * q.share, 1e-10)) >= 3""",
    "strength",
)
def cross_domain(t):  # noqa: ANN001, ANN201
    """Memories are single events here, so that no two tags are ever together."""
    when = t("hits").groupBy("retrieval_id").agg(F.max("occurred_at").cast("timestamp").alias("occurred_at"))
    results = t("results").join(when, "retrieval_id").select("retrieval_id", "occurred_at", "memory_id")
    resonant = t("tensor").filter("synchronicity > 0.3").select(F.col("tag_a_id").alias("a"), F.col("tag_b_id").alias("b"))
    return TR.cross_domain_bridges(results, t("event_memories"), resonant, t("event_memories").count(), since_hours=24.0)


@query("sync_velocity", "SELECT sum(exp(-ln(2e0) * age / 84) * value) AS level, sum(CASE WHEN age <= 84 THEN value ELSE -value END) AS velocity, sum(CASE WHEN age <= 56 THEN value WHEN age <= 112 THEN -2 * value ELSE value END) AS jerk, count(*) AS event_count FROM (SELECT value, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(occurred_at)) / 3.6e9 AS age FROM tag_events) WHERE age < 168", "level, velocity, jerk", 2)
def velocity(t):  # noqa: ANN001, ANN201
    e = t("tag_events").select(F.col("occurred_at").cast("timestamp").alias("detected_at"), "value")
    return TR.sync_velocity(e, F.col("value")).select(*[F.round(c, 2).alias(c) for c in ("level", "velocity", "jerk")], "event_count")


@query("document_summaries")
def summaries(t):  # noqa: ANN001, ANN201
    return X.summaries(t("documents"))


@query("similar_names")
def similar(t):  # noqa: ANN001, ANN201
    return X.similar_names(t("brands"), ["Brand#1", "Brand#12"], 0.8)


_SIGNS = {"the": "θ", "of": "○", "and": "&", "de": "δ"}


@query("glyph_tags", "SELECT conv_id * 1000 + turn AS id, w AS concept, CASE w WHEN 'the' THEN 'θ' WHEN 'of' THEN '○' WHEN 'and' THEN '&' ELSE 'δ' END AS glyph, count(*) AS hits FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS w FROM conversations) WHERE w IN ('the', 'of', 'and', 'de') GROUP BY 1, 2, 3")
def glyph_tags(t):  # noqa: ANN001, ANN201
    return X.glyph_tags(t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"), lexicon=_SIGNS)


@query("project_overview", "SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS suffix, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1, 2")
def overview(t):  # noqa: ANN001, ANN201
    return X.project_overview(t("pages").select(F.col("url").alias("path"), F.length("html").cast("long").alias("length")))


# ---- signals ------------------------------------------------------------------------------------


def _signals(t) -> DataFrame:  # noqa: ANN001
    rows = t("tag_events").join(t("events").select("event_id", "user_id"), "event_id")
    made = rows.select(F.concat(F.lit("p"), F.col("user_id") % 5).alias("project"), F.col("event_type").alias("operation"), F.array(F.concat(F.lit("t"), "tag_id"), F.lit("x")).alias("tags"), F.col("occurred_at").cast("date").cast("timestamp").alias("occurred_at"))
    return SK.signals(made)


_SIG = "(SELECT DISTINCT 'p' || (user_id % 5) AS project, event_type AS operation, substr(sha256('[\"t' || CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) || '\",\"x\"]'), 1, 16) AS tag_set_hash, CAST(ts AS DATE) AS d FROM events)"


@query("signals", f"SELECT project, operation, tag_set_hash, CAST(d AS VARCHAR) AS day FROM {_SIG}")
def signals(t):  # noqa: ANN001, ANN201
    return _signals(t).select("project", "operation", "tag_set_hash", F.col("occurred_at").cast("date").cast("string").alias("day"))


@query("project_rollup", f"SELECT project, count(*) AS signals, CAST(sum(CASE WHEN operation = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS processed FROM {_SIG} GROUP BY 1")
def rollup(t):  # noqa: ANN001, ANN201
    s = _signals(t)
    return SK.project_rollup(s, s.filter("operation = 'view'")).select("project", "signals", "processed")


@query("pending_signals", f"SELECT project, tag_set_hash, CAST(d AS VARCHAR) AS day FROM {_SIG} WHERE project = 'p1' AND operation = 'error' ORDER BY d, project, tag_set_hash LIMIT 50")
def pending(t):  # noqa: ANN001, ANN201
    s = _signals(t)
    return SK.pending(s, s.filter("operation <> 'error'"), "p1", 50).select("project", "tag_set_hash", F.col("occurred_at").cast("date").cast("string").alias("day"))




# ---- further readers and writers ----------------------------------------------------------------


@query("ids_by_source", "SELECT source_model, memory_id, count(*) OVER (PARTITION BY source_model) AS cnt FROM memories")
def by_source(t):  # noqa: ANN001, ANN201
    """In rows: a list of each source would grow with the table."""
    return M.rows_by_source(t("memories"))


@query("first_chunks", "SELECT user_id AS memory_id, min(event_id) AS chunk_index, arg_min(value, event_id) AS embedding FROM events GROUP BY 1", "embedding")
def first_chunks(t):  # noqa: ANN001, ANN201
    return M.first_chunks(t("events").select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("chunk_index"), F.col("value").alias("embedding")))


@query("replace_chunks", "SELECT vec_id AS memory_id, label FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 5 = 0")
def replace_chunks(t):  # noqa: ANN001, ANN201
    e = t("embeddings").select(F.col("vec_id").alias("memory_id"), "label")
    return M.replace_chunks(e, e.filter("memory_id % 5 = 0").withColumn("label", F.col("label") + 100))


@query("record_usefulness", "SELECT retrieval_id, memory_id, CASE WHEN memory_id % 7 = 0 THEN memory_id % 2 = 0 END AS was_useful FROM results")
def usefulness(t):  # noqa: ANN001, ANN201
    r = t("results")
    marks = r.filter("memory_id % 7 = 0").select("retrieval_id", "memory_id", (F.col("memory_id") % 2 == 0).alias("was_useful"))
    return M.record_usefulness(r, marks).select("retrieval_id", "memory_id", "was_useful")


@query("results_by_retrieval", "SELECT retrieval_id, string_agg(CAST(memory_id AS VARCHAR), ',' ORDER BY score DESC, memory_id) AS memory_ids FROM results GROUP BY 1")
def by_retrieval(t):  # noqa: ANN001, ANN201
    return M.results_by_retrieval(t("results")).withColumn("memory_ids", F.array_join("memory_ids", ","))


@query("feedback_tags", "SELECT pattern_id, string_agg(name, '-x-' ORDER BY name) AS name FROM (SELECT p_size AS pattern_id, p_brand AS name, row_number() OVER (PARTITION BY p_size ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1, 2) WHERE r <= 2 GROUP BY 1 HAVING count(*) = 2")
def feedback(t):  # noqa: ANN001, ANN201
    return M.feedback_tags(t("part").groupBy(F.col("p_size").alias("pattern_id"), F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("weight")))


@query("boost_salience", "SELECT l_orderkey AS memory_id, CASE WHEN l_orderkey % 3 = 0 THEN least(1e0, max(l_tax) * 12 + 0.05e0) ELSE max(l_tax) * 12 END AS salience FROM lineitem GROUP BY 1", "salience")
def boost(t):  # noqa: ANN001, ANN201
    m = t("lineitem").groupBy(F.col("l_orderkey").alias("memory_id")).agg((F.max("l_tax") * 12).alias("salience"))
    return M.boost_salience(m, m.filter("memory_id % 3 = 0"))


@query("cross_reference", "SELECT tag_a_id, tag_b_id, 1 / (1 + exp(-(ln(1e0 + cnt) - 2))) AS cooccurrence, CASE WHEN (tag_a_id + tag_b_id) % 3 = 0 THEN 0.6e0 WHEN (tag_a_id + tag_b_id) % 3 = 1 THEN 0.7e0 ELSE 0e0 END AS semantic, CASE WHEN (tag_a_id + tag_b_id) % 3 = 0 THEN 0.5e0 ELSE 0e0 END AS inhibition FROM pairs", "cooccurrence, semantic, inhibition")
def cross_reference(t):  # noqa: ANN001, ANN201
    kinds = F.when((F.col("tag_a_id") + F.col("tag_b_id")) % 3 == 0, "opposition").when((F.col("tag_a_id") + F.col("tag_b_id")) % 3 == 1, "transformation").otherwise("kinship")
    return T.cross_reference(t("pairs"), t("pairs").select(*T.PAIR, kinds.alias("relation")))


@query("apply_deltas", "SELECT tag_a_id, tag_b_id, CASE WHEN glyph > 0 THEN 0.15e0 * glyph + 0.85e0 * inhibition ELSE inhibition END AS inhibition, CASE WHEN glyph > 0 THEN 0.15e0 * semantic + 0.85e0 * parallelness ELSE parallelness END AS parallelness FROM tensor", "inhibition, parallelness")
def deltas(t):  # noqa: ANN001, ANN201
    d = t("tensor").filter("glyph > 0").select(*T.PAIR, F.col("glyph").alias("inhibition"), F.col("semantic").alias("parallelness"))
    return T.apply_deltas(t("tensor"), d).select(*T.PAIR, "inhibition", "parallelness")


@query("place_points", "SELECT event_id AS tag_id, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 6.283185307179586e0 ELSE atan2(y, x) END AS angle, tanh(sqrt(x * x + y * y)) AS radius FROM (SELECT event_id, value / 100e0 - 1e0 AS x, (event_id % 11) / 10e0 - 0.53e0 AS y FROM tag_events)", "angle, radius")
def place_points(t):  # noqa: ANN001, ANN201
    return T.place(t("tag_events").select(F.col("event_id").alias("tag_id"), F.array(F.col("value") / 100.0 - 1.0, (F.col("event_id") % 11) / F.lit(10.0) - 0.53).alias("point")))


@query("network_edges", "SELECT * FROM pairs WHERE cnt >= 30")
def network_edges(t):  # noqa: ANN001, ANN201
    trend = TR.trends(t("tag_events"), t("event_tags"))
    return T.network(TR.phase_space(trend, TR.retrieval_frequency(t("hits"), t("event_tags"))), trend, t("pairs"), 30)[1]


@query("centroid_fold")
def centroid_fold(t):  # noqa: ANN001, ANN201
    v = t("vectors")
    return VS.centroid_fold(v.select("tag_id", F.col("memory_id").alias("stored_at"), "memory_id", "embedding"))


@query("source_summaries", "SELECT motif, summary, memories, rank FROM (SELECT motif, summary, count(*) AS memories, row_number() OVER (PARTITION BY motif ORDER BY count(*) DESC, summary) AS rank FROM (SELECT motif, l_orderkey, l_returnflag || l_linestatus AS summary FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT tag_id, CAST(tag_id % 2 AS INT) AS motif FROM basket_tags) ON tag_id = p_size GROUP BY 1, 2, 3 HAVING count(DISTINCT tag_id) >= 2) GROUP BY 1, 2) WHERE rank <= 5")
def source_summaries(t):  # noqa: ANN001, ANN201
    m = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("memory_id"), F.col("p_size").alias("tag_id"), F.concat("l_returnflag", "l_linestatus").alias("summary"))
    return MO.source_summaries(m, t("basket_tags").select("tag_id", (F.col("tag_id") % 2).alias("motif")))


@query("name_predicates", "SELECT p_partkey, contains(lower(p_name), 're') AND NOT contains(lower(p_name), 'ed') AS matched, length(p_mfgr) = 1 AND false AS letter FROM (SELECT *, p_brand AS p_mfgr FROM part)")
def predicates(t):  # noqa: ANN001, ANN201
    return t("part").select("p_partkey", MO.matches_terms(F.col("p_name"), "re", "ed").alias("matched"), MO.letter_sequence(F.col("p_brand"), F.col("p_brand")).alias("letter"))
