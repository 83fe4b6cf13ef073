"""Steps that must not grow faster than their input, against plain code or the SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import episodic as EP
from tagloom.operators import graph as G
from tagloom.operators import lexical as LX
from tagloom.operators import overlap as OV
from tagloom.operators import retrieval as RE
from tagloom.operators import tensor as T
from tagloom.operators import text as X


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def plain_sums(sets):
    return {(s, i): sum(len(t & u) / len(t | u) for (r, j), u in sets.items() if r == s and j != i and t & u) for (s, i), t in sets.items()}


@pytest.mark.parametrize("least", [4, 1000])
def test_jaccard_sums(spark, least, monkeypatch):
    monkeypatch.setattr(OV, "TILE", 7)
    rng = random.Random(3)
    sets = {(s, 10 * s + i): {rng.randrange(12) if rng.random() < 0.7 else rng.randrange(1000) for _ in range(rng.randint(1, 6))} for s, n in ((0, 10), (1, 1), (2, 10), (5, 10)) for i in range(n)}
    sets |= {(9, 1000 + i): {rng.randrange(7) for _ in range(rng.randint(1, 5))} for i in range(120)}
    df = spark.createDataFrame([(s, i, sorted(t)) for (s, i), t in sets.items()], "scope long, item long, tags array<long>")
    got = {(r["scope"], r["item"]): r["total"] for r in df.join(OV.jaccard_sums(df, least, least), ["scope", "tags"]).collect()}
    assert got == pytest.approx(plain_sums(sets))


def test_common_by_products_and_by_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.random((40, 90)) < 0.2, rng.random((30, 90)) < 0.2
    (ra, ta), (rb, tb) = np.nonzero(x), np.nonzero(y)
    for dense in (0, 40, 10**9):
        monkeypatch.setattr(OV, "DENSE", dense)
        assert (OV.common(ta * 7, ra, 40, tb * 7, rb, 30) == x.astype(int) @ y.T.astype(int)).all()


def test_overlaps_make_no_row_a_pair(spark):
    """A hub tag of many memories: the plans hold no join of memories with memories."""
    edges = spark.createDataFrame([(i, i + 1, 0.5, 0.5, 0.5, 0.5) for i in range(300)], "memory_a long, memory_b long, semantic double, projected double, bridge double, co_retrieval double")
    tags = {i: {0, i % 5 + 1, *([7] if i % 3 else [])} for i in range(301)}
    clusters = spark.createDataFrame([(i, 0) for i in tags], "memory_id long, cluster long")
    t = spark.createDataFrame([(i, x) for i, s in tags.items() for x in s], "memory_id long, tag_id long")
    scores = EP.canopy_scores(edges, clusters, t)
    pairs = 301 * 300 / 2
    assert scores.first()["inhibition"] == pytest.approx(0.5 * sum(plain_sums({(0, i): s for i, s in tags.items()}).values()) / 2 / pairs)
    docs = spark.createDataFrame([(i, [f"n{x}" for x in s]) for i, s in tags.items()], "doc_id long, tags array<string>")
    crit = X.criticality(docs, spark.createDataFrame([("n0", 3)], "name string, cnt int"))
    for df in (scores, crit):
        assert "_x" not in plan_of(df)
    of = plain_sums({(0, i): s for i, s in tags.items()})
    got = {r["doc_id"]: r["score"] for r in crit.collect()}
    assert got == pytest.approx({i: 0.6 / len(s) + 0.4 * of[0, i] / 300 for i, s in tags.items()})


def test_equal_contexts_count_once(spark, monkeypatch):
    """What depends on a query's context alone is computed for one query of each context, and holds for all."""
    rng = random.Random(8)
    tensor = spark.createDataFrame([(a, b, *[round(rng.random(), 3) for _ in range(7)], rng.uniform(-1, 1)) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.7], ", ".join(["tag_a_id int, tag_b_id int", *[f"{c} double" for c in T.LAYERS]]))
    context = {q: {0: [1, 2], 1: [3], 2: [1, 2, 4]}[q % 3] for q in range(12)}
    seeds = spark.createDataFrame([(q, t) for q, s in context.items() for t in s], "query_id long, tag_id int")
    candidates = spark.createDataFrame([(q, m, (m * 5 + q) % 9) for q in context for m in range(6)], "query_id long, memory_id long, tag_id int")
    seen = []
    own = T.partner_scores
    monkeypatch.setattr(RE, "partner_scores", lambda tensor, seeds, *a: seen.append(seeds.select("query_id").distinct().count()) or own(tensor, seeds, *a))
    channels = {
        "resonant": lambda s, c: RE.resonant(tensor, s, c, None, None, s),
        "glyph": lambda s, c: T.glyph_associations(tensor, s, c),
        "convergence": lambda s, c: G.semiotic_convergence(tensor, s, c),
        "fan_out": lambda s, c: G.fan_out(tensor, s),
        "inward": lambda s, c: G.inward_ratio(tensor, s, c.withColumn("score", F.lit(0.5)).select("query_id", "tag_id", "score").distinct()),
    }
    for name, channel in channels.items():
        got = sorted(tuple(round(x, 9) for x in r) for r in channel(seeds, candidates).collect())
        alone = [tuple(round(x, 9) for x in r) for q in range(3, 6) for r in channel(seeds.filter(f"query_id = {q}"), candidates.filter(f"query_id = {q}")).collect()]
        assert [r for r in got if 3 <= r[0] < 6] == sorted(alone) and got, name
    assert seen[0] == 3


def test_equal_texts_are_read_once(spark, monkeypatch):
    seen, own = [], LX.best_of_memories
    monkeypatch.setattr(LX, "best_of_memories", lambda m, p: seen.append(p.select("query_id").distinct().count()) or own(m, p))
    tensor = spark.createDataFrame([(1, 2, *[0.5] * 8)], ", ".join(["tag_a_id int, tag_b_id int", *[f"{c} double" for c in T.LAYERS]]))
    tags, memory_tags = spark.createDataFrame([(1, "red"), (2, "blue")], "tag_id int, name string"), spark.createDataFrame([(7, 1), (8, 2)], "memory_id int, tag_id int")
    queries = spark.createDataFrame([(1, "Red"), (2, "red"), (3, "is RED!"), (4, "blue")], "query_id int, text string")
    scores, seeds = LX.score_lexical(queries, tags, tensor, memory_tags)
    got = {}
    for r in scores.collect():
        got.setdefault(r["query_id"], {})[r["memory_id"]] = r["score"]
    assert seen == [2] and got[1] == got[2] == got[3] and got[1][7] == 1.0 and got[4][8] == 1.0
    assert sorted(map(tuple, seeds.collect())) == [(1, 1), (2, 1), (3, 1), (4, 2)]
