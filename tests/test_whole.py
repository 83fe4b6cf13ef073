"""Queries cover all their rows."""

import os

import numpy as np
import pytest

from tagloom.operators import graph as G
from tagloom.operators import memory as M
from tagloom.operators import motifs as MO
from tagloom.operators import vector_search as VS
from tagloom.plans import catalog

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_rows_by_source(spark):
    rows = [(1, "x"), (5000, "x"), (7, None), (9000, None), (3, "y")]
    got = M.rows_by_source(spark.createDataFrame(rows, "memory_id long, source_model string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("x", 1, 2), ("x", 5000, 2), (None, 7, 2), (None, 9000, 2), ("y", 3, 1)], key=str)


@tables
def test_ids_by_source_has_every_memory(spark):
    got = catalog.QUERIES["ids_by_source"](spark, SF)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert got.count() == orders.count() and got.select("memory_id").exceptAll(orders.select("o_orderkey")).isEmpty()


@tables
def test_searches_take_every_twentieth_row(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    queries = [i for i in ids.tolist() if i % 20 == 0]
    true = {}
    for i in queries:
        scores = np.round(x @ x[ids == i][0], 9)
        true[i] = ids[np.lexsort((ids, -scores))[:10]].tolist()
    top = {}
    for r in catalog.QUERIES["vector_top_k"](spark, SF).orderBy("query_id", "rank").collect():
        assert r["score"] >= 0.1
        top.setdefault(r["query_id"], []).append(r["memory_id"])
    assert sorted(top) == sorted(queries) and all(true[i][: len(m)] == m for i, m in top.items())
    cells = catalog.QUERIES["cell_search"](spark, SF).collect()
    assert {r["query_id"] for r in cells} == set(queries)
    assert sum(r["memory_id"] in true[r["query_id"]] for r in cells) >= 0.9 * 10 * len(queries)
    assert {r["query_id"] for r in catalog.QUERIES["deep_retrieve"](spark, SF).collect()} == set(queries)
    hybrid = catalog.QUERIES["retrieve_hybrid"](spark, SF).select("query_id").distinct().count()
    assert hybrid == spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id * 100 + extract(day FROM ts)").distinct().count()


def test_blocks_give_what_one_join_gives(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (120, 3)).astype(float)  # many ties
    v = spark.createDataFrame([(i // 2, i % 2, r.tolist()) for i, r in enumerate(x)], "memory_id long, chunk_index int, embedding array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 120, 7)], "query_id long, embedding array<double>")
    for threshold in (None, 1.0):
        want = VS.top_k(q, v, 4, threshold).select("query_id", "memory_id", "score", "rank")
        got = VS.top_k_blocks(q, v, 4, threshold, block=5).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_deep_retrieve_by_query(spark):
    similar = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (4, 3, 0.9)], "a long, b long, similarity double")
    decay = spark.createDataFrame([(3, 0.5)], "memory_id long, decay double")
    start = spark.createDataFrame([(10, 1, 1.0), (20, 4, 1.0)], "query_id long, memory_id long, score double")
    both = G.deep_retrieve(start, similar, decay).collect()
    for q in (10, 20):
        alone = G.deep_retrieve(start.filter(f"query_id = {q}").drop("query_id"), similar, decay).collect()
        assert sorted((r["memory_id"], r["score"], r["depth"]) for r in both if r["query_id"] == q) == sorted(map(tuple, alone))


@tables
def test_canopy_has_every_memory_of_an_edge(spark):
    small = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "label").collect()
    label, up = dict(map(tuple, e)), {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x in label:
        for y in range(x + 1, x + 9):
            if y in label and label[x] <= label[y] and (y % 10 or label[y] > label[x] + 3 and (x + y) % 100):
                up[root(x)] = root(y)
    groups = {}
    for x in list(up):
        groups[root(x)] = groups.get(root(x), 0) + 1
    inside = sum(y in label and label[x] <= label[y] and x in up and y in up and root(x) == root(y) for x in label for y in range(x + 1, x + 9))
    got = catalog.QUERIES["canopy_scores"](spark, small).select("members", "edges").collect()
    assert sorted(r["members"] for r in got) == sorted(n for n in groups.values() if n > 1)
    assert sum(r["edges"] for r in got) == inside


@tables
def test_chains_see_the_whole_selection(spark):
    chains, edges = (catalog.QUERIES[n](spark, SF) for n in ("longest_chains", "select_edges"))
    assert chains.count() == edges.count() > 180
    assert chains.selectExpr("max(length)").first()[0] > 4
    assert catalog.QUERIES["chain_anisotropy"](spark, SF).selectExpr("sum(edges)").first()[0] == edges.count()
    assert catalog.QUERIES["square_motif_diagonals"](spark, SF).count() == catalog.QUERIES["square_motifs"](spark, SF).count()


def test_longest_chains_against_every_path(spark):
    rng = np.random.default_rng(6)
    rows = [(layer, a, b, float(rng.integers(1, 9))) for layer in ("x", "y") for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.35]
    got = {tuple(r)[:3]: r["length"] for r in MO.longest_chains(spark.createDataFrame(rows, "layer string, a int, b int, score double"), depth=5, branching=2).collect()}
    best = {}
    for layer, node in {(x[0], n) for x in rows for n in x[1:3]}:
        ends = sorted((-s, b if a == node else a) for x, a, b, s in rows if x == layer and node in (a, b))
        best[layer, node] = [n for _, n in ends[:2]]

    def longest(layer, path):
        onward = [n for n in best[layer, path[-1]] if n not in path] if len(path) <= 5 else []
        return max([longest(layer, [*path, n]) for n in onward], default=len(path) - 1)

    assert got == {(x, a, b): max(longest(x, [a, b]), longest(x, [b, a])) for x, a, b, _ in rows}
