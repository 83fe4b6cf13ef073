"""Forest pairs, centroids of operations, letters and texts: bounded steps, against plain code."""

import random
import re
from collections import Counter

import pandas as pd
import pyarrow as pa

from tagloom.operators import episodes as E
from tagloom.operators import forest as FO
from tagloom.operators import memory as M
from tagloom.operators import text as X


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scope_pairs_meet_in_the_smaller_way(spark):
    rng = random.Random(2)
    gate = {(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.9 if a < 3 else 0.02)}
    scopes = {"small": {0, 1, 5}, "wide": set(range(40)), "one": {3}, "hubs": {0, 1, 2}, "far": set(range(10, 40))}
    active = spark.createDataFrame([(s, "tag", str(t)) for s, tags in scopes.items() for t in tags] + [("small", "tag", "5"), ("m", "memory", "a"), ("m", "memory", "b")], "scope_id string, target_type string, target_id string")
    pairs = FO.scope_pairs(active, spark.createDataFrame(sorted(gate), "tag_a_id int, tag_b_id int"))
    want = sorted([(s, "tag", str(a), "tag", str(b)) for s, tags in scopes.items() for a, b in gate if a in tags and b in tags] + [("m", "memory", "a", "memory", "b")])
    assert sorted(map(tuple, pairs.collect())) == want
    assert "LeftSemi" in logical(pairs)  # small scopes make their own pairs


def test_operation_centroids_once_a_set(spark):
    ops = [(1, n, n, t) for n, tags in enumerate([[1, 2], [1, 2], [2], [1, 9], [8, 9, 10, 11, 1], [9], [None, 1]]) for t in tags]
    df = spark.createDataFrame(ops, "key long, op_id long, occurred_at long, tag_id int")
    centroids = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "tag_id int, centroid array<double>")
    out = E.operation_centroids(df, centroids)
    got = {r["op_id"]: (r["centroid"], r["tags"]) for r in out.collect()}
    assert got == {0: ([0.5, 1.5], [1, 2]), 1: ([0.5, 1.5], [1, 2]), 2: ([0.0, 3.0], [2]), 3: ([1.0, 0.0], [1, 9]), 6: ([1.0, 0.0], [1])}
    assert not re.search(r"Aggregate \[[^\]]*op_id#\d+L[^\]]* i#", logical(out))  # no row for each operation and position


def test_letters_without_a_counter_each(spark):
    texts = [(1, "Aab ß1"), (1, "Aé"), (2, None), (3, "12"), (4, "𝒜𝒜ΣΑΣ"), (None, "zz")]
    out = M.letter_tags(spark.createDataFrame(texts, "memory_id long, content string"))
    want = Counter((i, c) for i, t in texts for c in (t or "").lower() if c.isalpha())
    got = {(r["memory_id"], r["letter"]): r["confidence"] for r in out.collect()}
    assert {k: v for k, v in got.items() if k[0] != 4} == {k: v for k, v in want.items() if k[0] != 4}
    assert got[4, "𝒜"] == 2 and sum(v for k, v in got.items() if k[0] == 4) == 5
    assert not re.search(r"Aggregate \[[^\]]*letter#", logical(out))


def test_texts_come_in_slices(spark, monkeypatch):
    monkeypatch.setattr(X, "SLICE_CHARS", 100)
    texts = ["a" * 60, "b" * 60, None, "c" * 300, "", *["d"] * 700]
    batch = pa.RecordBatch.from_pandas(pd.DataFrame({"id": range(len(texts)), "text": texts}))
    parts = list(X.slices(batch))
    assert [t for p in parts for t in p["text"]] == texts and all(len(p) <= 500 for p in parts)
    assert all(len(p) == 1 or sum(len(t or "") for t in p["text"]) <= 100 for p in parts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["id"]: r["summary"] for r in X.summaries(docs).collect()} == {i: X.summarise(t) for i, t in enumerate(texts)}
