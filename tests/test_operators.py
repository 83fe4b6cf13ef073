"""Rules of the operators on small made-up rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import scalar as S
from tagloom.operators import align, cooccurrence, directional, episodes, graph, lattice, memory, motifs, tensor, text, trends
from tagloom.params import Params


def test_conditional_probability_is_directed(spark):
    rows = [(m, 1) for m in (1, 2)] + [(m, 2) for m in range(1, 11)]
    m = spark.createDataFrame(rows, "memory_id long, tag_id int")
    r = spark.createDataFrame([], "retrieval_id long, tag_id int")
    out = cooccurrence.conditional(m, r).first()
    assert (out["semiotic_forward"], out["semiotic_reverse"]) == (1.0, 0.2)


def test_no_event_is_temperature_zero_and_any_event_at_least_half(spark):
    e = spark.createDataFrame([(1, "2024-01-30 12:00:00")], "tag_id int, occurred_at string").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    tags = spark.createDataFrame([(1,), (2,)], "tag_id int")
    got = {r["tag_id"]: r["temperature"] for r in trends.trends(e, tags).collect()}
    assert got[2] == 0.0 and got[1] >= 0.5


def test_discrete_p90(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "raw double")
    assert trends.discrete_p90(df, "raw").first()["norm"] == 9.0
    assert trends.discrete_p90(df.limit(0), "raw").first()["norm"] == 1.0


def test_edge_ema_closed_form(spark):
    row = tensor.edge_ema(spark.createDataFrame([(1, 2, 3)], "tag_a_id int, tag_b_id int, cnt long")).first()
    value = 0.0
    for _ in range(3):
        value += 0.15 * (1 - value)
    assert row["strength"] == pytest.approx(value)


def test_merge_swaps_directions(spark):
    columns = "tag_a_id int, tag_b_id int, cooccurrence double, synchronicity double, semantic double, glyph double, semiotic_forward double, semiotic_reverse double"
    t = spark.createDataFrame([(1, 5, 0.1, 0.0, 0.0, 0.0, 0.7, 0.2), (1, 9, 0.4, 0.0, 0.0, 0.0, 0.3, 0.1)], columns)
    row = {(r["tag_a_id"], r["tag_b_id"]): r for r in memory.merge_tags(t, 1, 9).collect()}
    assert list(row) == [(5, 9)] and row[5, 9]["semiotic_forward"] == 0.2 and row[5, 9]["semiotic_reverse"] == 0.7


def test_alternating_square(spark):
    co, sem = {"cooccurrence": 2.0}, {"semantic": 2.0}
    names = ["cooccurrence", "synchronicity", "semantic", "semiotic_forward", "semiotic_reverse", "glyph", "inhibition"]
    rows = [(a, b, *[x.get(n, 0.0) for n in names]) for a, b, x in ((1, 2, co), (2, 3, sem), (3, 4, co), (1, 4, sem))]
    t = spark.createDataFrame(rows, "tag_a_id int, tag_b_id int, " + ", ".join(f"{n} double" for n in names))
    edges = motifs.scored_edges(t)
    found = motifs.square_motifs(edges, motifs.select_edges(edges)).collect()
    assert len(found) == 1 and found[0]["diversity"] == 2 and found[0]["tag_ids"] == [1, 2, 3, 4]
    assert found[0]["ac_status"] == found[0]["bd_status"] == "void" and found[0]["center_score"] == pytest.approx(1.0)


def test_side_signature_is_rotation_invariant(spark):
    sides = ["a", "b", "a", "c"]
    rows = [(sides[i:] + sides[:i],) for i in range(4)]
    got = spark.createDataFrame(rows, "s array<string>").select(motifs.side_signature(F.col("s")).alias("x")).distinct().collect()
    assert len(got) == 1


def test_components_and_hubs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 10: 10, 11: 10}


def test_slots_share_by_distance(spark):
    primes = lattice.first_primes(10)
    assert primes == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    p = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 4.0)], "id long, angle double")
    got = {(r["a"], r["b"]): r["shared_count"] for r in lattice.resonances(lattice.slots(p, primes), 1).collect()}
    assert got[1, 2] == 10 and got.get((1, 3), 0) < 10
    d = lattice.proximity_threshold(primes, 3)
    assert sum(max(0, 1 - d * x / (2 * math.pi)) for x in primes) == pytest.approx(3)


def test_void_needs_three(spark):
    tags = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id long, tag_id int")
    p = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "id long, angle double")
    assert lattice.void_profile(p.limit(2), tags).count() == 0
    assert lattice.void_profile(p, tags).count() == 1


def test_episode_fold():
    p = episodes.EpisodeParams()
    fold = episodes.EpisodeFold()
    kinds = [fold.step([0.0, 0.0], [1], p)[3], fold.step([0.1, 0.0], [1], p)[3], fold.step([5.0, 0.0], [2], p)[3], fold.step([0.0, 0.1], [1], p)[3]]
    assert kinds == ["first", "stay", "drift", "revisit"]
    again = episodes.EpisodeFold.load(fold.dump())
    assert again.step([0.0, 0.1], [1], p) == fold.step([0.0, 0.1], [1], p)


def test_episode_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, 10 * k + i, 1_700_000_000 + i, rng.normal(0, 0.3, 4).tolist(), [i % 3]) for k in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "key long, op_id long, s long, centroid array<double>, tags array<int>").selectExpr("key", "op_id", "timestamp_seconds(s) AS occurred_at", "centroid", "tags")
    want = sorted(episodes.assign_episodes(df).collect())
    df.write.parquet(str(tmp_path / "ops"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ops"))
    q = episodes.stream_episodes(stream).writeStream.format("memory").queryName("ep").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("ep").collect()) == want


def test_first_observation_has_full_diversity(spark):
    o = spark.createDataFrame([("b", 1, 0, [1, 2], 1), ("b", 2, 1, [1, 2], 1)], "block_key string, retrieval_id long, s long, query_tags array<int>, max_activations int").selectExpr("block_key", "retrieval_id", "timestamp_seconds(s) AS observed_at", "query_tags", "max_activations")
    got = [r["diversity"] for r in directional.inflow_fold(o).orderBy("retrieval_id").collect()]
    assert got == [1.0, 0.0]


def test_ema_fold(spark):
    rows = [(1, i, float(i)) for i in range(5)]
    got = directional.ema_fold(spark.createDataFrame(rows, "k int, i int, v double"), "k", ["i"], "v", 0.3).first()["ema"]
    want = 0.0
    for i in range(1, 5):
        want = 0.3 * i + 0.7 * want
    assert got == pytest.approx(want)


def test_gate_fails_open(spark):
    columns = "tag_a_id int, tag_b_id int, cooccurrence double, synchronicity double, semantic double, semiotic_forward double, semiotic_reverse double, glyph double, inhibition double, parallelness double"
    t = spark.createDataFrame([(1, 2, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], columns)
    seeds = spark.createDataFrame([(1,)], "tag_id int")
    t = t.unionByName(spark.createDataFrame([(1, 3, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], columns))
    for edges, want in (([], {2, 3}), ([(1, 9, 0.9)], {2, 3}), ([(1, 3, 0.2)], {2, 3}), ([(1, 3, 0.9), (2, 3, 0.9)], {3})):
        gate = spark.createDataFrame(edges, "tag_a_id int, tag_b_id int, strength double")
        assert {r["partner"] for r in tensor.partner_scores(t, seeds, gate).collect()} == want


def test_tags_and_hashes(spark):
    df = spark.createDataFrame([(" Deep  Work_X! ", "file.md [2/5]")], "t string, s string")
    row = df.select(S.normalize_tag(F.col("t")).alias("t"), S.source_name(F.col("s")).alias("s"), S.source_tag(F.col("s")).alias("g"), S.canonical_tag(F.lit("proj-Deep__Work"), "proj").alias("c")).first()
    assert row["t"] == "deep-workx" and row["s"] == "file.md" and row["g"] == "file" and row["c"] == "deep-work"


def test_poincare_round_trip(spark):
    df = spark.createDataFrame([([0.3, -0.4],)], "v array<double>")
    p = S.exp_origin(F.col("v"))
    row = df.select(S.log_origin(p).alias("back"), S.ball_distance(p, p).alias("d"), S.mobius_add(p, F.transform(p, lambda x: -x)).alias("z")).first()
    assert row["back"] == pytest.approx([0.3, -0.4]) and row["d"] == 0.0 and row["z"] == pytest.approx([0, 0], abs=1e-12)


def test_chunks():
    assert text.chunks("") == [] and text.chunks("short") == [(None, "short")]
    body = "# One\n\n" + "A sentence here. " * 300 + "\n\n# Two\n\nend of it"
    found = text.chunks(body, 1000, 100)
    assert {t for t, _ in found} == {"One", "Two"} and all(len(c) <= 1600 for _, c in found)
    assert all(len(c) <= 100 for c in text.embedding_chunks("word " * 500, 100))
    assert text.chunks(None) == [] and text.summarise(None) == ""


def test_criticality_bounds(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "doc_id int, tags array<string>")
    known = spark.createDataFrame([("a", 3)], "name string, cnt int")
    got = {r["doc_id"]: r["score"] for r in text.criticality(docs, known).collect()}
    assert got[2] == pytest.approx(0.6 * 1.0 + 0.4 * 0.25) and got[3] == 0.0


def test_alignment_and_hidden_bridges(spark):
    names = spark.createDataFrame([(i, f"p_{n}") for i, n in enumerate("abcd")], "tag_id int, name string")
    e = spark.createDataFrame([(0, 1, "glyph", 0.5), (1, 2, "semantic", 0.4), (2, 3, "glyph", 0.3)], "a int, b int, layer string, score double")
    g = align.named_edges(e, names, "p")
    cells = align.alignment(g, g)
    assert cells.filter("scope = 'pair'").count() == 3
    assert align.hidden_bridges(cells, cells).count() == 0


def test_terms(spark):
    df = spark.createDataFrame([("Alpha beta",), ("gamma",)], "t string")
    assert df.filter(motifs.matches_terms(F.col("t"), "alpha, x", "beta")).count() == 0
    assert df.filter(motifs.matches_terms(F.col("t"), "", "beta")).count() == 1


def test_dormant_needs_spread(spark):
    phase = spark.createDataFrame([(i, 0.0, 0.6, "dormant_reactivation", 0.42) for i in range(4)], "tag_id int, temperature double, retrieval_freq double, quadrant string, off_diagonal_distance double")
    assert trends.dormant_reactivations(phase, params=Params(sigma=0.1)).count() == 0
