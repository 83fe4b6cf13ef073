"""Motifs on small graphs, against plain versions."""

import itertools
import math
import random

import pytest

from tagloom.operators import motifs as MO

EDGES = "a int, b int, score double, layer string, profile array<double>"


def table(spark, edges):
    at = MO.LAYER_ORDER.index
    return spark.createDataFrame([(a, b, s, x, [s if i == at(x) else 0.0 for i in range(6)]) for a, b, s, x in edges], EDGES)


def test_shared_memories_add_to_interest(spark):
    square = table(spark, [(1, 2, 0.9, "semantic"), (2, 3, 0.8, "glyph"), (3, 4, 0.7, "semantic"), (1, 4, 0.6, "glyph")])
    evidence = spark.createDataFrame([(1, 2, "m"), (1, 2, "n"), (2, 3, "m"), (2, 3, "m"), (3, 4, "m"), (3, 4, "n"), (8, 9, "m")], "a int, b int, memory_id string")
    plain = MO.square_motifs(square, square).first()
    rich = MO.square_motifs(square, square, evidence=evidence).first()
    # The side without memories doesn't count; only m is on the other three.
    assert (plain["shared"], rich["shared"]) == (0, 1)
    assert rich["interestingness"] == pytest.approx(plain["interestingness"] + 0.05 * math.log(2))
    lone = evidence.filter("a = 1")
    assert MO.square_motifs(square, square, evidence=lone).first()["shared"] == 0


def test_edge_evidence(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    held = spark.createDataFrame([("m", 1), ("m", 2), ("m", 2), ("m", 3), ("n", 1), ("n", 3), ("o", None)], "memory_id string, tag_id int")
    assert sorted(map(tuple, MO.edge_evidence(edges, held).collect())) == [(1, 2, "m"), (2, 3, "m")]


def test_neighbouring_sides_of_one_layer(spark):
    square = table(spark, [(1, 2, 0.9, "semantic"), (2, 3, 0.8, "semantic"), (3, 4, 0.7, "glyph"), (1, 4, 0.6, "glyph")])
    assert MO.square_motifs(square, square).count() == 0
    assert MO.square_motifs(square, square, distinct_sides=False).first()["tag_ids"] == [1, 2, 3, 4]
    assert MO.square_motifs(square, square, distinct_sides=False, min_colors=3).count() == 0


def test_select_by_names(spark):
    edges = table(spark, [(1, 2, 0.9, "glyph"), (2, 3, 0.04, "glyph"), (1, 3, 0.5, "glyph")])
    names = spark.createDataFrame([(1, "ab"), (2, "c"), (3, "de")], "tag_id int, name string")
    assert {(r["a"], r["b"]) for r in MO.select_edges(edges).collect()} == {(1, 2), (1, 3)}
    assert {(r["a"], r["b"]) for r in MO.select_edges(edges, names=names).collect()} == {(1, 3)}


def longest(near, layer, u, v, depth):
    """By all simple paths, without an early end."""
    best, paths = 1, [(u, v)]
    for n in range(2, depth + 1):
        paths = [p + (w,) for p in paths for w in near.get((layer, p[-1]), []) if w not in p]
        best = n if paths else best
    return best


def plain_contrast(edges, depth, branching, side, probes):
    near = {}
    for layer in MO.LAYER_ORDER:
        for node in {x for a, b, _, _ in edges for x in (a, b)}:
            near[layer, node] = [b if a == node else a for a, b, _, x in edges if x == layer and node in (a, b)][:branching]
    out = {}
    for layer in {x for *_, x in edges}:
        own = [(a, b) for a, b, _, x in edges if x == layer][:probes]
        along = [max(longest(near, layer, a, b, depth), longest(near, layer, b, a, depth)) for a, b in own]
        beside = []
        for e in own:
            found = [longest(near, x, u, v, depth) for u, x in itertools.product(e, MO.LAYER_ORDER) if x != layer for v in [w for w in near[x, u] if w not in e][:side]]
            beside.append(sum(found) / len(found) if found else 0.0)
        out[layer] = (len([1 for *_, x in edges if x == layer]), len(own), sum(along) / len(along), sum(beside) / len(beside))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_chain_contrast(seed):
    rng = random.Random(seed)
    pairs = rng.sample(list(itertools.combinations(range(14), 2)), 40)
    edges = [(a, b, 1 - i / 100, rng.choice(MO.LAYER_ORDER[:3])) for i, (a, b) in enumerate(pairs)]
    got = MO.chain_contrast([e[:2] for e in edges], [e[3] for e in edges], 5, 3, 2, 8, 1)
    want = plain_contrast(edges, 5, 3, 2, 8)
    assert got.keys() == want.keys()
    for layer, found in got.items():
        assert found == pytest.approx(want[layer])


def test_chain_baseline(spark):
    # One layer is a path, the other a star.
    edges = [(i, i + 1, 1 - i / 100, "semantic") for i in range(12)] + [(0, 100 + i, 0.5 - i / 100, "glyph") for i in range(12)]
    got = {r["layer"]: r for r in MO.chain_baseline(table(spark, edges), iterations=20).collect()}
    assert set(got) == {"semantic", "glyph"}
    assert got["semantic"]["axis_mean"] > got["glyph"]["axis_mean"] and got["semantic"]["z"] > 0
    assert all(1 / 21 <= r["p"] <= 1 for r in got.values())
    rng, order = random.Random(23), sorted(edges, key=lambda e: -e[2])
    contrasts = []
    for _ in range(20):
        dealt = [e[3] for e in order]
        rng.shuffle(dealt)
        found = plain_contrast([(a, b, s, x) for (a, b, s, _), x in zip(order, dealt, strict=True)], 6, 5, 2, 100)
        contrasts.append(found["semantic"][2] - found["semantic"][3])
    assert got["semantic"]["baseline_mean"] == pytest.approx(sum(contrasts) / 20)
    assert MO.chain_baseline(table(spark, edges).filter("score > 9")).count() == 0
    with pytest.raises(ValueError):
        MO.chain_baseline(table(spark, edges), bound=10)


def test_zigzag_pairs_and_vectors(spark):
    zigzag = [(1, 2, 0.9, "semantic"), (2, 3, 0.8, "glyph"), (3, 4, 0.7, "semantic"), (1, 4, 0.6, "glyph")]
    banded = [(11, 12, 0.9, "semantic"), (12, 13, 0.8, "semantic"), (13, 14, 0.7, "glyph"), (11, 14, 0.6, "glyph")]
    edges = table(spark, zigzag + banded)
    motifs = MO.square_motifs(edges, edges, min_colors=1, distinct_sides=False)
    # Opposite sides alike and neighbours not: 1; opposite unlike, two of four neighbours alike: -0.5.
    assert {r["tag_ids"][0]: r["vector_score"] for r in motifs.collect()} == pytest.approx({1: 1.0, 11: -0.5})
    assert [tuple(r) for r in MO.zigzag_pairs(motifs).collect()] == [("glyph|semantic", 1)]
    assert tuple(MO.zigzag_vectors(motifs).first()) == pytest.approx((2, 0.25, 0.5))
    assert tuple(MO.zigzag_vectors(motifs.limit(0)).first()) == (0, 0.0, 0.0)
    found = {(r["side_class"], r["signature"]) for r in MO.zigzag_report(motifs).collect()}
    assert found == {("zigzag", "glyph|semantic|glyph|semantic"), ("banded", "glyph|glyph|semantic|semantic")}
