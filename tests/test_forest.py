"""Forest updates against a plain version, one batch and two."""

import hashlib
import itertools
import math

import pytest

from tagloom.operators import forest as FO

ACTIVE = "scope_id string, target_type string, target_id string"
SCOPES = {"r1": ([2, 10, 3], ["m", "n"]), "r2": ([2, 10], ["n"]), "r3": ([3], ["m"]), "r4": ([7, 9], []), "r5": ([], ["n", "m"]), "r6": ([2, 10], ["o"])}
GATE = [(2, 3), (2, 10), (3, 99)]


def rows(names):
    return [(s, k, str(i)) for s in names for k, ids in zip(("tag", "memory"), SCOPES[s], strict=True) for i in ids]


def plain(names):
    raw = {}
    for s in names:
        tags, memories = sorted(SCOPES[s][0]), sorted(SCOPES[s][1])
        for a, b in itertools.combinations(tags, 2):
            if (a, b) in GATE:
                raw["tag", str(a), str(b)] = raw.get(("tag", str(a), str(b)), 0) + 1
        for a, b in itertools.combinations(memories, 2):
            raw["memory", a, b] = raw.get(("memory", a, b), 0) + 1
    return raw


@pytest.fixture(scope="module")
def given(spark):
    gate = spark.createDataFrame(GATE, "tag_a_id int, tag_b_id int")
    counts = spark.createDataFrame([("tag", "2", 3), ("tag", "10", 3), ("tag", "3", 2), ("memory", "m", 3)], "target_type string, target_id string, n long")
    total = spark.createDataFrame([(6,)], "total long")
    return gate, counts, total, lambda r: spark.createDataFrame(r, ACTIVE)


def read(edges):
    return {(r["left_type"], r["left_id"], r["right_id"]): (r["raw_count"], r["expected_count"], r["co_strength"], r["evidence_count"]) for r in edges.collect()}


def test_edges(given):
    gate, counts, total, make = given
    # Repeated rows count once, rows with nulls not at all.
    noisy = rows(SCOPES) + rows(["r1"]) + [(None, "tag", "2"), ("r3", "tag", None)]
    got = read(FO.grow_edges(None, make(noisy), "retrieval", gate, counts, total))
    n = {("tag", "2"): 3, ("tag", "10"): 3, ("tag", "3"): 2, ("memory", "m"): 3}
    want = {}
    for (kind, a, b), raw in plain(SCOPES).items():
        expected = n.get((kind, a), 1) * n.get((kind, b), 1) / 6
        want[kind, a, b] = (raw, expected, max(0.0, math.log(raw / expected)), raw)
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert v == pytest.approx(want[k])


def test_two_batches_are_one(given):
    gate, counts, total, make = given
    whole = FO.grow_edges(None, make(rows(SCOPES)), "retrieval", gate, counts, total)
    first = FO.grow_edges(None, make(rows(["r1", "r5"])), "retrieval", gate, counts, total)
    second = FO.grow_edges(first, make(rows(["r2", "r3", "r4", "r6"])), "retrieval", gate, counts, total)
    got, want = read(second), read(whole)
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert v == pytest.approx(want[k])
    other = FO.grow_edges(whole, make(rows(["r2"])), "store", gate, counts, total)
    assert other.count() == whole.count() + 1
    assert FO.grow_edges(whole, make([]), "retrieval", gate, counts, total).count() == whole.count()


def test_blocks_and_snapshots(given):
    gate, counts, total, make = given
    active = make(rows(SCOPES))
    edges = FO.grow_edges(None, active, "retrieval", gate, counts, total)
    strength = {(k[1], k[2]): v[2] for k, v in read(edges).items() if k[0] == "tag"}

    def key(tags):
        return hashlib.sha256(f"cooccurrence:tag_set:{','.join(sorted(map(str, tags)))}".encode()).hexdigest()[:32]

    got = {r["block_key"]: (r["density"], r["evidence_count"]) for r in FO.grow_blocks(None, active, edges, gate).collect()}
    # r3 has no pair, r4 none inside the gate, r5 no tags.
    assert got.keys() == {key([2, 10, 3]), key([2, 10])}
    assert got[key([2, 10])] == pytest.approx((strength["2", "10"], 2))
    assert got[key([2, 10, 3])] == pytest.approx(((strength["2", "10"] + strength["2", "3"]) / 2, 1))
    again = FO.grow_blocks(FO.grow_blocks(None, active, edges, gate), make(rows(["r6"])), edges, gate)
    assert {r["block_key"]: r["evidence_count"] for r in again.collect()} == {key([2, 10]): 3, key([2, 10, 3]): 1}
    held = {(r["block_key"], r["target_type"], r["target_id"]): r["strength"] for r in FO.memberships(active, edges, gate).collect()}
    assert held[key([2, 10, 3]), "tag", "2"] == pytest.approx((strength["2", "10"] + strength["2", "3"]) / 2)
    assert held[key([2, 10, 3]), "memory", "m"] == 1.0
    shots = {r["trigger_id"]: r for r in FO.snapshots(active, "retrieval", gate, edges, edges.limit(0), edges.limit(2)).collect()}
    assert shots.keys() == {"r1", "r2", "r5", "r6"}
    assert shots["r1"]["tag_ids"] == ["2", "3", "10"] and shots["r1"]["memory_ids"] == ["m", "n"] and shots["r5"]["block_key"] is None
    assert (shots["r1"]["co_edge_count"], shots["r1"]["bridge_edge_count"], shots["r1"]["block_count"]) == (len(read(edges)), 0, 2)
