"""Exact and near duplicates, and repeated strings, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import suffix_dedup
from tagloom.llm.exact_dedup import exact_dedup
from tagloom.llm.graph import components
from tagloom.llm.minhash import MinHashParams, WordHashes, band_keys, near_dedup, shingles, signature
from tagloom.llm.suffix_dedup import SuffixParams, brute_force, cut, deal, remove_repeats, repeated, suffix_array
from tests.llm.helpers import SCHEMA, clashing, corpus, frame, prose


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, keep):
    rows = corpus() + [(1000 + i, "hot", "en", "s") for i in range(200)] + [(None, "hot", "en", "s"), (None, "lone", None, None), (5000, "twice", "en", "s"), (5000, "twice", "en", "s")]
    got = exact_dedup(clashing(frame(spark, rows)), keep=keep).collect()
    groups: dict[str, list] = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = [i for i in groups[r["norm"]] if i is not None]
        want = (min(ids) if keep == "smallest" else max(ids)) if ids else None
        assert (r["keep_id"], r["group_size"]) == (want, len(groups[r["norm"]]))
    for t, ids in groups.items():
        kept = [r for r in got if r["norm"] == t and r["kept"]]
        assert len(kept) == 1 and kept[0]["id"] == kept[0]["keep_id"]


def test_exact_empty(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def links(rows, percent):
    hashes = WordHashes()
    sets = {i: set(shingles(t, 5, hashes).tolist()) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("percent", "block"), [(80, 250), (85, 250), (85, 3)])
def test_near(spark, percent, block):
    rows = corpus()
    rng = random.Random(5)
    family = prose(rng, 120).split()
    for i in range(25):  # a chain: each differs a little from the one before
        family[4 * i] = f"c{i}"
        rows.append((2000 + i, " ".join(family), "en", "s"))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup(clashing(frame(spark, rows)), params=MinHashParams(percent=percent, block=block, lot=block, rows_per_task=10 * block)).collect()}
    assert got == links(rows, percent)


def test_near_families(spark):
    """Members of one bucket in many components: a hub sees few of their links."""
    rng, rows = random.Random(15), []
    base = prose(rng, 100).split()
    for f in range(6):
        own = list(base)
        for k in rng.sample(range(100), 4):
            own[k] = f"f{f}x{k}"
        for m in range(12):
            w = list(own)
            if m:
                w[rng.randrange(100)] = f"m{f}x{m}"
            rows.append((100 * f + m, " ".join(w), "en", "s"))
    rng.shuffle(rows)
    for block in (250, 4):
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup(frame(spark, rows), params=MinHashParams(percent=85, block=block, lot=block)).collect()}
        assert got == links(rows, 85)


def test_near_edges(spark):
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (None, "w1 w2 w3 w4 w5 w6", "a", "b"), (7, "W1 w2  w3 w4\tw5 w6", "a", "b"), (7, "W1 w2  w3 w4\tw5 w6", "a", "b"), (8, "hi", "a", "b"), (9, "HI", "a", "b")]
    got = sorted((str(r["id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup(frame(spark, rows)).collect())
    assert got == [("1", 0, 1, True), ("2", 0, 2, True), ("7", 2, 7, True), ("7", 2, 7, True), ("8", 1, 8, True), ("9", 1, 8, False), ("None", 2, 7, False)]
    assert near_dedup(frame(spark, [])).count() == 0


def test_signature_estimates_similarity():
    rng, p = np.random.default_rng(0), MinHashParams()
    for n in (8, 60, 2000):
        agree = []
        for _ in range(40):
            x = rng.integers(0, 2**64, 2 * n, np.uint64, endpoint=False)
            a, b = np.unique(x[: int(1.5 * n)]), np.unique(x[int(0.5 * n) :])
            agree.append((signature(a, p) == signature(b, p)).mean())
        assert abs(np.mean(agree) - 0.5) < 0.06
    assert len(band_keys(signature(np.array([5], np.uint64), p), p)) == p.bands


def test_components(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(40)]
    rng.shuffle(path)
    e = spark.createDataFrame([*path, (100, 101), (103, 101)], "a long, b long")
    assert {r["component"] for r in components(e).collect()} == {0, 100}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(t):
    got = suffix_array(np.array(t, np.int64)).tolist()
    assert got == sorted(range(len(t)), key=lambda i: t[i:])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=40), min_size=1, max_size=6))
def test_repeated(texts):
    raw, span = [t.encode() for t in texts], 6
    which, offset = repeated(raw, np.arange(len(raw)), np.zeros(len(raw), np.int64), span)
    seen, want = set(), set()
    for i, t in enumerate(raw):
        for j in range(len(t) - span + 1):
            if t[j : j + span] in seen:
                want.add((i, j))
            seen.add(t[j : j + span])
    assert set(zip(which.tolist(), offset.tolist(), strict=True)) == want


def test_cut_covers_every_string():
    p = SuffixParams(span=20, gram=6)
    text = b"abc" * 30 + bytes(range(200))
    doc, start, count, *_ = cut([text, b"short", text], p)
    for d in (0, 2):
        covered = sorted(s + i for s, c, x in zip(start, count, doc, strict=True) if x == d for i in range(c))
        assert covered == list(range(len(text) - 19))


@pytest.mark.parametrize("crowd", [1, 2000])
def test_remove(spark, crowd):
    rows = [r for r in corpus() if r[0] is not None] + [(3000, "x" * 100, "a", "b"), (3001, "y" * 99, "a", "b"), (3002, "y" * 99, "a", "b")]
    p = SuffixParams(bucket_bytes=4000, piece_bytes=3000, crowd=crowd)
    out = remove_repeats(clashing(frame(spark, rows)), params=p)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out.collect()}
    assert got == brute_force({i: (t or "").encode() for i, t, *_ in rows}, 100)
    assert sum(x[1] for x in got.values()) > 1000


def removed(df):
    return {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()}


def test_remove_short_strings(spark):
    """Strings shorter than the longer anchors."""
    rows = [r for r in corpus() if r[0] is not None]
    got = removed(remove_repeats(frame(spark, rows), params=SuffixParams(span=40, gram=12, bucket_bytes=4000, crowd=5)))
    assert got == brute_force({i: (t or "").encode() for i, t, *_ in rows}, 40)


def test_common_phrases_ask_for_little(spark, monkeypatch):
    """A phrase in very many different texts, and nothing longer: its strings don't go to the sort."""
    rng, made, write = random.Random(8), [], suffix_dedup.materialise
    phrase = "".join(rng.choice("abcdefgh ") for _ in range(40))
    rows = [(i, f"{prose(rng, 30)} {phrase} {prose(rng, 30)}", "en", "s") for i in range(300)]
    rows += [(300, rows[0][1][:230] + prose(rng, 30), "en", "s"), (301, rows[1][1], "en", "s")]
    monkeypatch.setattr(suffix_dedup, "materialise", lambda df, name: made.append(write(df, name)) or made[-1])
    got = removed(remove_repeats(frame(spark, rows), params=SuffixParams(crowd=50)))
    assert got == brute_force({i: t.encode() for i, t, *_ in rows}, 100)
    assert got[300][1] >= 230 and got[301][1] == len(rows[1][1])
    asked = made[-1].filter(F.col("kind") == suffix_dedup.WANTED).agg(F.sum("count")).first()[0]
    assert 0 < asked < 500


def test_repeats_of_a_batch_take_turns():
    """Repeats that every batch finds, of one passage, don't go to one group, and blobs don't multiply by batches."""
    rng = random.Random(9)
    passage = prose(rng, 60)
    parts = [(np.arange(3 * i, 3 * i + 3), [f"{prose(rng, 20)} {passage}".encode() for _ in range(3)], np.zeros(3, np.int64)) for i in range(8)]
    one_by_one = [k for k, _ in deal(iter(parts), SuffixParams(bucket_bytes=1), 4, 0) if k < 0]
    assert sorted(one_by_one) == [-4, -4, -3, -3, -2, -2, -1, -1]
    by_task = [k for turn in range(4) for k, _ in deal(iter(parts[:1]), SuffixParams(), 4, turn) if k < 0]
    assert sorted(by_task) == [-4, -3, -2, -1]
    assert len(list(deal(iter(parts), SuffixParams(), 4, 0))) <= 5


def test_digests_tell_fragments_apart():
    """The two digests of every run of strings: equal for equal bytes wherever they stand, different otherwise."""
    rng, p = random.Random(4), SuffixParams(span=20, gram=6)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 60))) for _ in range(60)]
    texts = ["".join(rng.choice(parts) for _ in range(12)).encode() for _ in range(30)]
    doc, start, count, anchor, one, two = cut(texts, p)
    seen: dict[tuple, bytes] = {}
    for d, s, c, *key in zip(doc, start, count, anchor, one, two, strict=True):
        raw = texts[d][s : s + c + 19]
        assert seen.setdefault((c, *key), raw) == raw
    assert len(set(seen.values())) == len({k[2:] for k in seen}) == len({k[3:] for k in seen})


def test_remove_edges(spark):
    long = "abcdefghij" * 15
    rows = [(None, long, "a", "b"), (4, long, "a", "b"), (4, long, "a", "b"), (5, None, "a", "b")]
    got = sorted((str(r["id"]), r["n_bytes"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("4", 150, 140), ("4", 150, 140), ("5", 0, 0), ("None", 150, 0)]
    assert remove_repeats(frame(spark, [])).count() == 0


def test_normalised_text_is_whole(spark):
    got = exact_dedup(frame(spark)).agg(F.max(F.length("norm"))).first()[0]
    assert got == max(len(t or "") for _, t, *_ in corpus())
