"""Retrieval over the tag graph against plain loops and examples worked by hand."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tagloom.operators import graph as G
from tagloom.operators import lexical as LX
from tagloom.operators import retrieval as RE
from tagloom.operators import tensor as T
from tagloom.params import Params

COLUMNS = "tag_a_id int, tag_b_id int, cooccurrence double, synchronicity double, semantic double, semiotic_forward double, semiotic_reverse double, glyph double, inhibition double, parallelness double"
P = Params()


def edge(a, b, co=0.0, sync=0.0, sem=0.0, fwd=0.0, rev=0.0, glyph=0.0, inhib=0.0, par=0.0):
    return a, b, co, sync, sem, fwd, rev, glyph, inhib, par


def strength(e):
    _, _, co, sync, sem, _, _, glyph, inhib, par = e
    out = 0.5 * co + 0.3 * sync + 0.2 * sem + 0.2 * glyph
    if sync > 0 and glyph > 0:
        out += 0.4 * sync * glyph
    return out - (0.2 * inhib * -par if inhib > 0 and par < 0 else 0.0)


def table(spark, edges):
    return spark.createDataFrame(edges, COLUMNS)


def test_fan_out_by_hand(spark):
    # 1 - 2 at 0.5, 2 - 3 at 0.8 (0.4 at the second hop), 3 - 4 too far; 1 - 5 too weak; 2 has two edges, 3 two.
    t = table(spark, [edge(1, 2, co=1.0), edge(2, 3, co=1.6), edge(3, 4, co=1.0), edge(1, 5, co=0.2)])
    seeds = spark.createDataFrame([(1,)], "tag_id int")
    assert {r["tag_id"]: r["score"] for r in G.fan_out(t, seeds).collect()} == {2: pytest.approx(0.25)}
    assert {r["tag_id"]: r["score"] for r in G.fan_out(t, seeds, 2).collect()} == {2: pytest.approx(0.25), 3: pytest.approx(0.2)}
    assert G.fan_out(t, seeds, 0).count() == 0


def test_inward_ratio_by_hand(spark):
    # 9 meets both seeds and one other tag, 8 one seed of two and three others.
    t = table(spark, [edge(1, 9), edge(2, 9), edge(5, 9), edge(1, 8), edge(5, 8), edge(6, 8), edge(7, 8)])
    seeds = spark.createDataFrame([(1,), (2,)], "tag_id int")
    scores = spark.createDataFrame([(1, 1.0), (2, 1.0), (8, 0.5), (9, 0.6)], "tag_id int, score double")
    got = {r["tag_id"]: (r["convergence"], r["inward"]) for r in G.inward_ratio(t, seeds, scores).collect()}
    assert got == {9: (1.0, pytest.approx(2 / 3)), 8: (0.5, 0.25)}
    kept = {r["tag_id"]: r["score"] for r in G.prune_by_inward(t, seeds, scores, p=Params(min_inward=0.3)).collect()}
    assert kept == {1: 1.0, 2: 1.0, 9: pytest.approx(0.4)}
    # In two hops over scored tags seed 2 reaches 8 by no way: 9 and 8 aren't neighbours.
    assert {r["tag_id"]: r["convergence"] for r in G.inward_ratio(t, seeds, scores, 2).collect()} == {9: 1.0, 8: 0.5}


def test_in_through_out(spark):
    # 5 and 6 signify seed 1; both signify 7; 6 is a signifier and no sibling; 5 signifies seed 2.
    t = table(spark, [edge(1, 5, rev=0.5), edge(1, 6, rev=0.4), edge(5, 7, fwd=0.6), edge(6, 7, fwd=0.5), edge(5, 6, fwd=0.9), edge(2, 5, rev=0.9), edge(3, 5, rev=0.04)])
    got = T.in_through_out(t, spark.createDataFrame([(1,), (2,)], "tag_id int")).collect()
    assert [(r["tag_id"], r["strength"], r["paths"], r["score"]) for r in got] == [(7, pytest.approx(0.54), 2, pytest.approx(0.54 * (1 + math.log(2))))]


def test_convergence(spark):
    # Seed 1 signifies 4 and 5; both signify 7; 7 and 8 are tags of m1, seed 1 of m2.
    t = table(spark, [edge(1, 4, fwd=0.2), edge(1, 5, fwd=0.3), edge(4, 7, fwd=0.1), edge(5, 7, fwd=0.9), edge(5, 8, fwd=0.9), edge(1, 7, rev=0.9)])
    tags = spark.createDataFrame([("m1", 7), ("m1", 8), ("m2", 1), ("m3", 9)], "memory_id string, tag_id int")
    got = G.semiotic_convergence(t, spark.createDataFrame([(1,)], "tag_id int"), tags).collect()
    assert [(r["memory_id"], r["convergence"]) for r in got] == [("m1", 3.0)]


def test_glyphs_skip_edges_between_seeds(spark):
    t = table(spark, [edge(1, 2, glyph=0.9), edge(1, 3, glyph=0.5, co=1.0), edge(2, 4, glyph=0.4, inhib=1.0, par=-1.0)])
    tags = spark.createDataFrame([(10, 3), (11, 4), (12, 2)], "memory_id int, tag_id int")
    got = T.glyph_associations(t, spark.createDataFrame([(1,), (2,)], "tag_id int"), tags).collect()
    assert {r["memory_id"]: r["score"] for r in got} == {10: 1.0, 11: pytest.approx(0.2 / 0.8)}


def test_index(spark):
    rows = [(1, "deep-work", True), (2, "deep", True), (3, "month-05", True), (4, "x", True), (5, "2024", True), (6, "a_bc_def", True), (7, "gone-tag", False)]
    got = LX.lexical_index(spark.createDataFrame(rows, "tag_id int, name string, is_active boolean")).collect()
    assert sorted((r["term"], r["tag_id"], r["exact"]) for r in got) == [("a_bc_def", 6, True), ("deep", 1, False), ("deep", 2, True), ("deep-work", 1, True), ("def", 6, False), ("work", 1, False)]
    q = spark.createDataFrame([(1, "Deep WORK of it"), (2, "no"), (3, None)], "query_id int, text string")
    assert sorted(map(tuple, LX.lexical_match(q, spark.createDataFrame(rows, "tag_id int, name string, is_active boolean")).collect())) == [(1, 1), (1, 2)]


def plain_score(text, tags, edges, memory_tags):
    """score_lexical of one query, with sets and dicts."""
    index, exact = {}, {}
    for i, name in tags:
        exact.setdefault(name, set()).add(i)
        for term in {name, *(x for x in re.split("[-_]", name) if len(x) >= 3 and re.search("[-_]", name))}:
            index.setdefault(term, set()).add(i)
    near, size = {}, {}
    for e in edges:
        for a, b in (e[:2], e[1::-1]):
            near.setdefault(a, {})[b] = strength(e)
            size[a] = size.get(a, 0) + 1
    words = [w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) >= 3]
    seeds, scores = set(), {}
    for i, w in enumerate(words):
        ids, own = index.get(w, set()), exact.get(w, set())
        direct = set() if own and len(ids) > 2 * len(own) else set(own or ids)
        if i + 1 < len(words):
            direct |= index.get(f"{w}-{words[i + 1]}", set())
        direct |= {t for t in scores if t not in seeds and t in ids}
        new = direct - seeds
        seeds |= direct
        for s in new:
            for b, x in near.get(s, {}).items():
                if b not in new and x >= 0.3:
                    best = max(near[o][b] for o in new if b in near.get(o, {}))
                    scores[b] = max(scores.get(b, 0), best / size[b])
    out = {s: 1.0 for s in seeds}
    for t, x in scores.items():
        if t not in seeds:
            met = sum(s in near.get(t, {}) for s in seeds)
            ratio = met / len(seeds) * met / size[t]
            if ratio >= 0.01 * math.sqrt(len(seeds) / 4):
                out[t] = x * ratio
    found = {}
    for m, t in memory_tags:
        if t in out:
            found[m] = max(found.get(m, 0), out[t])
    return {m: x / max(found.values()) for m, x in found.items()}, seeds


def fixture(seed=1):
    rng = random.Random(seed)
    stems = ["red", "blue", "gear", "bolt", "ring", "deep"]
    names = [*stems, *sorted({f"{a}-{b}" for a in stems for b in stems if rng.random() < 0.4})]
    tags = list(enumerate(names))
    edges = [edge(a, b, *[round(rng.random(), 3) for _ in range(7)], round(rng.uniform(-1, 1), 3)) for a in range(len(names)) for b in range(a + 1, len(names)) if rng.random() < 0.35]
    memory_tags = sorted({(m, rng.randrange(len(names))) for m in range(40) for _ in range(3)})
    return rng, tags, edges, memory_tags


def test_score_lexical(spark):
    rng, tags, edges, memory_tags = fixture()
    texts = [(i, " ".join(rng.choice(["red", "blue", "gear", "bolt", "ring", "deep", "of", "unknown"]) for _ in range(rng.randint(0, 4)))) for i in range(12)]
    frames = spark.createDataFrame(texts, "query_id int, text string"), spark.createDataFrame(tags, "tag_id int, name string"), table(spark, edges), spark.createDataFrame(memory_tags, "memory_id int, tag_id int")
    scores, seeds = LX.score_lexical(*frames)
    got, named = {}, {}
    for r in scores.collect():
        got.setdefault(r["query_id"], {})[r["memory_id"]] = r["score"]
    for r in seeds.collect():
        named.setdefault(r["query_id"], set()).add(r["tag_id"])
    for i, text in texts:
        want, words = plain_score(text, tags, edges, memory_tags)
        assert named.get(i, set()) == words
        assert got.get(i, {}) == pytest.approx(want)


def test_retrieve(spark):
    """The whole way equals the weighted sum of its channels, each computed alone."""
    rng, tags, edges, memory_tags = fixture(2)
    vectors = [(m, 0, [rng.gauss(0, 0.6) for _ in range(4)]) for m in range(40)]
    queries = [(i, t, [rng.gauss(0, 0.6) for _ in range(4)]) for i, t in enumerate(["red gear", "deep", "nothing here"])]
    q = spark.createDataFrame(queries, "query_id int, text string, embedding array<double>")
    v = spark.createDataFrame(vectors, "memory_id int, chunk_index int, embedding array<double>")
    mt, tg, t = spark.createDataFrame(memory_tags, "memory_id int, tag_id int"), spark.createDataFrame(tags, "tag_id int, name string"), table(spark, edges)
    centroids = mt.join(v, "memory_id").groupBy("tag_id").agg(F.first("embedding").alias("centroid"))
    got = RE.retrieve(q, v, mt, tg, t, centroids, k=5).collect()
    of = {}
    for m, x in memory_tags:
        of.setdefault(m, set()).add(x)
    by_pair = {e[:2]: e for e in edges}
    for i, text, x in queries:
        sims = sorted(((m, sum(a * b for a, b in zip(x, y, strict=True))) for m, _, y in vectors), key=lambda z: (-z[1], z[0]))[:45]
        sims = [(m, s) for m, s in sims if s >= P.similarity_threshold][:15]
        scores = {m: 0.7 * s for m, s in sims}
        for m, s in plain_score(text, tags, edges, memory_tags)[0].items():
            scores[m] = scores.get(m, 0) + 0.15 * s
        context = {x for m, _ in sims[:5] for x in of.get(m, ())}
        partners, glyphs = {}, {}
        for (a, b), e in by_pair.items():
            for c, d in ((a, b), (b, a)):
                if c in context and d not in context:
                    if strength(e) >= 0.3:
                        partners[d] = max(partners.get(d, 0), strength(e))
                    g = e[7] + 0.3 * e[2] - (0.2 * e[8] * -e[9] if e[8] > 0 and e[9] < 0 else 0)
                    if e[7] > 0 and g > 0:
                        glyphs[d] = max(glyphs.get(d, 0), g)
        out = {}
        for a, b, *_, in edges:
            e = by_pair[a, b]
            if e[5] > 0.05:
                out.setdefault(a, {})[b] = e[5]
            if e[6] > 0.05:
                out.setdefault(b, {})[a] = e[6]
        via = {}
        for a, to in out.items():
            if a not in context and (s := max((s for b, s in to.items() if b in context), default=0)):
                via[a] = s
        paths = {}
        for a, s in via.items():
            for b, x2 in out[a].items():
                if b not in context and b not in via:
                    paths.setdefault(b, []).append(s * x2)
        for b, found in paths.items():
            partners[b] = max(partners.get(b, 0), 0.3 * max(found) * (1 + math.log(len(found))))
        for part, w in ((partners, 0.15), (glyphs, 0.10)):
            best = {m: max((part.get(x, 0) for x in of.get(m, ())), default=0) for m, _ in sims}
            top = max(best.values(), default=0) if w == 0.15 else max(part.values(), default=0)
            for m, s in best.items():
                if s > 0:
                    scores[m] += w * s / top
        middle = {b for a in context for b in out.get(a, {}) if b not in context}
        conv = {m: sum(x in out.get(a, {}) for x in of.get(m, set()) - context for a in middle) for m, _ in sims}
        if max(conv.values(), default=0):
            for m, c in conv.items():
                scores[m] += 0.12 * c / max(conv.values())
        want = sorted(scores.items(), key=lambda z: (-round(z[1], 9), z[0]))[:5]
        mine = sorted((r["rank"], r["memory_id"], r["score"]) for r in got if r["query_id"] == i)
        assert [m for _, m, _ in mine] == [m for m, _ in want]
        assert [s for *_, s in mine] == pytest.approx([s for _, s in want], abs=1e-6)
