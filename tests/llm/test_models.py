"""Language, toxicity, quality and benchmark passages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import decontaminate
from tagloom.llm.crf import Chain, marginals
from tagloom.llm.decontaminate import DecontaminationParams, PlainWords, best_match, contaminated, key_filter, plain_words, probes
from tagloom.llm.ppm import Index, PpmModel, PpmParams, codes_at, identify, laid, plain, split
from tagloom.llm.quality import line_features, score_quality
from tagloom.llm.toxicity import score_toxicity
from tests.llm.helpers import clashing, frame, prose


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(5):
        n, step, first = 7, np.exp(rng.normal(size=(2, 2))), np.exp(rng.normal(size=2))
        u, starts = rng.normal(size=n), np.array([1, 0, 0, 0, 1, 0, 1.0])
        p = marginals(u, starts, step, first)[0]
        total, on = 0.0, np.zeros(n)
        for k in range(1 << n):
            y = [k >> i & 1 for i in range(n)]
            w = np.prod([np.exp(u[i] * y[i]) * (first[y[i]] if starts[i] else step[y[i - 1], y[i]]) for i in range(n)])
            total += w
            on += w * np.array(y)
        assert p == pytest.approx(on / total)
    assert len(marginals(np.empty(0), np.empty(0), np.ones((2, 2)), np.ones(2))[0]) == 0


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    u, starts, y = rng.normal(size=9), np.array([1, 0, 0, 0, 0, 1, 0, 0, 0.0]), rng.integers(0, 2, 9)

    def likelihood(c, v):
        step, first = np.exp(c.transition), np.exp([0.0, c.first])
        logs = []
        for a, b in ((0, 5), (5, 9)):
            x = first * np.array([1, np.exp(v[a])])
            for i in range(a + 1, b):
                x = (x @ step) * np.array([1, np.exp(v[i])])
            own = np.log(first[y[a]]) + sum(v[i] * y[i] for i in range(a, b)) + sum(c.transition[y[i - 1], y[i]] for i in range(a + 1, b))
            logs.append(own - np.log(x.sum()))
        return sum(logs)

    c = Chain(rng.normal(size=(2, 2)), 0.3)
    g_u, g_t, g_f = c.gradient(u, starts, y)
    h = 1e-5
    up, down = u.copy(), u.copy()
    up[4], down[4] = u[4] + h, u[4] - h
    assert g_u[4] == pytest.approx((likelihood(c, up) - likelihood(c, down)) / (2 * h), abs=1e-6)
    for i in range(2):
        for j in range(2):
            d = np.zeros((2, 2))
            d[i, j] = h
            assert g_t[i, j] == pytest.approx((likelihood(Chain(c.transition + d, 0.3), u) - likelihood(Chain(c.transition - d, 0.3), u)) / (2 * h), abs=1e-6)
    assert g_f == pytest.approx((likelihood(Chain(c.transition, 0.3 + h), u) - likelihood(Chain(c.transition, 0.3 - h), u)) / (2 * h), abs=1e-6)


def reference_bits(train: bytes, text: bytes, order: int) -> float:
    """Prediction by partial matching, one byte at a time."""
    gap = b" " * order
    grams = [(gap + train)[i : i + order + 1] for i in range(len(train))]
    total = 0.0
    for i in range(len(text)):
        g = (gap + text)[i : i + order + 1]
        for k in range(order, -1, -1):
            after = [x[order] for x in grams if x[order - k : order] == g[order - k : order]]
            n, d = len(after), len(set(after))
            if n == 0:
                continue
            if g[order] in after:
                total -= np.log2(after.count(g[order]) / (n + d))
                break
            total -= np.log2(d / (n + d))
        else:
            total += 8
    return total


@pytest.mark.parametrize("order", [2, 4, 7])
def test_code_lengths(order):
    train = {"a": b"the cat sat on the mat", "b": "der hund und die k\u00e4tze \u4e2d\u6587\u4e2d\u6587".encode()}
    texts = [b"the hat", "xyz k\u00e4tze".encode(), b"u", "\u4e2d\u6587\u0436".encode(), bytes(range(33, 60)) * 3]
    grams = [(i, *codes_at(*laid([v], order)[:2], order).tolist()) for i, v in enumerate(train.values())]
    lang, code = np.array([(i, c) for i, *cs in grams for c in cs], object).T
    model = PpmModel(list(train), order, lang.astype(np.int64), code.astype(np.uint64), np.ones(len(code)))
    got = model.lengths(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx([reference_bits(v, t, order) for v in train.values()], rel=1e-4)
    assert plain("\u00c4B") == "\u00c4b".encode()


def test_index():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 2**40, 5000, np.uint64))
    index = Index(codes)
    assert index.find(codes).tolist() == list(range(len(codes)))
    assert (index.find(codes + np.uint64(2**50)) == -1).all() and len(Index(codes[:0]).find(codes)) == len(codes)


def brute_language(rows, params):
    """Predictions by one model at a time, from whole texts in a plain loop."""
    import zlib

    train: dict[str, list[bytes]] = {}
    for i, t, lang, _ in rows:
        if t and lang and zlib.crc32(str(i).encode()) % 4 != 2:
            train.setdefault(lang, []).append(plain(t))
    models = {}
    for lang, texts in sorted(train.items()):
        codes = np.concatenate([codes_at(*laid([t], params.order)[:2], params.order) for t in texts])
        models[lang] = PpmModel([lang], params.order, np.zeros(len(codes), np.int64), codes, np.ones(len(codes)))
    return {i: min(models, key=lambda x: (models[x].lengths([plain(t)])[0, 0].round(3), x)) for i, t, *_ in rows if t}


def test_language_scripts(spark):
    """Two languages of one script that isn't Latin, and ties, repeated rows and rows without id or label."""
    rng = random.Random(3)
    kinds = {"ru": "\u0430\u0431\u0432\u0433\u0434\u0435\u0436", "uk": "\u0437\u0438\u043a\u043b\u043c\u043d\u0430", "zh": "\u4e2d\u6587\u5b57\u7b26\u4e32"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 40))), k, "s") for i in range(90) for k in [list(kinds)[i % 3]]]
    rows += [(500, rows[0][1], "ru", "s"), (500, rows[0][1], "ru", "s")]
    got = identify(clashing(frame(spark, rows)), split(F.col("id"), 4) != 2).collect()
    assert len(got) == len(rows)
    want = brute_language(rows, PpmParams())
    assert all(r["lang_pred"] == want[r["id"]] for r in got)
    assert np.mean([want[i] == k for i, _, k, _ in rows]) == 1


def languages(n=120):
    rng = random.Random(4)
    kinds = {"xx": "abdeilno", "yy": "ruostmck", "zz": "ghjpqvwa"}
    return [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(1, 60))), k, "s") for i in range(n) for k in [list(kinds)[i % 3]]]


def test_language(spark):
    rows = languages() + [(900, None, "xx", "s"), (901, "", "xx", "s"), (902, "12 34 !!", "xx", "s"), (None, "abide lonelad", None, "s"), (903, "abde " * 20000, None, "s")]
    got = {r["id"]: r for r in identify(clashing(frame(spark, rows)), split(F.col("id"), 4) != 2).collect()}
    held = [(i, k) for i, t, k, _ in languages() if len(t) > 20 and __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == k for i, k in held]) > 0.95
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "xx" and got[None]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_labels(spark):
    assert identify(frame(spark, [])).count() == 0
    assert identify(frame(spark, [(1, "text", None, None)])).first()["lang_pred"] == "und"


TOXIC = ["vile", "grot", "muck"]


def toxic_rows(n=300):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(20, 80)).split()
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            words[rng.randrange(len(words))] = rng.choice(TOXIC)
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = frame(spark, [(i, t, "en", "s") for i, t, _ in rows] + [(900, None, None, None), (901, "", "en", "s"), (None, "you vile grot, go", "en", "s"), (902, "fine word " * 20000, "en", "s")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["id"]: r for r in score_toxicity(clashing(docs), labels, split(F.col("id"), 4) != 2).collect()}
    held = [(i, y) for i, _, y in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i]["score"] >= 0.3) == y for i, y in held]) > 0.95
    text = "you vile grot, go"
    assert [text[s["start"] : s["end"]] for s in got[None]["spans"]] == ["vile grot,"]
    assert got[900]["score"] == got[901]["score"] < 0.3 and got[902]["score"] < 0.3


def test_scores_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "a text", "en", "s"), (2, None, "en", "s")])
    for f in (score_toxicity, score_quality):
        assert {r["score"] for r in f(docs, none).collect()} == {0.5}
        assert {r["score"] for r in f(docs, one).collect()} == {1.0}
        assert f(frame(spark, []), one).count() == 0


def test_quality(spark):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        lines = [prose(rng, rng.randint(5, 20)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines = [line.upper().replace(" ", "!! ") if rng.random() < 0.8 else line for line in lines]
        rows.append((i, "\n".join(lines), int(i % 3 != 0)))
    docs = frame(spark, [(i, t, "en", "s") for i, t, _ in rows] + [(900, None, None, None), (901, "", "en", "s"), (None, "x", "en", "s"), (902, "good line of words\n" * 20000, "en", "s")])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["id"]: r["score"] for r in score_quality(clashing(docs), labels, split(F.col("id"), 5) != 0).collect()}
    held = [(i, y) for i, _, y in rows if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == y for i, y in held]) > 0.85
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())


def test_line_features():
    x, sizes, starts = line_features(["a b\nA B\na b", None, ""])
    assert x.shape[0] == 5 and starts.tolist() == [True, False, False, True, True] and sizes.tolist() == [4, 4, 4, 1, 1]
    assert x[2, 9] == 1 and np.isfinite(x).all()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_best_match():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 4, 6), rng.integers(0, 4, 14)
        edits, lo, hi = best_match(a, b)
        assert edits == min(edit_distance(a, b[i:j]) for i in range(15) for j in range(i, 15)) == edit_distance(a, b[lo:hi])


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        k, kind = rng.randrange(len(w)), rng.randrange(3)
        w[k : k + 1] = [[], [prose(rng, 1)], [w[k], prose(rng, 1)]][kind]
    return w


def brute_contaminated(rows, items, p):
    """Pairs (document, item) by edit distance over whole texts."""
    words = PlainWords()
    sets = [(i, plain_words(t, words)) for i, t in items]
    out = set()
    for i, t, *_ in rows:
        doc = plain_words(t, words)
        out |= {(i, k) for k, w in sets if len(w) and len(doc) and best_match(w, doc)[0] <= p.edits(len(w))}
    return out


def test_contaminated(spark):
    rng, p = random.Random(6), DecontaminationParams()
    items = [(i, prose(rng, 25 + i)) for i in range(20)] + [(90, None), (91, "few words here"), (92, ""), (93, "!! --"), (94, prose(rng, 10000)), (95, prose(rng, 9)), (None, prose(rng, 30))]
    items += [items[2], items[2]]  # repeated
    rows = []
    for i in range(20):
        w = edited(rng, items[i][1].split(), i // 4)
        rows.append((i, prose(rng, 50) + " " + " ".join(w).upper().replace(" ", ", ") + "\n" + prose(rng, 30), "en", "s"))
    rows += [(100 + i, prose(rng, 300), "en", "s") for i in range(30)] + [(200, None, "en", "s"), (201, "", "en", "s"), (202, prose(rng, 20000), "en", "s"), (203, items[3][1][: len(items[3][1]) // 2], "en", "s")]
    rows += [(204, "Few WORDS, here!", "en", "s"), (205, "x " + " ".join(edited(rng, items[24][1].split(), 1500)), "en", "s"), (206, items[25][1], "en", "s"), (206, items[25][1], "en", "s")]
    rows += [(None, items[0][1], "en", "s"), (207, items[26][1], "en", "s")]
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS ID", "'x' AS words", "2 AS key")
    got = contaminated(clashing(frame(spark, rows)), b).collect()
    assert {(r["id"], r["item_id"]) for r in got} == brute_contaminated(rows, items, p)
    assert sum(r["id"] == 2 for r in got) == 3 and sum(r["id"] == 206 for r in got) == 2
    assert all(r["edits"] <= 1500 and r["end_word"] > r["first_word"] for r in got)
    assert contaminated(frame(spark, []), b).count() == 0
    assert contaminated(frame(spark, rows), b.limit(0)).count() == 0


def test_recall_at_most_edits(spark):
    """Of items with as many edits as are allowed, nine of ten at least are found."""
    rng, p = random.Random(16), DecontaminationParams()
    sizes = (5, 8, 10, 16, 20, 31, 59, 120, 400)
    items = [(i, prose(rng, sizes[i % len(sizes)])) for i in range(40 * len(sizes))]
    rows = [(i, prose(rng, 20) + " " + " ".join(edited(rng, t.split(), p.edits(len(t.split())))) + " " + prose(rng, 20), "en", "s") for i, t in items]
    got = {(r["id"], r["item_id"]) for r in contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = {n: np.mean([(i, i) in got for i, t in items if len(t.split()) == n]) for n in sizes}
    print("recall at the most edits", recall)
    assert min(recall.values()) >= 0.9


def test_filter_blocks(spark):
    items = spark.createDataFrame([(list(range(0, 10**6, 7)),), ([-5],)], "keys array<long>")
    width, bits = key_filter(items, DecontaminationParams())
    flags = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    assert width > 20 and len(flags) == 1 << width
    assert all(flags[x].all() for x in probes(np.arange(0, 10**6, 7).astype(np.uint64), width))
    assert np.mean(np.all([flags[x] for x in probes(np.arange(10**7, 10**7 + 10**5).astype(np.uint64), width)], 0)) < 0.01


def test_candidates_have_words_of_items(spark, monkeypatch):
    """Documents that share common words with the items, but too few for a match, make hardly any candidates; the matches stay."""
    made, materialise = {}, decontaminate.materialise
    monkeypatch.setattr(decontaminate, "materialise", lambda df, name: made.setdefault(name, materialise(df, name)))
    rng = random.Random(26)
    common = [f"common{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.7 else prose(rng, 1) for _ in range(n))) for i, n in enumerate([20, 40, 60] * 10)]
    mixed = [(i, " ".join(rng.choice(common) if rng.random() < 0.2 else f"other{rng.randrange(10**6)}" for _ in range(400)), "en", "s") for i in range(60)]
    planted = [(100 + i, prose(rng, 30) + " " + " ".join(edited(rng, t.split(), 2)) + " " + prose(rng, 30), "en", "s") for i, t in items]
    got = contaminated(frame(spark, mixed + planted), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(100 + i, i) for i, _ in items} <= {(r["id"], r["item_id"]) for r in got}
    candidates = made["decontaminate-regions"].filter("id < 100").select("id").distinct().count()
    print("candidates", candidates, "of", len(mixed))
    assert candidates <= len(mixed) // 4


def test_words_of_many_texts():
    texts = [None, "", " \t\x0b", "a\x1cb C\x85d E!", "ẞtraße STRASSE İstanbul ﬁ _x_ É_ü", "!! -- 中文。字 ²½ ๑", "it's,\nIts", None]
    texts += [" ".join(f"{chr(c)} a{chr(c)}B" for c in range(lo, lo + 1024)) for lo in range(0, 0x3000, 1024)]
    laid, firsts, lengths = decontaminate.laid_words(texts)
    words = PlainWords()
    for text, at, n in zip(texts, firsts, lengths, strict=True):
        assert laid[at : at + n + 1].tolist() == [*plain_words(text, words).tolist(), 0]
    assert len(laid) == lengths.sum() + len(texts) + 1


def test_shared_words():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(1, 9, 12).astype(np.uint64), rng.integers(1, 12, 20).astype(np.uint64)
        counts = [min((a == x).sum(), (b == x).sum()) for x in set(a.tolist())]
        assert decontaminate.shared_words(*np.unique(a, return_counts=True), b) == sum(counts)
        assert len(a) - best_match(a, b)[0] <= sum(counts)
