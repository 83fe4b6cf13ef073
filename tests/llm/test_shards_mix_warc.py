"""Shards, mixture and archives: their laws on small tables."""

import gzip
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tagloom.llm import warc
from tagloom.llm.mixing import mix, source_targets
from tagloom.llm.sharding import balanced_label_propagation
from tests.llm.helpers import clashing, corpus, frame


@pytest.mark.parametrize("hot", [0, 150])
def test_shards(spark, hot):
    rows = corpus() + [(1000 + i, "hot", "en", "s") for i in range(hot)] + [(None, "n", None, None), (7, corpus()[7][1], "en", "s")]
    got = balanced_label_propagation(clashing(frame(spark, rows)), shards=8).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    texts = Counter((t or "") for _, t, *_ in rows)
    where = defaultdict(set)
    for r in got:
        where[r["size"], r["text_crc32"]].add(r["shard"])
    quota = min(counts.values())
    for t, n in texts.items():
        key = len(t.encode()) + 1, zlib.crc32(t.encode())
        # A group that fits is together; a larger one in as few shards as hold it, or one more.
        assert len(where[key]) == 1 if n <= quota / 2 else len(where[key]) <= n // quota + 2


def test_no_shards_for_nothing(spark):
    assert balanced_label_propagation(frame(spark, [])).count() == 0


def water(sizes, cap=3.0):
    """Targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    done, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if rest * w[s] / total > cap * sizes[s] + 1e-9}
        if not full:
            return done | {s: rest * w[s] / total for s in open_}
        done |= {s: cap * sizes[s] for s in full}
        rest -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return done


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 300, "d": 0}, {"a": 1, "b": 1}, {"x": 0}, {f"s{i}": i * i for i in range(30)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_mix(spark):
    rows = corpus(n=200) + [(None, "a b c", "en", "src0"), (3, "a b c", "en", "src0"), (3, "a b c", "en", "src0")]
    df = clashing(frame(spark, rows))
    got = mix(df, block_words=8).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["source_size"] is not None
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.03 * target[s] + 100
    again = mix(df.repartition(3), block_words=8)
    assert sorted(map(tuple, again.fillna(-1, ["id"]).select("id", "size", "taken").collect())) == sorted((-1 if r["id"] is None else r["id"], r["size"], r["taken"]) for r in got)


def plain_mix(rows, block, cap=3):
    """Words that each document gives, by the schedule slot by slot."""
    import hashlib

    sizes = [len((t or "").split()) for _, t, *_ in rows]
    by_source = defaultdict(list)
    for n, (i, _, _, s) in enumerate(rows):
        by_source[s].append((hashlib.md5(f"mix{i}".encode()).hexdigest(), i, sizes[n], n))
    total = {s: sum(x[2] for x in v) for s, v in by_source.items()}
    target = water(total)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    ends, run = [], 0.0
    for s in order:
        run += target[s]
        ends.append(run / sum(total.values()))
    slots = Counter()
    for j in range(-(-sum(total.values()) // block)):
        u = (j * 0.6180339887498949) % 1.0
        slots[next((s for s, e in zip(order, ends) if u < e and total[s]), order[-1])] += 1
    taken = [0] * len(rows)
    for s, docs in by_source.items():
        blocks = -(-total[s] // block)
        times = Counter(r % blocks for r in range(min(slots[s], cap * blocks))) if blocks else {}
        at = 0
        for _, _, size, n in sorted(docs):
            taken[n] = sum(times.get(w // block, 0) for w in range(at, at + size))
            at += size
    return taken


def test_mix_equals_the_schedule_slot_by_slot(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 40)), "en", f"s{i % 4}") for i in range(120)]
    got = {r["id"]: r["taken"] for r in mix(frame(spark, rows), block_words=16).collect()}
    assert [got[i] for i, *_ in rows] == plain_mix(rows, 16)


def test_mix_nothing(spark):
    assert mix(frame(spark, [])).count() == 0
    got = mix(frame(spark, [(1, None, "a", "s"), (2, " \t ", "a", None)])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 2


PAGES = "page_id long, url string, html string"


def test_archives(spark):
    rows = [(5, "u5", "same"), (2, "u2", "same"), (9, None, "same"), (3, "u3", None), (4, "u4", ""), (1, "u\r\n1", "é" * 5000), (8, "u", "x\r\n\r\ny"), (-7, "u", "only")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS PAGE_ID", "'h' AS HTML", "2 AS key", "3 AS keeper")
    got = {r["page_id"]: r for r in warc.archive_pages(df).collect()}
    assert len(got) == len(rows)
    first = {"same": 2, "": 3}
    for i, _, html in rows:
        raw, r = (html or "").encode(), got[i]
        keeper = first.get(html or "", i)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), warc.digest(raw), "response" if keeper == i else "revisit", None if keeper == i else keeper)
        assert bytes(r["payload"]) == (raw if keeper == i else b"")
    few = warc.archive_pages(df, min_revisit_bytes=1).filter("record_type = 'revisit'")
    assert {r["page_id"] for r in few.collect()} == {5, 9}
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_archives_without_ids_and_with_repeats(spark):
    rows = [(None, "u", "a"), (None, "u", "a"), (3, "u", "b"), (None, "u", "b"), (3, "u", "b"), (4, "u", "b")]
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.archive_pages(spark.createDataFrame(rows, PAGES)).collect())
    assert got == sorted([("None", "response", None), ("None", "response", None), ("3", "response", None), ("3", "response", None), ("None", "revisit", 3), ("4", "revisit", 3)], key=lambda r: (r[0], r[1]))


def test_normaliser(tmp_path):
    made = [warc.record(i, f"u{i}", bytes([i]) * (i * 1000), None, False) for i in range(1, 40)]
    mono, out = str(tmp_path / "m.gz"), str(tmp_path / "n.warc.gz")
    warc.write_monolithic(iter(made), mono)
    assert warc.normalise(mono, out) == len(made)
    assert gzip.decompress(open(out, "rb").read()) == b"".join(made)
    with open(out, "rb") as f, open(out + warc.INDEX_SUFFIX) as index:
        for line, r in zip(index, made, strict=True):
            at, n = map(int, line.split())
            f.seek(at)
            assert gzip.decompress(f.read(n)) == r
    assert warc.normalise(out, str(tmp_path / "again.gz")) == len(made)  # many members are read as well
    with pytest.raises(ValueError):
        list(warc.records(iter([made[0][:-10]])))
