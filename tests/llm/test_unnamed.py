"""Documents without id in the stages of the pipeline."""

import random

import corpus_pipeline as cp
from tagloom.llm.mixing import mix
from tests.llm.helpers import prose


def test_documents_without_id(spark, tmp_path):
    rng = random.Random(3)
    passage = prose(rng, 30)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [prose(rng, 80) for _ in range(6)]
    bad = f"{prose(rng, 20)} {passage} {prose(rng, 20)}"
    rows = [(None, clean[0], "en", "a"), (None, clean[0], "en", "a"), (None, clean[1], "en", "b"), (None, bad, "en", "a"), (None, None, "en", "a"), (7, bad, "en", "a"), (8, clean[2], "en", "a"), (9, clean[3], "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = cp.decontaminate(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if r[1] != bad), key=str)
    mixed = cp.mixture(spark, kept, str(tmp_path))
    assert mixed.columns == docs.columns
    want = {}
    numbered = [(i, *r[1:]) for i, r in enumerate(r for r in rows if r[1] != bad)]
    for r in mix(spark.createDataFrame(numbered, "doc_id long, text string, lang string, source string")).collect():
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
    got = mixed.collect()
    assert {clean[0], clean[1]} <= {r["text"] for r in got if r["doc_id"] is None}
    for source, taken in want.items():
        assert abs(80 * sum(r["source"] == source for r in got) - taken) <= 160
    assert cp.shard(spark, mixed, str(tmp_path)).count() == len(got)
