"""The registered queries and the pipeline on the smallest tables."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_queries_and_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11)) and "pipeline" in entry.queries()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in names:
        rows = entry.queries()[name](spark, SF).count()
        assert rows > 0
        if name.split("_")[0] in ("op1", "op2", "op3", "op5", "op6", "op7", "op8", "op9"):
            assert rows == n
    c = duckdb.connect()
    for table in ("documents", "pages"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    for name in ("op1_exact_dedup", "op10_warc"):
        want = c.sql(entry.oracle_sql()[name])
        got = entry.queries()[name](spark, SF).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_stages_with_nulls_repeats_and_clashing_names(spark, tmp_path):
    """Every stage against a plain version of its rule."""
    import random

    import corpus_pipeline as cp
    from tagloom.llm.mixing import mix
    from tests.llm.helpers import prose

    rng = random.Random(12)
    item, base = prose(rng, 30), [prose(rng, 60) for _ in range(40)]
    texts = [*base, base[0], base[1] + " more", f"{base[2]} {item}", None, "", base[3], base[3]]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(7, base[7], "en", "s1"), (None, base[5], "en", "s0"), (None, f"{prose(rng, 40)} {item}", "en", None), (None, prose(rng, 50), "en", None), (None, prose(rng, 50), "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS DOC_ID", "2 AS key", "3 AS copies", "'x' AS TEXT", "4 AS copy")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def seen(df):
        at = df.columns.index("doc_id"), df.columns.index("text")
        return sorted(((r[at[0]], r[at[1]]) for r in df.collect()), key=str)

    all_rows = sorted(((r[0], r[1]) for r in rows), key=str)
    kept = cp.language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert seen(kept) == [r for r in all_rows if r[1]]
    # Copies go, the smallest id stays; rows without id stay where their text has no id.
    kept = cp.near_duplicates(spark, docs, str(tmp_path))
    firsts = {}
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if t and t not in (base[1] + " more",) and not (t.endswith(item) and t.startswith(base[2])):
            firsts.setdefault(t, i)
    got = seen(kept)
    assert kept.columns == docs.columns and len(got) == len(set(got))
    assert [r for r in got if r[1] in firsts] == sorted(((i, t) for t, i in firsts.items()), key=str)
    kept = cp.decontaminate(spark, docs, str(tmp_path))
    assert seen(kept) == [r for r in all_rows if not (r[1] or "").endswith(item)]
    kept = cp.mixture(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r[1] for r in seen(kept)} <= {r[1] for r in all_rows if r[1]}
    assert sum(r[0] is None for r in seen(kept)) >= 1
    sharded = cp.shard(spark, docs, str(tmp_path))
    assert sharded.count() == len(rows)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.filter("source = 'none'"), str(tmp_path)).count() == 0
    target = {r["source"]: (r["target"], r["source_size"]) for r in mix(docs.select("doc_id", docs["text"], "source") if False else spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    words: dict = {}
    at = kept.columns.index("source"), kept.columns.index("text")
    for r in kept.collect():
        words[r[at[0]]] = words.get(r[at[0]], 0) + len(r[at[1]].split())
    assert all(abs(words.get(s, 0) - t) <= 0.5 * t + 130 for s, (t, _) in target.items())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp
    from tagloom.llm.decontaminate import contaminated
    from tagloom.llm.minhash import near_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = {}
    before = docs
    for name, stage in cp.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        made[name] = before = spark.read.parquet(str(tmp_path / name))
        if name != "shard":
            assert before.columns == docs.columns
    assert made["language"].count() >= 0.95 * docs.count()
    assert near_dedup(made["near_duplicates"]).filter("not kept").count() == 0
    assert contaminated(made["decontaminate"], spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    lost = made["near_duplicates"].join(made["decontaminate"], "doc_id", "left_anti").select("doc_id")
    found = contaminated(made["near_duplicates"], spark.read.parquet(f"{SF}/benchmark.parquet")).selectExpr("id AS doc_id").distinct()
    assert sorted(lost.collect()) == sorted(found.collect())
    assert made["shard"].count() == made["mixture"].count()
    assert cp.run(spark, SF).count() == made["shard"].count()
