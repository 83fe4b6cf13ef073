"""Files, signals and streams."""

import json

from pyspark.sql import functions as F

from tagloom.operators import text
from tagloom.sources import files, sinks
from tagloom.streaming import jobs


def make(folder):
    (folder / "docs").mkdir(parents=True)
    (folder / "docs" / "a.md").write_text("# Title\n\nSome text here.")
    (folder / "docs" / "b.csv").write_text("x,y\n1,2\n")
    (folder / "docs" / "c.json").write_text(json.dumps({"k": 1}))
    (folder / "docs" / "d.txt").write_text("# Title\n\nSome text here.")
    (folder / "docs" / "e.png").write_bytes(b"\x89PNG\0")
    (folder / ".hidden").mkdir()
    (folder / ".hidden" / "f.md").write_text("no")


def test_read_and_ingest(spark, tmp_path):
    make(tmp_path)
    found = {r["path"]: r["text"] for r in files.read_files(spark, str(tmp_path)).collect()}
    assert set(found) == {"docs/a.md", "docs/b.csv", "docs/c.json", "docs/d.txt"}
    assert found["docs/b.csv"] == "x | y\n-----\n1 | 2" and '"k": 1' in found["docs/c.json"]
    none = spark.createDataFrame([], "content_hash string")
    fresh = files.ingest(files.read_files(spark, str(tmp_path)), none)
    assert fresh.count() == 3  # equal texts once
    assert files.ingest(files.read_files(spark, str(tmp_path)), fresh).count() == 0


def test_watch(spark, tmp_path):
    make(tmp_path / "in")
    for _ in range(2):
        jobs.watch_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    (tmp_path / "in" / "docs" / "new.txt").write_text("another text")
    jobs.watch_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_signals(spark, tmp_path):
    rows = [("p", "store", ["b", "a"], 1), ("p", "store", ["a", "b"], 1), ("q", "store", ["a"], 2)]
    e = spark.createDataFrame(rows, "project string, operation string, tags array<string>, s long").selectExpr("project", "operation", "tags", "timestamp_seconds(s) AS occurred_at")
    path = str(tmp_path / "signals")
    sinks.emit(e, path)
    sinks.emit(e, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2
    assert sinks.pending(stored, stored.filter("project = 'p'")).count() == 1
    e.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "events"))
    jobs.signal_bus(stream, str(tmp_path / "bus"), str(tmp_path / "bus-cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bus")).count() == 2


def test_middle_layer(spark, tmp_path):
    cells = spark.createDataFrame([("anchor", "a", "glyph", "glyph", 0.5)], sinks.CELL)
    sinks.write_middle_layer(cells, str(tmp_path / "m"), "x", "y")
    assert sinks.load_middle_layer(spark, str(tmp_path / "m")).select(*cells.columns).collect() == cells.collect()


def test_windowed_counts(spark, tmp_path):
    e = spark.range(48).select((F.col("id") % 2).alias("tag_id"), F.timestamp_seconds(F.col("id") * 3600).alias("occurred_at"), F.lit(1.0).alias("weight"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = jobs.windowed_counts(stream, "24 hours", "24 hours", "24 hours").writeStream.format("memory").queryName("w").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("events")).first()[0] == 48


def test_events_and_retrievals(spark, tmp_path):
    events = spark.createDataFrame([(1, "store", "m"), (1, "store", "m"), (2, "store", None)], "tag_id int, event_type string, memory_id string")
    for _ in range(2):
        sinks.record_events(events, str(tmp_path / "events"))
    stored = spark.read.parquet(str(tmp_path / "events"))
    assert stored.count() == 6 and stored.filter("weight = 1 and occurred_at is not null").count() == 6
    sinks.record_events(events.withColumn("weight", F.lit(0.5)), str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).filter("weight = 0.5").count() == 3
    results = spark.createDataFrame([(1, "q", "b", 0.5), (1, "q", "a", 0.5), (1, "q", "c", 0.9), (2, "none", None, None)], "retrieval_id long, query_text string, memory_id string, score double")
    sinks.log_retrievals(results, str(tmp_path), "hybrid", "v")
    heads = {r["retrieval_id"]: r["result_count"] for r in spark.read.parquet(str(tmp_path / "retrievals")).collect()}
    assert heads == {1: 3, 2: 0}
    assert sorted((r["rank"], r["memory_id"]) for r in spark.read.parquet(str(tmp_path / "results")).collect()) == [(1, "c"), (2, "a"), (3, "b")]
    hits = spark.createDataFrame([(1, 5, "direct"), (1, 5, "direct"), (1, 6, None)], "retrieval_id long, tag_id long, hit_type string")
    sinks.log_tag_hits(hits, str(tmp_path / "hits"))
    sinks.log_tag_hits(hits.unionByName(hits.selectExpr("2L AS retrieval_id", "tag_id", "hit_type")), str(tmp_path / "hits"))
    assert spark.read.parquet(str(tmp_path / "hits")).count() == 4


def test_tags_of_paths(spark):
    paths = ["My_Docs/src/Read Me.MD", "docs/app/index.html", "a.tar.gz", ".env", "x/y1/report_final.csv", "notes", None]
    got = spark.createDataFrame([(p,) for p in paths], "path string").select("path", text.file_tags(F.col("path")).alias("f"), text.document_tags(F.col("path")).alias("d")).collect()
    found = {r["path"]: (r["f"], r["d"]) for r in got}
    assert found["My_Docs/src/Read Me.MD"] == (["markdown", "my-docs", "document"], ["document", "markdown", "ext:md", "read-me", "my-docs"])
    assert found["docs/app/index.html"] == (["html", "docs", "app", "document"], ["document", "html", "ext:html"])
    assert found["a.tar.gz"] == (["document"], ["document", "ext:gz", "a.tar"])
    assert found[".env"] == (["document"], ["document", ".env"])
    assert found["x/y1/report_final.csv"] == (["data", "y1", "document"], ["document", "csv", "ext:csv", "report-final", "y1"])
    assert found["notes"] == (["document"], ["document", "notes"]) and found[None] == (None, None)


def test_document_parts(spark):
    paragraphs = [f"{i} " + "word " * 50 for i in range(40)]
    body = "\n\n".join(paragraphs)
    rows = [(1, body, "x/a.md"), (2, " short ", None), (3, None, "y"), (4, " \n ", "y"), (5, "z" * 4000, "long"), (1, body, "x/a.md")]
    got = text.document_parts(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()
    mine = [r for r in got if r["id"] == 1]
    n = mine[0]["total"]
    assert len(mine) == 2 * n and n > 2
    pieces = [r["chunk"].split("\n\n", 1)[1] for r in sorted(mine[:n], key=lambda r: r["chunk_index"])]
    assert mine[0]["chunk"].startswith(f"[x/a.md (part 1/{n})]\n\n0 word")
    assert all(len(p) <= 3000 + 200 + 2 for p in pieces)
    # Every paragraph is whole in a piece, and a piece begins with the end of the piece before.
    assert all(any(p.strip() in piece for piece in pieces) for p in paragraphs)
    assert all(a[-150:] in b for a, b in zip(pieces, pieces[1:], strict=False))
    assert [r["chunk"] for r in got if r["id"] == 2] == ["[]\n\nshort"]
    assert not [r for r in got if r["id"] in (3, 4)]
    assert [r["chunk"] for r in got if r["id"] == 5] == ["[long (part 1/1)]\n\n" + "z" * 4000]
