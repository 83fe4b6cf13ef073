"""Files as a source: read by kind, ignore rules, ingest with deduplication."""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.text import chunk_documents, new_chunks

#: Endings of files that are never text.
BINARY = ("png", "jpg", "jpeg", "gif", "bmp", "ico", "zip", "gz", "tar", "7z", "exe", "dll", "so", "bin", "mp3", "mp4", "avi", "mov", "woff", "woff2", "ttf", "pyc", "class", "o", "a", "db", "sqlite")
IGNORED = ("__pycache__", "node_modules", ".git", ".venv", "dist", "build", "*.pyc", "*.lock")


def parse(name: str, content: bytes) -> str | None:
    """Text of a file by its ending; None where it can't be read."""
    kind = name.rpartition(".")[2].lower()
    try:
        if kind == "json":
            return json.dumps(json.loads(content), indent=2, ensure_ascii=False)
        if kind == "csv":
            rows = list(csv.reader(io.StringIO(content.decode("utf-8", "replace"))))
            head = " | ".join(rows[0]) if rows else ""
            return "\n".join([head, "-" * len(head), *[" | ".join(r) for r in rows[1:]]]) if rows else ""
        if kind == "docx":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                tree = ElementTree.fromstring(z.read("word/document.xml"))
            w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            lines = ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in tree.iter(f"{w}p")]
            return "\n\n".join(x for x in lines if x.strip())
        if kind == "pdf":
            from pypdf import PdfReader  # optional

            return "\n\n".join(p.extract_text() for p in PdfReader(io.BytesIO(content)).pages)
        if kind in BINARY or b"\0" in content[:8192]:
            return None
        return content.decode("utf-8", "replace")
    except Exception:  # noqa: BLE001  a file that can't be parsed is no document
        return None


def is_ignored(path: str, patterns: tuple[str, ...] = IGNORED) -> bool:
    """Hidden folders, and parts or whole paths that match a pattern."""
    parts = [p for p in path.split("/") if p]
    return any(p.startswith(".") and p not in (".", "..") for p in parts[:-1]) or any(fnmatch.fnmatch(x, p) for p in patterns for x in (*parts, path))


def read_files(spark: SparkSession, folder: str, patterns: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, length, text) of the readable files below a folder; path is relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return parse_files(raw, folder, patterns)


def parse_files(raw: DataFrame, folder: str, patterns: tuple[str, ...] = IGNORED) -> DataFrame:
    marker = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p.rpartition(marker)[2], n, parse(p, c)) for p, n, c in zip(pdf["path"], pdf["length"], pdf["content"], strict=True) if not is_ignored(p.rpartition(marker)[2], patterns)]
            yield pd.DataFrame([r for r in rows if r[2] is not None], columns=["path", "length", "text"])

    return raw.select("path", "length", "content").mapInPandas(read, "path string, length long, text string")


def ingest(files: DataFrame, stored: DataFrame) -> DataFrame:
    """New chunks of the files, with the path they come from; stored: content_hash."""
    keyed = files.withColumn("doc_id", F.xxhash64("path"))
    fresh = new_chunks(chunk_documents(keyed), stored)
    return fresh.join(keyed.select(F.col("doc_id").alias("id"), "path"), "id")


def read_corpus(spark: SparkSession, path: str, processed: DataFrame | None = None) -> DataFrame:
    """Documents of a JSON corpus (one object a line: source, title, text), but for those already processed (source)."""
    docs = spark.read.schema("source string, title string, text string").json(path).filter("text is not null")
    return docs if processed is None else docs.join(processed.select("source"), "source", "left_anti")
