"""WARC archives: write, normalise monolithic gzip streams, read by index."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import narrow, shared_dir

CHUNK = 1 << 20
INDEX_SUFFIX = ".idx"


def mounted(path: str) -> str:
    """The local name of a folder that every executor mounts."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"archives need a shared folder that is mounted on the executors, not {path}")
    return unquote(url.path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with its payload, or a revisit record without."""
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": _safe(url or ""),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Full-Payload-Length": str(len(payload)),
    }
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    body = b"" if revisit else payload
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_monolithic(records: Iterator[bytes], path: str) -> int:
    """One gzip stream over all records; returns their number.  The file appears only when it is whole."""
    packer, n, part = zlib.compressobj(1, zlib.DEFLATED, 31), 0, f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        for r in records:
            f.write(packer.compress(r))
            n += 1
        f.write(packer.flush())
    os.replace(part, path)
    return n


def inflated(path: str) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in pieces of bounded size."""
    with open(path, "rb") as f:
        unpacker, data = zlib.decompressobj(31), b""
        while data or (data := f.read(CHUNK)):
            yield unpacker.decompress(data, CHUNK)
            data = unpacker.unconsumed_tail
            if unpacker.eof:
                data, unpacker = unpacker.unused_data or f.read(CHUNK), zlib.decompressobj(31)
        yield unpacker.flush()


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a WARC stream, framed by Content-Length."""
    buffer = bytearray()
    for piece in pieces:
        buffer += piece
        while (end := buffer.find(b"\r\n\r\n")) >= 0:
            length = re.search(rb"(?im)^content-length:\s*(\d+)", bytes(buffer[:end]))
            if not length:
                raise ValueError("record without Content-Length")
            size = end + 4 + int(length[1]) + 4
            if len(buffer) < size:
                break
            yield bytes(buffer[:size])
            del buffer[:size]
    if buffer.strip():
        raise ValueError("the stream ends inside a record")


def normalise(path: str, out: str, level: int = 6) -> int:
    """Inflate a whole-file stream once; rewrite each record as its own gzip member, and its offset and length to a sidecar index."""
    n, at, token = 0, 0, uuid.uuid4().hex
    with open(f"{out}.{token}.part", "wb") as f, open(f"{out}{INDEX_SUFFIX}.{token}.part", "w") as index:
        for r in records(inflated(path)):
            packer = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = packer.compress(r) + packer.flush()
            f.write(member)
            index.write(f"{at} {len(member)}\n")
            at += len(member)
            n += 1
    os.replace(f"{out}.{token}.part", out)
    os.replace(f"{out}{INDEX_SUFFIX}.{token}.part", f"{out}{INDEX_SUFFIX}")
    return n


def read_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of a normalised archive, each read at its indexed offset."""
    with open(path, "rb") as f, open(f"{path}{INDEX_SUFFIX}") as index:
        for line in index:
            at, length = map(int, line.split())
            f.seek(at)
            raw = zlib.decompress(f.read(length), 31)
            head, _, block = raw.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield headers, block[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write a record per page to archives in ``folder``; returns a row per archive: path, records.

    Of pages with equal payloads of at least ``min_revisit_bytes``, that with
    the smallest id becomes a response and the others revisit it.  Each task
    writes one monolithic gzip stream, normalises it and drops the stream.  A
    task that runs again writes the same files anew under the same names.

    Null html is an empty payload, null url an empty one.  A row without id
    revisits the page of its group with the smallest id; where no page of a
    group has an id there is nothing to refer to, and all are responses.
    Repeated rows of the smallest id are responses each.  An empty table gives
    no archive.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = narrow(pages, id=id_col, url=url_col, html=html_col).select("id", F.col("url").cast("string").alias("url"), body.alias("html"), F.sha2(body, 256).alias("key"))
    first = rows.groupBy("key").agg(F.min("id").alias("keeper"))
    joined = rows.join(first, "key").select("id", "url", "html", "keeper")
    schema = "path string, records long"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out = f"{folder}/part-{part:06d}.warc.gz"

        def made() -> Iterator[bytes]:
            for pdf in batches:
                for page_id, url, html, keeper in pdf.itertuples(index=False):
                    payload = html.encode()
                    page_id, keeper = (None if pd.isna(x) else int(x) for x in (page_id, keeper))
                    yield record(page_id, url, payload, keeper, page_id != keeper and len(payload) >= min_revisit_bytes)

        mono = f"{out}.{uuid.uuid4().hex}.mono"
        try:
            if write_monolithic(made(), mono):
                yield pd.DataFrame({"path": [out], "records": [normalise(mono, out, level)]})
        finally:
            if os.path.exists(mono):
                os.remove(mono)

    return joined.mapInPandas(write, schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    The payload of a response is checked against its digest; a revisit has
    none, and its length and digest are those of the page that it revisits.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def page(urn: str | None) -> int | None:
        digits = re.sub(r"\D", "", urn or "")
        return (-1 if "-" in (urn or "") else 1) * int(digits) if digits else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                out, held = [], 0
                for head, payload in read_records(path):
                    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and digest(payload) != said:
                        raise ValueError(f"digest of {head['WARC-Record-ID']} in {path}")
                    size = len(payload) if kind == "response" else int(head["WARC-Full-Payload-Length"])
                    out.append((page(head["WARC-Record-ID"]), size, said, kind, page(head.get("WARC-Refers-To")), payload))
                    held += len(payload)
                    if held > 4 * CHUNK or len(out) >= 5000:
                        yield _frame(out)
                        out, held = [], 0
                if out:
                    yield _frame(out)

    return archives.select("path").mapInPandas(read, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return pdf.astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read them back through their indexes."""
    spark = pages.sparkSession
    folder = f"{mounted(shared_dir(spark))}/warc-{uuid.uuid4().hex}"
    os.makedirs(folder)
    written = write_archives(pages, folder, min_revisit_bytes=min_revisit_bytes)
    index = f"file://{folder}/archives.parquet"
    written.write.parquet(index)
    archives = spark.read.schema(written.schema).parquet(index)
    return read_archives(archives.repartition(max(1, spark.sparkContext.defaultParallelism * 2)))
