"""WARC archives with revisit records.

Payloads are never shuffled. The headers of all pages (place in the source, digest, page id, url) are
written once and shuffled by payload digest; the smallest page id of each payload is its original, and
every other page of it joins that original. These joins go back, again as headers only, to the places of
their pages: one small file per block of ``BLOCK_ROWS`` rows of a source file. A second scan of the pages
reads the files of its blocks and writes archives: a response with its payload, or a revisit with fresh
headers that refer to the response. A digest shared by very many pages is one skewed join key, which
adaptive execution splits: headers and originals are read from written tables, so both inputs of the
join are plain exchanges. Archives have names of their own per task attempt, and only those in the
committed manifest are read back, so a lost executor leaves no double records.

Pages that are not a bare Parquet table are written as one first, since places must not change.
Archives go to the shared scratch folder through Arrow's file systems (local paths, hdfs, s3, gs).

Defined results: null html is an empty payload; a null page id never is an original while its payload
has another id, and a group of null ids only is all response; rows that repeat an original's id and
payload are responses too; null urls are written as about:blank; page ids keep their type; payloads are
written whole, a very long one by itself; the date of all records is that of the writing; an empty table
gives no archives and an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import column, materialize, opened, scratch_path, text_slices

ARCHIVE_BYTES = 256 << 20
COMPRESSION = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"
#: Rows of a source file whose revisits a task holds at once.
BLOCK_ROWS = 1 << 16


def record_id(page_id: object, digest: str) -> str:
    return f"<{_ID}{'null-' + uuid.uuid4().hex if page_id is None else 'id-' + quote(str(page_id), safe='')}:{digest}>"


def page_of(identifier: str, read=int):
    """The page id in a record id."""
    page = identifier.strip("<>").removeprefix(_ID).partition(":")[0]
    return None if page.startswith("null-") else read(unquote(page.removeprefix("id-")))


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _uri(url: str | None) -> str:
    return "".join(c for c in url or "about:blank" if c > " ")


def make_record(page_id: object, url: str | None, payload: bytes, digest: str, original: object, size: int, original_url: str | None = None, date: str | None = None) -> bytes:
    """One record: a response, or with an original a revisit, which has HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = original is not None
    date = date or now()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else len(payload))}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original, digest)}", f"WARC-Refers-To-Target-URI: {_uri(original_url)}", f"WARC-Refers-To-Date: {date}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return b"".join([head, http, b"" if revisit else payload, b"\r\n\r\n"])


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open, already decompressed archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"a record of {size} bytes is cut short")
        yield headers, block


def _placed(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """(file, row, sha, page, url, html): the pages with their places in a Parquet table."""
    plan = pages._jdf.queryExecution().analyzed()
    bare = plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.relation().toString().lower()
    if not bare or "_metadata" in pages.columns:
        pages = materialize(pages.select(column(page).alias("page"), column(url).alias("url"), column(html).alias("html")), "pages")
        page, url, html = "page", "url", "html"
    body = F.coalesce(column(html), F.lit(""))
    return pages.select(
        F.sha1(F.col("_metadata.file_path").cast("binary")).alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.sha1(body.cast("binary")).alias("sha"),
        column(page).alias("page"),
        column(url).alias("url"),
        body.alias("html"),
    )


def resolved(placed: DataFrame, least: int) -> DataFrame:
    """(file, block, row, original, original_url) of every page that revisits the smallest page id with
    its payload; payloads under ``least`` bytes are never revisited."""
    heads = materialize(placed.select("file", "row", "sha", "page", "url", F.octet_length("html").alias("size")), "headers")
    heads = heads.filter(F.col("size") >= least)
    named = F.when(F.col("page").isNotNull(), F.struct("page", "url"))
    first = materialize(heads.groupBy("sha").agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").select("sha", "first"), "originals")
    revisits = heads.join(first, "sha").filter(~F.col("page").eqNullSafe(F.col("first.page")))
    block = F.floor(F.col("row") / BLOCK_ROWS).alias("block")
    return revisits.select("file", block, "row", F.col("first.page").cast("string").alias("original"), F.col("first.url").alias("original_url"))


def _revisits(folder: str, file: str, block: int) -> dict[int, tuple[str, str | None]]:
    """The revisits of one block: row to original and its url."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    store, path = opened(folder)
    out = {}
    for info in store.get_file_info(FileSelector(f"{path}/file={file}/block={block}", allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as source:
                rows = pq.ParquetFile(source).read()
            out.update(zip(rows["row"].to_pylist(), zip(rows["original"].to_pylist(), rows["original_url"].to_pylist(), strict=True), strict=True))
    return out


def write_archives(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write one record per page; returns the manifest (path, records, bytes) of committed archives.

    Payloads under ``least`` bytes are all written as responses."""
    folder, places, date = scratch_path(pages.sparkSession, "warc"), scratch_path(pages.sparkSession, "revisits"), now()
    placed = _placed(pages, page, url, html)
    resolved(placed, least).repartition("file", "block").write.partitionBy("file", "block").parquet(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = None, ""
        done: list[tuple[str, int, int]] = []
        out, name, n, size = None, "", 0, 0
        here, revisits = None, {}
        for batch in batches:
            files, rows, shas, pages_, urls = (batch.column(i).to_pylist() for i in range(5))
            for file, row, sha, p, u, payload in zip(files, rows, shas, pages_, urls, text_slices(batch.column(5)), strict=True):
                if (file, row // BLOCK_ROWS) != here:
                    here = file, row // BLOCK_ROWS
                    revisits = _revisits(places, *here)
                if out is None:
                    if store is None:
                        store, path = opened(folder)
                        store.create_dir(path, recursive=True)
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                original, original_url = revisits.get(row, (None, None))
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                member = zlib.compressobj(COMPRESSION, zlib.DEFLATED, 31)
                packed = member.compress(make_record(p, u, payload, digest, original, len(payload), original_url, date)) + member.flush()
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x, strict=True)) for x in done])

    records = placed.select("file", "row", "sha", F.col("page").cast("string"), "url", "html")
    return materialize(records.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives: page, url, digest, payload_bytes, record_type, refers_to; ids as text.

    Every response's payload is read whole and its digest checked."""

    def rows(path: str) -> Iterator[dict]:
        store, name = opened(path)
        with store.open_input_file(name) as raw, gzip.GzipFile(fileobj=raw) as stream:
            for headers, block in read_records(stream):
                head, _, payload = block.partition(b"\r\n\r\n")
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
                kind = headers["warc-type"]
                if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{path}: the payload of {headers['warc-record-id']} does not match its digest")
                yield {
                    "page": page_of(headers["warc-record-id"], str),
                    "url": headers["warc-target-uri"],
                    "digest": digest,
                    "payload_bytes": size,
                    "record_type": kind,
                    "refers_to": page_of(headers["warc-refers-to"], str) if kind == "revisit" else None,
                }

    kinds = pa.schema([("page", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                for row in rows(path):
                    held.append(row)
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=kinds)

    archives = manifest.select("path")
    archives = archives.repartition(max(1, archives.count()))
    return archives.mapInArrow(run, "page string, url string, digest string, payload_bytes long, record_type string, refers_to string")


def archive_table(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives."""
    records, kind = read_archives(write_archives(pages)), pages.schema["page_id"].dataType
    return records.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


#: DuckDB SQL for archive_table over pages.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(p.sha, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN f USING (sha)
"""
