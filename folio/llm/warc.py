"""WARC archives with a two-level capture index.

Writing: every task writes its records to a file of its own in the archive's
folder, a gzip member each, and reports a capture per record. Captures are
range-sorted by their key (host reversed, so that a domain's pages are
neighbours), cut into blocks of ``BLOCK_LINES`` lines, each compressed by
itself; the sparse directory has one row per block: first and last key, file,
offset and length. It is a sorted Parquet table, so a search reads only the
row groups whose key range fits.

Reading: a lookup takes the directory's blocks that may hold a key, reads
their byte ranges, bisects the lines and reads the byte ranges of the records.

File names carry the task attempt and only committed attempts' rows reach the
index, so a lost executor leaves a stray file that nothing refers to.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.shared import filesystem, shared_folder, written

BLOCK_LINES = 3000
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
CAPTURES = "key string, page_id long, file string, offset long, length long, kind string, digest string"
DIRECTORY = "first string, last string, file string, offset long, length long, lines int"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    folder: str
    captures: DataFrame
    directory: DataFrame


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query`` of ``http://www.example.com/path?query#x``; '' for null."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    cut = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, _, port = rest[:cut].rpartition("@")[2].partition(":")
    path = rest[cut:].partition("#")[0] or "/"
    return f"{','.join(reversed(host.lower().split('.')))}{':' + port if port else ''}){path}"


def header_value(value: str) -> str:
    """One line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record: response with the payload, or revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page_id, url, digest]))
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one uncompressed record."""

    def headers(source: bytes) -> dict[str, str]:
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in source.decode().split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    own = headers(head)
    block = rest[: int(own["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return own, headers(http), payload


def member(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def write_records(uri: str):
    """Writes a partition's records to its own file; a capture row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        system, path = filesystem(uri)
        system.create_dir(path, recursive=True)
        offset = 0
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, refers_to, revisit in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    data = member(record(page_id, url, html or b"", digest, refers_to, revisit))
                    out.write(data)
                    rows.append((url_key(url), page_id, name, offset, len(data), "revisit" if revisit else "response", digest))
                    offset += len(data)
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], CAPTURES.replace(",", "").split()[::2])

    return run


def write_blocks(uri: str, size: int):
    """Compresses a sorted partition's captures into blocks of a file of its own; a directory row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"index-{context.partitionId():06d}-{context.taskAttemptId()}.cdx.gz"
        system, path = filesystem(uri)
        system.create_dir(path, recursive=True)
        rows, lines, offset = [], [], 0

        def flush(out) -> int:
            data = member("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode())
            out.write(data)
            rows.append((lines[0][0], lines[-1][0], name, offset, len(data), len(lines)))
            lines.clear()
            return len(data)

        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    lines.append(row)
                    if len(lines) == size:
                        offset += flush(out)
            if lines:
                flush(out)
        if rows:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], DIRECTORY.replace(",", "").split()[::2])

    return run


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to, revisit: of equal payloads of at least ``least`` bytes all but the smallest page_id revisit it."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digests = own.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size"))
    first = digests.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    joined = own.withColumn("digest", F.sha2("html", 256)).join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str | None = None, *, least: int = LEAST_BYTES, block_lines: int = BLOCK_LINES) -> Archive:
    """Writes ``pages`` (page_id, url, html) to ``folder`` (default: a new one in the shared folder) and indexes them."""
    folder = folder or shared_folder(pages.sparkSession)
    captures = written(revisits(pages, least).mapInArrow(write_records(f"{folder}/archive"), CAPTURES), folder, "captures")
    ordered = captures.repartitionByRange("key", "page_id", "offset").sortWithinPartitions("key", "page_id", "offset")
    directory = written(ordered.mapInArrow(write_blocks(f"{folder}/index", block_lines), DIRECTORY), folder, "directory")
    return Archive(folder, captures, directory)


def open_archive(spark: SparkSession, folder: str) -> Archive:
    return Archive(folder, spark.read.parquet(f"{folder}/captures"), spark.read.parquet(f"{folder}/directory"))


def block_captures(folder: str, keys: Sequence[str] | None):
    """Captures of the directory's blocks, read as byte ranges; only those of ``keys`` (bisected) where given."""
    wanted = None if keys is None else sorted(set(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        system, path = filesystem(f"{folder}/index")
        for batch in batches:
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                with system.open_input_file(f"{path}/{name}") as file:
                    lines = [json.loads(x) for x in gzip.decompress(file.read_at(length, offset)).decode().split("\n") if x]
                if wanted is not None:
                    at = [x[0] for x in lines]
                    found = []
                    for key in wanted[bisect_left(wanted, at[0]) :]:
                        if key > at[-1]:
                            break
                        i = bisect_left(at, key)
                        while i < len(at) and at[i] == key:
                            found.append(lines[i])
                            i += 1
                    lines = found
                if lines:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*lines), kinds)], CAPTURES.replace(",", "").split()[::2])

    return run


def fetch(folder: str, payloads: bool):
    """Reads captures' records as byte ranges and parses them; the payload's digest is computed anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        system, path = filesystem(f"{folder}/archive")
        name, file = None, None
        for batch in batches:
            rows = []
            for wanted, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if wanted != name:
                    if file:
                        file.close()
                    name, file = wanted, system.open_input_file(f"{path}/{wanted}")
                own, http, payload = read_record(zlib.decompress(file.read_at(length, offset), 31))
                revisit = own["warc-type"] == "revisit"
                digest = own["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                size = int(http["content-length"]) if revisit else len(payload)
                page, refers = own.get("warc-page-id"), own.get("warc-refers-to-page-id")
                rows.append((page and int(page), own.get("warc-target-uri"), size, digest, own["warc-type"], refers and int(refers), payload.decode() if payloads and not revisit else None))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], RECORDS.replace(",", "").split()[::2])
        if file:
            file.close()

    return run


def read(archive: Archive, *, payloads: bool = True) -> DataFrame:
    """All records, by way of the index: ``RECORDS``. A revisit's payload is null; size and digest are the full payload's."""
    captures = archive.directory.mapInArrow(block_captures(archive.folder, None), CAPTURES)
    near = captures.repartition("file", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("file", "offset")
    return near.mapInArrow(fetch(archive.folder, payloads), RECORDS)


def lookup(archive: Archive, urls: Sequence[str]) -> DataFrame:
    """The records of ``urls`` (any captures with the same key): only blocks whose range holds a key are read."""
    keys = sorted({url_key(u) for u in urls})
    if not keys:
        return read(archive).limit(0)
    inside = F.lit(False)
    for key in keys:
        inside = inside | (F.col("first") <= key) & (F.col("last") >= key)
    found = archive.directory.where(inside).mapInArrow(block_captures(archive.folder, keys), CAPTURES)
    return found.sortWithinPartitions("file", "offset").mapInArrow(fetch(archive.folder, True), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url a record without a target. Of
    equal payloads with the same smallest page_id twice, both are responses; a
    null page_id revisits any other. Repeated rows get a record each; other
    columns are not read; no rows give no records.
    """
    return read(write(pages), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
