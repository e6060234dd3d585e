"""WARC archives with revisit resolution: written and read as Spark jobs, in any file system that pyarrow and Spark know."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to_id string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def safe(value: str) -> str:
    """As one header line: control characters percent-encoded."""
    return re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in headers), f"Content-Length: {len(block)}\r\n\r\n"])
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id, uri, digest, size, refers, refers_uri, payload: bytes | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", safe(uri or ""))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", safe(refers_uri or "")), ("WARC-Refers-To-Date", date)]
    return member(headers, http + (payload or b""))


#: Bytes of keys of revisits up to which they are broadcast; beyond, responses are told from them by a shuffle.
BROADCAST_BYTES = 1 << 26


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, uri, size, sha, revisit, and for revisits the id and uri of the response (top, top_uri); from page_id, url, html.

    Of rows with equal payloads of at least min_bytes bytes, that with the largest page_id is the response (a null page_id is
    the smallest); rows that repeat both page_id and payload are the same record, told again in the same way. Only headers are
    shuffled: the largest of each digest is aggregated first, so that a hot page's headers are combined in their tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("uri"), F.length(payload).cast("long").alias("size"), F.sha1(payload).alias("sha"))
    rows = materialize(rows)
    heads = rows.filter(F.col("size") >= min_bytes).select("sha", F.struct("page_id", "uri").alias("p"))
    tops = heads.groupBy("sha").agg(F.max("p").alias("top"), F.count("*").alias("n")).filter("n > 1")
    tops = tops.select(F.col("sha").alias("top_sha"), F.col("top.page_id").alias("top"), F.col("top.uri").alias("top_uri"))
    told = rows.join(tops, F.col("sha") == F.col("top_sha"), "left")
    return told.withColumn("revisit", F.col("top_sha").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))).drop("top_sha")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = 1 << 25) -> int:
    """Write deduplicated archives of pages (page_id, url, html) as gzip members into a folder (a URI); returns the records.

    Revisit records are written from their headers. Payloads are read where they lie, for responses only: the rows that are no
    revisits, whose keys are broadcast if they are within BROADCAST_BYTES, else shuffled (by page and digest, so no page is hot).
    A task writes its rows in their order, under names of its partition, and each file appears under its name only when whole;
    so a repeated task replaces its files by the same ones. An empty table writes no file.
    """
    if "://" not in folder:
        folder = re.sub("^file:", "", folder)
        folder = f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        part, files, n, out, size = TaskContext.get().partitionId(), 0, 0, None, 0
        attempt = TaskContext.get().taskAttemptId()

        def close() -> None:
            nonlocal files, out, size
            if out:
                out.close()
                store.move(f"{path}/_{part}-{files}-{attempt}", f"{path}/pages-{part:06d}-{files:04d}.warc.gz")
                files, out, size = files + 1, None, 0

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = store.open_output_stream(f"{path}/_{part}-{files}-{attempt}", compression=None)
                    size = out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}-{files}')}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: tradewind\r\nformat: WARC File Format 1.1\r\n")) or 0
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                refers = record_id(r["top"], digest) if r["revisit"] else None
                body = page_record(r["page_id"], r["uri"], digest, r["size"], refers, r["top_uri"], r["payload"], date)
                out.write(body)
                size += len(body)
                n += 1
                if size >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    told = resolve(pages, min_bytes).filter("revisit").select("page_id", "uri", "size", "sha", "top", "top_uri")
    revisits = materialize(told)
    none = lambda t: F.lit(None).cast(t)
    keys = revisits.select(F.col("page_id").alias("r_page"), F.col("sha").alias("r_sha")).distinct()
    if revisits.count() * 64 <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.length("payload").cast("long"), "sha": F.sha1("payload")})
    rows = rows.join(keys, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("sha") == F.col("r_sha")), "left_anti")
    first = rows.select("page_id", "uri", "size", "sha", none("long").alias("top"), none("string").alias("top_uri"), "payload", F.lit(False).alias("revisit"))
    again = revisits.select("*", none("binary").alias("payload"), F.lit(True).alias("revisit"))
    return first.unionByName(again).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, decompressed."""
    view, pos = memoryview(data), 0
    while pos < len(view):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if pos >= len(view):
                raise ValueError("the archive ends within a record")
            piece = view[pos : pos + (1 << 16)]
            out.append(unpack.decompress(piece))
            pos += len(piece)
        pos -= len(unpack.unused_data)
        yield b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return headers, body[: int(headers["content-length"])]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The response and revisit records of all archives in a folder; the digest of each payload that is there is checked.

    payload_bytes is of the full payload, for revisits too; their payload is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for data in members(content.as_py()):
                    h, block = parse(data)
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    response = h["warc-type"] == "response"
                    if response and base32_sha1(payload) != digest:
                        raise ValueError(f"{h['warc-record-id']}: the payload doesn't have its digest")
                    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                    page = int(h["x-page-id"]) if "x-page-id" in h else None
                    rows.append((h["warc-record-id"], page, h.get("warc-target-uri"), h["warc-type"], size, digest, h.get("warc-refers-to"), payload if response else None))
                    held += len(payload)
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content").mapInArrow(run, RECORDS)


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the response's page_id) of the archives in a folder.

    Revisit records are joined to their responses by record id. Records told again stay as often as they are there.
    """
    heads = materialize(read_warc(spark, folder).drop("payload"))
    tops = heads.filter("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("refers_to"))
    revisits = heads.filter("record_type = 'revisit'").join(tops.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = heads.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return first.select(*names).unionByName(revisits.select(*names))
