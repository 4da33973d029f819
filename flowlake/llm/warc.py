"""WARC archives: one gzip member per record, written in parallel, read back sequentially.

The reader inflates each file in small pieces, one zlib stream per member, frames records by content length and checks
the block and payload digests.  Archives are reached through pyarrow's file systems (local paths, file:, s3:, gs:,
hdfs:), as Spark has no writer for raw bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.session import new_path, settle

LEAST_REVISIT = 100  # payloads of fewer bytes are always stored
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-page:"
PIECE = 1 << 16
MANIFEST = "archive string, records bigint, bytes bigint"
READ_SCHEMA = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
               "url string, problem string")


def with_roles(pages: DataFrame, page_id: str, payload: Column) -> DataFrame:
    """Add payload, digest and leader: of equal payloads of at least 100 bytes, the smallest id; null for single ones.

    Only ids and digests of equal payloads are aggregated, partially before the shuffle, so copies in any number are no
    hot key there; the join that brings the leader back is a plain equi join, which Spark splits when it is skewed.
    """
    body = pages.withColumn("__payload", payload).withColumn("__digest", F.sha2("__payload", 256))
    leaders = (body.where(F.octet_length("__payload") >= LEAST_REVISIT).groupBy("__digest")
               .agg(F.min(page_id).alias("__leader"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    return body.join(settle(leaders, "warc-leaders"), "__digest", "left")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, leader: int | None, date: str) -> bytes:
    """One record: a response, or a revisit of ``leader`` that has the HTTP header only."""
    revisit = leader is not None and page_id != leader
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{leader}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   date: str = "2024-01-01T00:00:00Z", roll_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Write one record per row of ``pages`` into archives below ``folder``; returns the manifest of finished archives.

    A null html is an empty payload, a null url has no target header, a null id an empty record id.  Rows that share
    payload and smallest id are all responses.  Archives are closed at ``roll_bytes``.  File names hold the task
    attempt and the manifest lists only what finished attempts wrote, so a task lost half-way or run twice leaves no
    record missing or doubled.  An empty table gives an empty manifest.
    """
    rows = with_roles(pages, page_id, F.coalesce(F.col(html), F.lit("")).cast("binary")).select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), "__payload", "__digest",
        F.col("__leader").cast("long").alias("leader"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{folder}/{task.partitionId():05d}-{task.taskAttemptId()}"
        done, out, count, size, path = [], None, 0, 0, ""
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{name}-{len(done):04d}.warc.gz"
                    out, count, size = store.open_output_stream(f"{base}/{path.rpartition('/')[2]}", compression=None), 0, 0
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(*values, date)) + packer.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= roll_bytes:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["archive", "records", "bytes"])

    return settle(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def inflated(stream: BinaryIO) -> Iterator[tuple[bytes, bool]]:
    """Pieces of at most ``PIECE`` bytes of each gzip member, with True at a member's end; EOFError if one is cut off."""
    member, data = zlib.decompressobj(31), b""
    fed = False
    while True:
        if not data:
            data = stream.read(PIECE)
            if not data:
                if fed:
                    raise EOFError("archive ends inside a member")
                return
        piece, fed = member.decompress(data, PIECE), True
        if member.eof:
            data, member, fed = member.unused_data, zlib.decompressobj(31), False
            yield piece, True
        else:
            data = member.unconsumed_tail
            yield piece, False


def parsed(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(RECORD)
    return int(digits) if digits else None


def read_records(stream: BinaryIO) -> Iterator[tuple]:
    """A row of ``READ_SCHEMA`` per record.  The payload goes through the hash piece by piece and is never held whole."""
    buffer, head, http, left, problem = b"", None, None, 0, None
    block_hash, payload_hash, payload = hashlib.sha256(), hashlib.sha256(), 0
    for piece, last in inflated(stream):
        buffer += piece
        if head is None and b"\r\n\r\n" in buffer:
            lines, _, buffer = buffer.partition(b"\r\n\r\n")
            head = parsed(lines)
            left = int(head["content-length"])
        if head is not None:
            block, buffer = buffer[:left], buffer[left:]
            left -= len(block)
            block_hash.update(block)
            if isinstance(http, dict):
                payload_hash.update(block)
                payload += len(block)
            else:
                http = (http or b"") + block
                if b"\r\n\r\n" in http:
                    lines, _, block = http.partition(b"\r\n\r\n")
                    http = parsed(lines)
                    payload_hash.update(block)
                    payload += len(block)
        if not last:
            continue
        if head is None or left or buffer != b"\r\n\r\n" or not isinstance(http, dict):
            problem = "framing"
        head, http = head or {}, http if isinstance(http, dict) else {}
        kind, claimed = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha256:")
        if not problem and head.get("warc-block-digest") != f"sha256:{block_hash.hexdigest()}":
            problem = "block digest"
        if not problem and kind == "response" and claimed != payload_hash.hexdigest():
            problem = "payload digest"
        size = payload if kind == "response" else int(http.get("content-length", 0))
        yield (number(head.get("warc-record-id")), size, claimed, kind, number(head.get("warc-refers-to")),
               head.get("warc-target-uri"), problem)
        buffer, head, http, left, problem = b"", None, None, 0, None
        block_hash, payload_hash, payload = hashlib.sha256(), hashlib.sha256(), 0


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of all archives of ``manifest``, one task per few archives; ``problem`` is null for sound records.

    A record of wrong framing or digest stays in the result with its problem; an archive that ends inside a member, or
    has fewer or more records than the manifest says, fails the job.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("problem", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch["archive"].to_pylist(), batch["records"].to_pylist(), strict=True):
                store, name = pafs.FileSystem.from_uri(path)
                count, rows = 0, []
                with store.open_input_stream(name, compression=None) as stream:
                    for row in read_records(stream):
                        rows.append(row)
                        count += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                            rows = []
                if count != records:
                    raise ValueError(f"{path}: {count} records, the manifest has {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return manifest.repartition(read_tasks(manifest)).mapInArrow(read, READ_SCHEMA)


def read_tasks(manifest: DataFrame, per_task: int = 1 << 28) -> int:
    """Tasks that read the archives: one for every 256 MB or 64,000 records, at least one per core as far as there are archives.

    A number given to ``repartition`` stays; without one, Spark would join the small manifest rows into a single task.
    """
    total = manifest.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records")).first()
    wanted = max((total["bytes"] or 0) // per_task, (total["records"] or 0) // 64_000, manifest.sparkSession.sparkContext.defaultParallelism)
    return max(1, min(total["n"], wanted))


def round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Write ``pages`` into archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, new_path(spark, "warc")))
