import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from flowlake.llm import warc
from flowlake.session import new_path

SCHEMA = "page_id bigint, url string, html string, problem string"


def pages(spark):
    same, small = "é" * 60, "x" * 50
    rows = [(3, "http://a/\r\n b", same), (1, "http://b", same), (2, None, same), (4, "u", small), (5, "u", small), (6, "u", None),
            (7, "u", ""), (8, "u", "<p>" + "long " * 400_000), (9, "u", "x" * 100), (10, "u", "x" * 100), (None, "u", "alone" * 30),
            (11, "u", "q" * 99), (12, "u", "q" * 99), (13, "u", same), (13, "v", same)]
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_round_trip_equals_brute_force(spark):
    rows = pages(spark).collect()
    data = [(r["page_id"], (r["html"] or "").encode()) for r in rows]
    leaders = {}
    for i, b in data:
        if len(b) >= 100 and i is not None:
            leaders[b] = min(i, leaders.get(b, i))
    want = [(i, len(b), hashlib.sha256(b).hexdigest(), *(("response", None) if leaders.get(b, i) == i else ("revisit", leaders[b])), None)
            for i, b in data]
    got = [tuple(r) for r in warc.round_trip(pages(spark), spark).drop("url").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_archives_are_gzip_members_and_roll(spark):
    folder = new_path(spark, "archives")
    manifest = warc.write_archives(pages(spark).coalesce(1), folder, roll_bytes=300).collect()
    assert sum(m["records"] for m in manifest) == 15 and len(manifest) > 2
    for m in manifest:
        path = m["archive"].removeprefix("file:")
        assert os.path.getsize(path) == m["bytes"]
        assert gzip.open(path).read().count(b"WARC/1.1\r\n") == m["records"]


def member(payload, **change):
    data = warc.record(1, "u", payload, hashlib.sha256(payload).hexdigest(), None, "2024-01-01T00:00:00Z")
    for old, new in change.values():
        data = data.replace(old, new)
    return gzip.compress(data)


def test_reader_tells_faults():
    good = list(warc.read_records(io.BytesIO(member(b"abc") + member(b""))))
    assert [r[1] for r in good] == [3, 0] and all(r[6] is None for r in good)
    assert next(warc.read_records(io.BytesIO(member(b"abc", x=(b"abc", b"abd")))))[6] == "block digest"
    assert next(warc.read_records(io.BytesIO(member(b"abc", x=(b"Content-Length: 8", b"Content-Length: 9")))))[6] == "framing"
    assert next(warc.read_records(io.BytesIO(member(b"abc", x=(b"\r\n\r\nabc\r\n\r\n", b"\r\n\r\nabc")))))[6] == "framing"
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(member(b"abc")[:-9])))


def test_missing_record_fails_the_job(spark):
    manifest = warc.write_archives(pages(spark), new_path(spark, "archives"))
    with pytest.raises(Exception, match="the manifest has"):
        warc.read_archives(manifest.withColumn("records", F.col("records") + 1)).count()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), spark).count() == 0


def test_archives_are_read_by_many_tasks(spark):
    manifest = spark.createDataFrame([(f"a{i}", 1000, 1 << 20) for i in range(64)], warc.MANIFEST)
    assert warc.read_tasks(manifest) == spark.sparkContext.defaultParallelism
    assert warc.read_tasks(manifest, per_task=1 << 21) == 32
    assert warc.read_tasks(manifest.limit(0)) == 1 and warc.read_tasks(manifest.limit(3)) == 3
    written = warc.write_archives(pages(spark).coalesce(1), new_path(spark, "archives"), roll_bytes=300)
    n = written.count()
    assert n > 2 and warc.read_archives(written).withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    assert warc.read_archives(written).rdd.getNumPartitions() == min(n, spark.sparkContext.defaultParallelism)
