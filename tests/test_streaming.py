"""Streams fed in several micro-batches against the batch operators."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators import datasets, l7, nfv3_features, nfv3_segments
from flowlake.plans import streams
from flowlake.plans.derived import table
from flowlake.streaming import alerts as sal
from flowlake.streaming import flows as sfl
from flowlake.streaming.apps import resolve_apps_stream
from flowlake.streaming.jobs import batch_sink, drain, latest
from tests.conftest import SMALL
from tests.packets import Capture
from tests.sql import assert_equals_sql
from tests.test_flows import random_capture


def feed(df, folder, parts, order):
    """Write ``df`` as consecutive files; returns the writer of each next file."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        yield df.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode(
            "append").parquet(folder)


def test_flows_over_shuffled_batches_and_a_restart_equal_batch_flows(spark, tmp_path):
    packets = random_capture(11, 300).frame(spark)
    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([], packets.schema).write.parquet(folder)
    stream = spark.readStream.schema(packets.schema).parquet(folder)
    span = packets.agg(F.max("ts_us") - F.min("ts_us")).first()[0] // 1_000_000 + 1
    checkpoint = None
    for _ in feed(packets, folder, 5, F.md5(F.col("pkt_id").cast("string"))):  # any order, each time a new sink: a restart
        sink = sfl.flow_sink(sfl.FlowState(spark, state, packets.schema), path, late_s=span)
        checkpoint = drain(stream, sink, checkpoint=checkpoint)
    assert sfl.flush(sfl.FlowState(spark, state, packets.schema), path) == 0
    want = nfv3_features.nfv3_record(nfv3_segments.segment_flows(packets))
    fix = lambda df: sorted(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in df.select(want.columns).collect())
    assert fix(spark.read.parquet(path)) == fix(want)


def test_flows_close_by_watermark_and_late_packets_are_counted(spark, tmp_path):
    path, schema = str(tmp_path / "out"), Capture().frame(spark).schema
    state = sfl.FlowState(spark, str(tmp_path / "state"), schema)
    sink = sfl.flow_sink(state, path, late_s=5)
    n_rows = lambda: spark.read.parquet(path).count()
    sink(Capture().udp(1000).udp(1010).frame(spark), 0)
    assert n_rows() == 0
    late = Capture()
    late.ids = iter(range(10, 99))
    late.udp(1007).udp(1024).udp(1030)  # 1007 comes out of order, but within the five seconds
    sink(late.frame(spark), 1)
    sink(late.frame(spark), 1)  # run again
    other = Capture()
    other.ids = iter(range(100, 199))
    sink(other.udp(1003).udp(1100, ("10.9.9.9", 1)).frame(spark), 2)  # 1003 is late
    rows = [r for r in spark.read.parquet(path).collect()]
    assert [(r.IN_PKTS, r.FLOW_START_MILLISECONDS) for r in rows] == [(5, 1_000_000)]
    sink(Capture().frame(spark), 3)  # an empty batch carries the state on
    assert sfl.flush(state, path) == 1 and n_rows() == 2


def test_a_batch_is_segmented_once_and_its_live_keys_are_found_first(spark, tmp_path, monkeypatch):
    cap = Capture()
    for i in range(20):  # all but the last one are over when the watermark comes
        cap.udp(1000 + i, ("10.0.1.1", 2000 + i))
    cap.udp(1059, ("10.0.1.1", 3000)).udp(1061, ("10.0.1.1", 3000)).udp(1066, ("10.0.1.1", 4000))
    seen = []
    monkeypatch.setattr(sfl, "segment_flows", lambda df, *a, **k: seen.append(df.count()) or nfv3_segments.segment_flows(df, *a, **k))
    closed, going = sfl.closed_and_open(cap.frame(spark).where("ts_us <= 1061000000"), 1061_000_000, nfv3_segments.CloseRules())
    assert sorted(seen) == [2, 22]
    assert (closed.count(), going.count()) == (20, 2)


def test_sequences_across_batches(spark, tmp_path):
    df = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("string").alias("dataset"),
                                (F.col("id") * 7 % 13).alias("v"))
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], df.schema).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    checkpoint = None
    for _ in feed(df, folder, 4, "row_id"):  # each time a new sink: a restart
        checkpoint = drain(stream, sal.SequenceSink(spark, ["v"], path, length=5), checkpoint=checkpoint)
    last = spark.createDataFrame([(60, "true", 1), (61, "false", 2)], df.schema)
    sink = sal.SequenceSink(spark, ["v"], path, length=5)
    for batch, rows in ((4, last.filter("false")), (5, last), (5, last)):  # an empty batch, and one that is run again
        sink(rows, batch)
    df = df.union(last)
    got = {r.row_id: r.seq for r in spark.read.parquet(path).collect()}
    want = {r.row_id: r.seq for r in datasets.sequences(df, ["v"], length=5).collect()}
    assert got == want


def test_sequences_of_shuffled_batches_equal_the_batch_operator(spark, tmp_path):
    df = spark.range(90).select(F.col("id").alias("row_id"), (F.when(F.col("id") % 7 > 0, F.col("id") % 3 == 0)).cast("string").alias("dataset"),
                                (F.col("id") * 7 % 13).alias("v"))
    path = str(tmp_path / "out")
    sink, rows = sal.SequenceSink(spark, ["v"], path, length=4, late=30), df.collect()
    random.Random(5).shuffle(rows)
    rows.sort(key=lambda r: r.row_id // 30)  # out of order within thirty ids
    for batch in range(6):
        part = spark.createDataFrame(rows[15 * batch:15 * batch + 15], df.schema)
        for _ in range(1 + (batch == 2)):  # one is run again
            sink(part, batch)
    sink(spark.createDataFrame([(1, "true", 5)], df.schema), 6)  # far too late
    sink.flush(df.schema)
    got = {r.row_id: r.seq for r in spark.read.parquet(path).collect()}
    assert got == {r.row_id: r.seq for r in datasets.sequences(df, ["v"], length=4).collect()}


def test_traffic_counts_survive_batches(spark, tmp_path):
    df = spark.range(200).select(F.timestamp_seconds(F.col("id") / 10).alias("ts"), (F.col("id") % 3 == 0).alias("is_attack"))
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], df.schema).write.parquet(folder)
    stream = sal.traffic(spark.readStream.schema(df.schema).parquet(folder))
    checkpoint = None
    for _ in feed(df, folder, 3, "ts"):
        checkpoint = drain(stream, batch_sink(path), "update", checkpoint)
    got = latest(spark.read.parquet(path), ["second_s"])
    assert got.agg(F.sum("traffic"), F.sum("attacks")).first()[:] == (200, 67)
    assert got.count() == 20


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    sink = batch_sink(str(tmp_path / "out"))
    for _ in range(2):
        sink(spark.range(5), 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


STREAMS = ["stream_flows", "stream_traffic", "stream_counters", "stream_alerts", "alerts_sink", "stream_replay_scores",
           "stream_sequences", "stream_drift", "stream_l7"]


@pytest.mark.parametrize("name", STREAMS)
def test_stream_queries_over_many_batches_equal_their_sql(spark, name):
    assert streams.BATCHES >= 5
    assert_equals_sql(spark, name, SMALL)


def test_parts_of_a_stream_are_written_by_many_tasks(spark):
    df = spark.range(0, 4000, 1, 4)
    folder, arrivals = streams.arriving(spark, df, F.col("id") * 1_000_000, "id")
    seen = []
    for arrive in arrivals:
        arrive()
        held = spark.read.parquet(folder).withColumn("file", F.input_file_name())
        seen.append((held.count(), held.select("file").distinct().count()))
    sizes = [n - before for (n, _), (before, _) in zip(seen, [(0, 0), *seen])]
    assert seen[-1][0] == 4000 and len(seen) == streams.BATCHES and all(600 < n < 720 for n in sizes)
    assert seen[-1][1] > streams.BATCHES  # not one file, written by one task, each
    assert spark.read.parquet(folder).exceptAll(df).isEmpty()


def test_every_part_is_spread_over_the_cores(spark):
    df = spark.range(0, 4000, 1, 4)  # in order of time, so a part lies in two tasks at most
    folder, arrivals = streams.arriving(spark, df, F.col("id") * 1_000_000, "id")
    files = lambda: {r[0]: r[1] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()}
    before = {}
    for arrive in arrivals:
        arrive()
        now = files()
        new = [n for f, n in now.items() if f not in before]
        assert len(new) >= 3 and max(new) < 0.6 * sum(new)
        before = now


def test_stream_l7_when_the_newest_entry_is_a_guess(spark, tmp_path):
    """The newest entry is dropped before the watermark; the end of the stream must still move it."""
    ids = [8 * c + p for c in (4, 5, 6, 7, 27) for p in range(8)]  # conversation 27 has a guessed, unknown application
    rows = [(i, datetime(2024, 1, 1), 1, "view", 1.0) for i in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/orders.parquet")
    newest = table(spark, str(tmp_path), "app_flows").orderBy(F.desc("ts_us")).first()
    assert (newest.app_name, newest.is_guessed) == ("Unknown", True)
    assert_equals_sql(spark, "stream_l7", tmp_path)
    assert streams.stream_l7(spark, str(tmp_path)).where("cached_app > 0").count() > 0


def test_app_cache_answers_as_of_the_event_for_any_arrival_order(spark, tmp_path):
    """Entries after the question, too old, of the other direction, guessed, and a question before any entry."""
    flow = "flow_id long, src_ip string, src_port long, dst_ip string, dst_port long, proto int, end_us long"
    app = "flow_no long, src_ip string, src_port long, dst_ip string, dst_port long, proto int, app_name string, is_guessed boolean, ts_us long"
    a, b = ("10.0.0.1", 1000), ("10.0.0.2", 443)
    s = 1_000_000
    entries = [(1, *a, *b, 6, "HTTP", False, 1000 * s), (2, *b, *a, 6, "DNS", False, 1100 * s), (3, *a, *b, 6, "TLS.Google", False, 1300 * s),
               (4, *a, *b, 6, "Unknown", True, 1310 * s)]
    times = {1: 990, 2: 1000, 3: 1150, 4: 1299, 5: 1301, 6: 1315, 7: 1650, 8: 1750, 9: 1900, 10: 1901, 11: 2600}
    asked = [(i, *(a + b if i % 2 else b + a), 6, t * s) for i, t in times.items()]
    far = [(99, "0.0.0.0", 1, "0.0.0.0", 2, 17)]
    folders, frames = [str(tmp_path / n) for n in ("asked", "entries")], []
    for folder, rows, schema, end in ((folders[0], asked, flow, (90_000 * s,)), (folders[1], entries, app, ("HTTP", False, 90_000 * s))):
        shuffled = sorted(rows, key=lambda r: hash((r[0] * 7919) % 13))
        parts = [[r] for r in shuffled] + [[(*far[0], *end)]] * 2
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        frames.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    path = str(tmp_path / "out")
    drain(resolve_apps_stream(*frames, "flow_id", late="3000 seconds"), batch_sink(path))
    got = {r.flow_id: r.cached_app for r in spark.read.parquet(path).collect()}
    batch = l7.resolve_apps(spark.createDataFrame(asked, flow), spark.createDataFrame(entries, app))
    assert got == {r.flow_id: r.cached_app for r in batch.collect()}
    http, dns, tls = (fv.APP_NAME_ID[n] for n in ("HTTP", "DNS", "TLS"))
    assert got == {1: None, 2: http, 3: http, 4: dns, 5: tls, 6: dns, 7: tls, 8: tls, 9: tls, 10: None, 11: None}
