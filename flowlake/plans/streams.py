"""Queries that run as streams over the given tables and return what their sinks hold."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.operators import alerts as al
from flowlake.operators import drift, l7, scoring
from flowlake.plans.derived import table
from flowlake.plans.detection import AL, KL_SQL, active_rules, alerts, flows_to_judge, judged
from flowlake.plans.flows import NF_VIEWS, flow_ends, nf_columns_sql
from flowlake.plans.registry import ORACLES, query, rounded
from flowlake.plans.tables import NUMERIC, RF, raw_flows
from flowlake.session import new_path, settle
from flowlake.streaming import alerts as sal
from flowlake.streaming import flows as sfl
from flowlake.streaming.apps import resolve_apps_stream
from flowlake.streaming.jobs import batch_sink, collected, drain_parts, file_stream, latest


BATCHES = 6


def arriving(spark, df, at_us, key):
    """A folder, and what adds ``df`` to it in ``BATCHES`` parts, up to 20 seconds out of the order of ``at_us`` (microseconds).

    One pass deals the rows to the parts, spread by ``key``, as rows of one time lie together in the table; so every part is a
    file of like size per core, and is added by as many tasks."""
    folder, dealt = new_path(spark, "arriving"), new_path(spark, "arriving-parts")
    spark.createDataFrame([], df.schema).write.parquet(folder)
    arrival = at_us + F.pmod(F.xxhash64(key), F.lit(20_000_000))
    lo, hi = df.agg(F.min(arrival), F.max(arrival) + 1).first()
    part = F.floor((arrival - F.lit(lo)) * BATCHES / F.lit(hi - lo)) if lo is not None else F.lit(None)
    spread = df.withColumn("__part", part.cast("int")).repartition(spark.sparkContext.defaultParallelism, key)
    spread.write.partitionBy("__part").parquet(dealt)
    parts = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType())])).parquet(dealt)

    def add(i):
        parts.where(F.col("__part") == i).drop("__part").write.mode("append").parquet(folder)
    return folder, [partial(add, i) for i in range(BATCHES)]


def in_batches(spark, df, at_us, key):
    """``df`` as a stream, and what makes its ``BATCHES`` micro-batches arrive."""
    folder, arrivals = arriving(spark, df, at_us, key)
    return file_stream(spark, folder, "*.parquet", df.schema), arrivals


def stream_alerts_table(spark, sf):
    return in_batches(spark, alerts(spark, sf), F.unix_micros("ts"), "id")


def stream_raw_flows(spark, sf):
    """Raw flows have no time; ids are taken as tenths of a second, so they come up to 200 ids out of order."""
    return in_batches(spark, raw_flows(spark, sf), F.col("row_id") * 100_000, "row_id")


@query("stream_flows", nf_columns_sql(NF_VIEWS["nfv3_flows"]))
def stream_flows(spark, sf):
    packets = table(spark, sf, "packets")
    path, state = new_path(spark, "stream-flows"), new_path(spark, "stream-flow-state")
    sink = sfl.flow_sink(sfl.FlowState(spark, state, packets.schema), path)
    stream, arrivals = in_batches(spark, packets, F.col("ts_us"), "pkt_id")
    drain_parts(stream, sink, arrivals)
    sfl.flush(sfl.FlowState(spark, state, packets.schema), path)
    return rounded(spark.read.parquet(path).select("flow_id", *NF_VIEWS["nfv3_flows"]), 4)


@query("stream_traffic", AL + "SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS second_s, count(*) AS traffic, count(*) FILTER (is_attack) AS attacks FROM alerts GROUP BY 1")
def stream_traffic(spark, sf):
    stream, arrivals = stream_alerts_table(spark, sf)
    return latest(collected(sal.traffic(stream), arrivals, "update"), ["second_s"])


@query("stream_counters", AL + "SELECT is_attack, attack_type, count(*) AS n FROM alerts GROUP BY ALL")
def stream_counters(spark, sf):
    stream, arrivals = stream_alerts_table(spark, sf)
    return latest(collected(sal.running_counters(stream), arrivals, "update"), ["is_attack", "attack_type"])


@query("stream_alerts", ORACLES["alerts_short_circuit"])
def stream_alerts(spark, sf):
    path, rules_path = new_path(spark, "stream-alerts"), new_path(spark, "rules")
    active_rules(spark, sf).write.parquet(rules_path)
    stream, arrivals = stream_alerts_table(spark, sf)
    drain_parts(flows_to_judge(stream), sal.alert_sink(lambda s: s.read.parquet(rules_path), "stored", path), arrivals)
    return judged(spark.read.parquet(path))


@query("alerts_sink", AL + "SELECT id, source, is_attack, conf_milli::DOUBLE / 1000 AS confidence, attack_type FROM alerts")
def alerts_sink(spark, sf):
    path = new_path(spark, "alert-store")
    stream, arrivals = stream_alerts_table(spark, sf)
    queue = stream.withColumn("original_features", F.col("features")).select(
        "id", al.alert_json(["source", "is_attack", "confidence", "attack_type", "rule_id", "original_features"]).alias("payload"))
    drain_parts(al.parse_alerts(queue), batch_sink(path), arrivals)
    return spark.read.parquet(path).select("id", "source", "is_attack", "confidence", "attack_type")


@query("stream_replay_scores", RF + """SELECT row_id, in_pkts > 150 AS is_attack, least(1.0::DOUBLE, in_pkts / 300) AS confidence,
 CASE WHEN in_pkts > 150 THEN 'Malicious' ELSE 'Benign' END AS attack_type, CASE WHEN label = 0 THEN 'Benign' ELSE 'Attack' END AS truth FROM raw_flows""")
def stream_replay_scores(spark, sf):
    scoring.register_scorer("packet-count", lambda df: df.withColumns(
        scoring.decide(F.least(F.lit(1.0), F.col("in_pkts") / 300), 0.5)))
    flows, arrivals = stream_raw_flows(spark, sf)
    truth = F.when(F.col("label") == 0, "Benign").otherwise("Attack")
    scored = scoring.score(flows.withColumn("truth", truth).drop("label", "attack"), "packet-count")
    return collected(scored.select("row_id", "is_attack", "confidence", "attack_type", "truth"), arrivals).drop("batch")


@query("stream_sequences", RF + """SELECT row_id, dataset, sum(out_bytes) OVER (PARTITION BY dataset ORDER BY row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS digest
FROM raw_flows QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY row_id) >= 10""")
def stream_sequences(spark, sf):
    path = new_path(spark, "stream-sequences")
    stream, arrivals = stream_raw_flows(spark, sf)
    rows = stream.select("row_id", "dataset", "out_bytes")
    sink = sal.SequenceSink(spark, ["out_bytes"], path, late=250)
    drain_parts(rows, sink, arrivals)
    sink.flush(rows.schema)
    digest = F.aggregate(F.flatten("seq"), F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).select("row_id", "dataset", digest.alias("digest"))


@query("stream_drift", KL_SQL + "SELECT dataset, feature, round(kl, 5) + 0.0 AS kl, kl > 0.1 AS drifted FROM kl")
def stream_drift(spark, sf):
    edges, reference = drift.fit_reference(raw_flows(spark, sf).filter("dataset = 'unsw'"), NUMERIC)
    path, by = new_path(spark, "stream-drift"), ["dataset"]
    stream, arrivals = stream_raw_flows(spark, sf)
    drain_parts(stream.select(*by, *NUMERIC), sal.drift_sink(edges, NUMERIC, path, by), arrivals)
    done = sal.drift_so_far(spark.read.parquet(path), edges, reference, by)
    return rounded(done.select(*by, "feature", "kl", "drifted"), 5).withColumn("kl", F.col("kl") + 0.0)


def end_of_stream(df, at_us, folder, passing=None):
    """One more file with a row far ahead, of an address that nothing else has: it moves the watermark past all other rows.
    Added twice, the second one makes the batch in which that counts.  ``passing`` are the values that no filter before the
    watermark drops."""
    last = df.orderBy(F.desc(at_us)).limit(1).withColumns({
        at_us: F.col(at_us) + 86_400_000_000, "src_ip": F.lit("0.0.0.0"), "dst_ip": F.lit("0.0.0.0"),
        "proto": F.lit(17).cast(df.schema["proto"].dataType), **(passing or {})})
    last.coalesce(1).write.mode("append").parquet(folder)


@query("stream_l7", ORACLES["l7_resolved"])
def stream_l7(spark, sf):
    flows = flow_ends(table(spark, sf, "packets")).withColumn("l7_guess", l7.port_app_id(F.col("dst_port"), F.col("src_port"), F.col("proto")))
    flows, apps = settle(flows, "flow-ends"), settle(table(spark, sf, "app_flows"), "app-flows")
    streams, arrivals = [], []
    for df, at_us, key, passing in ((flows, "end_us", "flow_id", {}), (apps, "ts_us", "flow_no", {"is_guessed": F.lit(False)})):
        folder, parts = arriving(spark, df, F.col(at_us), key)
        arrivals.append([*parts, *[partial(end_of_stream, df, at_us, folder, passing)] * 2])
        streams.append(file_stream(spark, folder, "*.parquet", df.schema))
    both = [lambda pair=pair: [add() for add in pair] for pair in zip(*arrivals, strict=True)]
    answers = collected(resolve_apps_stream(*streams, "flow_id"), both)
    return flows.join(answers.select("flow_id", "cached_app"), "flow_id", "left").select(
        "flow_id", F.coalesce("cached_app", F.lit(-1)).alias("cached_app"),
        F.coalesce(F.nullif("cached_app", F.lit(0)), "l7_guess").alias("l7_proto"))
