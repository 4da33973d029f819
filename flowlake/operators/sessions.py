"""Idle-gap sessions per flow key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators.flow_keys import flow_keys, hot_keys
from flowlake.operators.ordered import previous_row, running_totals
from flowlake.session import settle

US = 1_000_000


def idle_sessions(packets: DataFrame, gap_s: int = fv.INACTIVE_TIMEOUT_S, hot_rows: int = 1_000_000) -> DataFrame:
    """(flow_key, start_us, end_us, pkts, bytes) per run of packets at most ``gap_s`` apart; the end is the last
    packet plus the gap.

    Ordinary keys use Spark's session window.  Keys above ``hot_rows`` packets are cut into time slots that carry the
    last packet and the count of breaks across, so no task walks a whole key.
    """
    keyed = flow_keys(packets)
    hot = hot_keys(keyed, hot_rows)
    if hot is None:
        return _session_window(keyed, gap_s)
    hot = settle(hot, "hot-keys")
    return _session_window(keyed.join(hot, "flow_key", "left_anti"), gap_s).unionByName(
        _slotted(keyed.join(hot, "flow_key", "left_semi"), gap_s))


def _session_window(keyed: DataFrame, gap_s: int) -> DataFrame:
    timed = keyed.withColumn("ts", F.timestamp_micros("ts_us"))
    return timed.groupBy("flow_key", F.session_window("ts", f"{gap_s} seconds").alias("w")).agg(
        F.count("*").alias("pkts"), F.sum("ip_len").alias("bytes")).select(
        "flow_key", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "pkts", "bytes")


def _slotted(keyed: DataFrame, gap_s: int, slot_s: int = 300) -> DataFrame:
    by, order = ["flow_key"], ["ts_us", "pkt_id"]
    rows = keyed.select("flow_key", *order, "ip_len", F.floor(F.col("ts_us") / F.lit(slot_s * US)).cast("long").alias("slot"))
    near = previous_row(rows, by, order, ["ts_us"], "prev", "slot")
    cut = near.withColumn("cut", (F.col("prev").isNull() | (F.col("ts_us") - F.col("prev.ts_us") > gap_s * US)).cast("long"))
    return running_totals(cut, by, "slot", order, {"n": F.col("cut")}).groupBy("flow_key", "n").agg(
        F.min("ts_us").alias("start_us"), (F.max("ts_us") + gap_s * US).alias("end_us"), F.count("*").alias("pkts"),
        F.sum("ip_len").alias("bytes")).drop("n")
