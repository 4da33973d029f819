"""Flow assembly: golden cases, and all ways of segmenting against a plain per-packet walk."""

import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from flowlake.operators import cic, nfv3_features, nfv3_segments, sessions
from flowlake.operators.flow_keys import flow_keys
from flowlake.operators.nfv3_segments import CloseRules
from flowlake.session import settle
from tests.packets import Capture


def cic_rows(spark, cap, **kw):
    return cic.cic_record(cic.cic_segments(cap.frame(spark), **kw)).orderBy("flow_key", "seg").collect()


def nf_rows(spark, cap, **kw):
    return nfv3_features.nfv3_record(nfv3_segments.segment_flows(cap.frame(spark), **kw)).orderBy("flow_id").collect()


def test_cic_closes_on_fin_with_84_columns(spark):
    rows = cic_rows(spark, Capture().tcp(1000, "S").tcp(1000.1, "A").tcp(1000.2, "FA"))
    assert len(rows) == 1
    assert len(rows[0]) - 2 == 84


def test_cic_direction_counts(spark):
    a, b = ("10.0.0.1", 1000), ("10.0.0.2", 80)
    cap = Capture().tcp(1000, "S").tcp(1000.1, "A").tcp(1000.2, "PA", payload=10).tcp(1000.3, "A", b, a).tcp(1000.4, "FA", b, a)
    row = cic_rows(spark, cap)[0]
    assert (row["Tot Fwd Pkts"], row["Tot Bwd Pkts"]) == (3, 2)


def test_cic_timeout_flush_and_rst(spark):
    assert len(cic_rows(spark, Capture().udp(1000).udp(1015.5), timeout_s=10)) == 2
    assert len(cic_rows(spark, Capture().udp(1000).tcp(1000, "S"))) == 2
    assert len(cic_rows(spark, Capture().tcp(1000, "S").tcp(1000.1, "R").tcp(1000.2, "S"))) == 2


def test_cic_duration_flags_and_zero_duration(spark):
    row = cic_rows(spark, Capture().tcp(1000, "S").tcp(1001, "F"))[0]
    assert row["Flow Duration"] == 1_000_000
    row = cic_rows(spark, Capture().tcp(1000, "S").tcp(1000.1, "PA").tcp(1000.2, "FA"))[0]
    assert [row[c] for c in ("SYN Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt", "FIN Flag Cnt")] == [1, 1, 2, 1]
    row = cic_rows(spark, Capture().tcp(1000, "S").tcp(1000, "F"))[0]
    assert all(v == v and abs(v) != float("inf") for v in row if isinstance(v, float))


def test_syn_gate(spark):
    assert nf_rows(spark, Capture().tcp(1000, "A")) == []
    assert len(nf_rows(spark, Capture().tcp(1000, "A"), rules=CloseRules(require_syn=False))) == 1
    assert len(nf_rows(spark, Capture().tcp(1000, "S"))) == 1


def test_nfv3_values(spark):
    a, b = ("10.0.0.1", 1000), ("10.0.0.2", 443)
    cap = (Capture().tcp(1000, "S", a, b).tcp(1000.5, "SA", b, a, window=100).tcp(1001, "A", a, b, payload=100, seq=7)
           .tcp(1002, "A", a, b, payload=100, seq=7))
    row = nf_rows(spark, cap)[0]
    assert (row.IN_PKTS, row.OUT_PKTS, row.IN_BYTES, row.OUT_BYTES) == (3, 1, 320, 40)
    assert (row.RETRANSMITTED_IN_PKTS, row.RETRANSMITTED_IN_BYTES, row.RETRANSMITTED_OUT_PKTS) == (1, 140, 0)
    assert (row.TCP_FLAGS, row.CLIENT_TCP_FLAGS, row.SERVER_TCP_FLAGS) == (18, 18, 18)
    assert (row.FLOW_DURATION_MILLISECONDS, row.DURATION_IN, row.DURATION_OUT) == (2000, 2000, 0)
    assert (row.SRC_TO_DST_IAT_MIN, row.SRC_TO_DST_IAT_MAX, row.SRC_TO_DST_IAT_STDDEV) == (1000, 1000, 0)
    assert row.SRC_TO_DST_SECOND_BYTES == 160 and row.SRC_TO_DST_AVG_THROUGHPUT == 1280
    assert row.L7_PROTO == 91 and row.NUM_PKTS_UP_TO_128_BYTES == 2 and row.NUM_PKTS_128_TO_256_BYTES == 2
    assert len(row) - 1 == 53


def walk(packets, rules):
    """The close rules, one packet at a time: {pkt_id: (flow id, forward?)}."""
    out, us = {}, 1_000_000
    keys = {}
    for p in packets:
        keys.setdefault(p.flow_key, []).append(p)
    for rows in keys.values():
        flow, last = None, None
        for p in sorted(rows, key=lambda r: (r.ts_us, r.pkt_id)):
            tcp = p.proto == 6
            if flow and p.ts_us - last > rules.inactive_s * us:
                flow = None
            last = p.ts_us
            if flow is None:
                if tcp and rules.require_syn and not p.tcp_flags & 2:
                    continue
                flow = {"id": p.pkt_id, "t0": p.ts_us, "side": p.from_lo, "fins": set(), "limit": None}
            out[p.pkt_id] = (flow["id"], p.from_lo == flow["side"])
            late = flow["limit"] is not None and p.ts_us > flow["limit"]
            if tcp and p.tcp_flags & 1:
                flow["fins"].add(p.from_lo)
                flow["limit"] = flow["limit"] or p.ts_us + rules.fin_grace_s * us
            if (tcp and p.tcp_flags & 4) or late or p.ts_us - flow["t0"] > rules.active_s * us or len(flow["fins"]) == 2:
                flow = None
    return out


def random_capture(seed, n=700):
    rng = random.Random(seed)
    cap, t = Capture(), 1000.0
    ends = [("10.0.0.1", 1000), ("10.0.0.2", 80), ("10.0.0.3", 9)]
    for _ in range(n):
        t += rng.choice([0, 0.2, 1, 3, 4, 6, 14, 16]) * rng.choice([0.1, 0.5, 1, 1])
        src, dst = rng.sample(ends, 2)
        if rng.random() < 0.4:
            cap.udp(t, src, dst)
        else:
            cap.tcp(t, rng.choice(["S", "SA", "A", "A", "A", "FA", "F", "PA", "R", "SF"]), src, dst)
    return cap


@pytest.mark.parametrize("seed,rules", [(1, CloseRules()), (2, CloseRules(active_s=20, inactive_s=30)),
                                        (3, CloseRules(require_syn=False, fin_grace_s=2))])
def test_segments_equal_a_plain_walk_on_both_paths(spark, seed, rules):
    packets = random_capture(seed).frame(spark)
    want = walk(flow_keys(packets).collect(), rules)
    for hot_rows in (1_000_000, 0):
        got = nfv3_segments.segment_flows(packets, rules, hot_rows).select("pkt_id", "flow_id", "fwd").collect()
        assert {r.pkt_id: (r.flow_id, r.fwd) for r in got} == want


def test_hot_and_ordinary_keys_together(spark):
    packets = random_capture(5).frame(spark)
    sizes = sorted(r["count"] for r in flow_keys(packets).groupBy("flow_key").count().collect())
    cols = ["pkt_id", "flow_id", "fwd"]
    split = nfv3_segments.segment_flows(packets, hot_rows=sizes[len(sizes) // 2]).select(cols).collect()
    whole = nfv3_segments.segment_flows(packets).select(cols).collect()
    assert sorted(split) == sorted(whole)


def test_cic_slots_do_not_change_flows(spark):
    packets = random_capture(4).frame(spark)
    one = cic.cic_record(cic.cic_segments(packets)).collect()
    two = cic.cic_record(cic.cic_segments(packets, hot_rows=0)).collect()
    fix = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert fix(one) == fix(two)


def test_packets_per_flow_add_up(spark):
    packets = random_capture(6).frame(spark)
    seg = nfv3_segments.segment_flows(packets)
    sizes = {r.flow_id: r["count"] for r in seg.groupBy("flow_id").count().collect()}
    flows = nfv3_features.nfv3_record(seg).select("flow_id", (F.col("IN_PKTS") + F.col("OUT_PKTS")).alias("n")).collect()
    assert {r.flow_id: r.n for r in flows} == sizes


def test_one_shuffle_for_a_record(spark):
    packets = random_capture(7, 50).frame(spark)
    plan = nfv3_features.nfv3_record(nfv3_segments.segment_flows(packets))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_records_of_long_flows_take_time_in_proportion_to_their_slots(spark):
    one = Capture().udp(1000).frame(spark).drop("pkt_id", "ts_us")
    n, step = 24_000, 15_000_000  # a slot of its own for every packet; each third gap is a second longer
    times = spark.range(n).select(F.col("id").alias("pkt_id"), (F.col("id") * step + F.floor((F.col("id") + 2) / 3) * 1_000_000).alias("ts_us"))
    seg = nfv3_segments.segment_flows(times.crossJoin(one), nfv3_segments.CloseRules(active_s=1 << 31, inactive_s=1 << 31))
    began = time.monotonic()
    flow, = nfv3_features.nfv3_record(seg).collect()
    assert time.monotonic() - began < 60  # with one pass over all slots per slot: several minutes
    gaps = [15_000.0 + 1000 * (i % 3 == 0) for i in range(n - 1)]
    assert flow.IN_PKTS == n and (flow.SRC_TO_DST_IAT_MIN, flow.SRC_TO_DST_IAT_MAX) == (15_000, 16_000)
    assert flow.SRC_TO_DST_IAT_AVG == pytest.approx(statistics.fmean(gaps)) and flow.SRC_TO_DST_IAT_STDDEV == pytest.approx(statistics.pstdev(gaps))


def test_idle_sessions_with_and_without_slots(spark):
    packets = random_capture(8).frame(spark)
    assert sorted(sessions.idle_sessions(packets).collect()) == sorted(sessions.idle_sessions(packets, hot_rows=0).collect())


@pytest.mark.parametrize("seed", [21, 22])
def test_records_merge_to_the_same_whatever_the_slots(spark, seed):
    packets = random_capture(seed, 500).frame(spark)
    packets = packets.withColumns({"tcp_seq": F.col("pkt_id") % 5, "payload_len": F.col("pkt_id") % 2})  # many repeated segments
    seg = nfv3_segments.segment_flows(packets, CloseRules(active_s=1 << 20, inactive_s=1 << 20, require_syn=False)).cache()
    fix = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    whole = fix(nfv3_features.nfv3_record(seg, slot_s=1 << 20))
    assert any(r.RETRANSMITTED_IN_PKTS > 1 for r in nfv3_features.nfv3_record(seg).collect())
    for slot_s in (1, 7, 60):
        assert fix(nfv3_features.nfv3_record(seg, slot_s=slot_s)) == whole
    stored = nfv3_features.nfv3_record(settle(seg, "segments"))
    windows = [x for x in stored._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and all("slot" in x or "first_here" in x or "_w" in x for x in windows)  # none spans a whole flow
