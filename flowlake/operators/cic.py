"""CIC flows: segmentation and the 84-column record.

A flow ends with any FIN or RST packet, or before a gap above the timeout; there is no SYN gate and no age limit, so
one flow may hold any number of packets.  No step therefore gathers a flow: cuts and same-side gaps look at one
previous packet, features are partial aggregates kept per endpoint, and the forward side is chosen after grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators.flow_keys import ACK, CWR, ECE, FIN, PSH, RST, SYN, URG, flow_keys, hot_keys
from flowlake.operators.ordered import previous_row, running_totals
from flowlake.session import settle

US = 1_000_000


def cic_segments(packets: DataFrame, timeout_s: int = fv.CIC_TIMEOUT_S, hot_rows: int = 1_000_000) -> DataFrame:
    """Packets with ``flow_key``, ``seg`` (1, 2, ... per key), ``gap_us`` (to the flow's previous packet, null on its
    first) and ``side_gap_us`` (to the previous packet of the same sender in the flow, null on that side's first).

    Keys above ``hot_rows`` packets are cut into time slots that carry the last packet and the count of cuts across.
    """
    keyed = flow_keys(packets)
    hot = hot_keys(keyed, hot_rows)
    if hot is None:
        return _segment(keyed, timeout_s, None)
    hot = settle(hot, "hot-keys")
    return _segment(keyed.join(hot, "flow_key", "left_anti"), timeout_s, None).unionByName(
        _segment(keyed.join(hot, "flow_key", "left_semi"), timeout_s, 300))


def _segment(keyed: DataFrame, timeout_s: int, slot_s: int | None) -> DataFrame:
    by, order = ["flow_key"], ["ts_us", "pkt_id"]
    bucket = None
    if slot_s:
        bucket = "slot"
        keyed = keyed.withColumn(bucket, F.floor(F.col("ts_us") / F.lit(slot_s * US)).cast("long"))
    ends = (F.col("proto") == 6) & (F.col("tcp_flags").bitwiseAND(F.lit(FIN | RST)) != 0)
    rows = previous_row(keyed.withColumn("ends", ends), by, order, ["ts_us", "ends"], "prev", bucket)
    gap = F.col("ts_us") - F.col("prev.ts_us")
    cut = (F.col("prev").isNull() | F.col("prev.ends") | (gap > timeout_s * US)).cast("long")
    if bucket:
        rows = running_totals(rows.withColumn("cut", cut), by, bucket, order, {"seg": F.col("cut")})
    else:
        rows = rows.withColumn("cut", cut).withColumn("seg", F.sum("cut").over(
            Window.partitionBy(*by).orderBy(*order)))
    rows = previous_row(rows, [*by, "from_lo"], order, ["ts_us", "seg"], "side", bucket)
    return rows.withColumns({
        "gap_us": F.when(F.col("cut") == 0, gap),
        "side_gap_us": F.when(F.col("side.seg") == F.col("seg"), F.col("ts_us") - F.col("side.ts_us")),
    }).drop("prev", "side", "cut", "ends", "slot")


def _stats(name: str, value: Column, kinds: tuple[str, ...]) -> dict[str, Column]:
    made = {"Max": F.max, "Min": F.min, "Mean": F.avg, "Std": F.stddev_pop, "Var": F.var_pop, "Tot": F.sum}
    return {f"{name} {k}": F.coalesce(made[k](value), F.lit(0.0)).cast("double") for k in kinds}


def cic_record(segmented: DataFrame) -> DataFrame:
    """The 84 CIC columns per flow, plus ``flow_key`` and ``seg``.

    Durations are in microseconds while inter-arrival times are in seconds, as the format has it.
    """
    length, lo = F.col("frame_len"), F.col("from_lo")
    tcp = F.col("proto") == 6
    header = F.col("ip_ihl") * 4 + F.when(tcp, F.col("tcp_dataofs") * 4).otherwise(8)
    payload = F.greatest(F.lit(0), length - header)
    opens, side_opens = F.col("gap_us").isNull(), F.col("side_gap_us").isNull()
    has = lambda mask: tcp & (F.col("tcp_flags").bitwiseAND(F.lit(mask)) != 0)
    four = ("Max", "Min", "Mean", "Std")
    secs = lambda c: c / F.lit(1e6)
    gap = secs(F.col("gap_us"))
    idle = F.col("gap_us") > fv.CIC_IDLE_GAP_S * US

    shared = {
        "lo_first": F.bool_or(opens & lo), "first_window": F.coalesce(F.max(F.when(opens, F.col("tcp_window"))), F.lit(0)),
        "t0": F.min("ts_us"), "t1": F.max("ts_us"),
        **_stats("Pkt Len", length, ("Min", "Max", "Mean", "Std", "Var")), "tot_bytes": F.sum(length),
        **_stats("Flow IAT", gap, ("Mean", "Std", "Max", "Min")),
        "FIN Flag Cnt": F.count_if(has(FIN)), "SYN Flag Cnt": F.count_if(has(SYN)),
        "RST Flag Cnt": F.count_if(has(RST)), "PSH Flag Cnt": F.count_if(has(PSH)),
        "ACK Flag Cnt": F.count_if(has(ACK)), "URG Flag Cnt": F.count_if(has(URG)),
        "CWE Flag Count": F.count_if(has(CWR)), "ECE Flag Cnt": F.count_if(has(ECE)),
        **_stats("Active", F.when(~idle, gap), ("Mean", "Std", "Max", "Min")),
        **_stats("Idle", F.when(idle, gap), ("Mean", "Std", "Max", "Min")),
    }

    def sided(mine: Column) -> dict[str, Column]:
        pick = lambda c: F.when(mine, c)
        return {
            "Pkts": F.count_if(mine), "Bytes": F.coalesce(F.sum(pick(length)), F.lit(0)),
            **_stats("Pkt Len", pick(length), four),
            **_stats("IAT", pick(secs(F.col("side_gap_us"))), ("Tot", "Mean", "Std", "Max", "Min")),
            "PSH": F.count_if(mine & has(PSH)), "URG": F.count_if(mine & has(URG)),
            "Header": F.coalesce(F.sum(pick(header)), F.lit(0)),
            "Seg Avg": F.coalesce(F.avg(pick(payload)), F.lit(0.0)), "Seg Min": F.min(pick(payload)),
            "Data": F.count_if(mine & (payload > 0)),
            "Win": F.coalesce(F.max(F.when(mine & tcp & side_opens, F.col("tcp_window"))), F.lit(0)),
        }

    lo_side, hi_side = sided(lo), sided(~lo)
    ends = {f"{side}_{what}": F.when(lo == F.lit(side == "lo"), F.col(f"src_{what}")).otherwise(F.col(f"dst_{what}"))
            for side in ("lo", "hi") for what in ("ip", "port")}
    grouped = segmented.withColumns(ends).groupBy("flow_key", "seg", *ends, "proto").agg(
        *[e.alias(n) for n, e in shared.items()],
        F.struct(*[e.alias(n) for n, e in lo_side.items()]).alias("lo"),
        F.struct(*[e.alias(n) for n, e in hi_side.items()]).alias("hi"))
    sides = grouped.withColumns({n: F.when(F.col("lo_first"), F.col(a)).otherwise(F.col(b)) for n, a, b in (
        ("fwd", "lo", "hi"), ("bwd", "hi", "lo"), ("src_ip", "lo_ip", "hi_ip"), ("dst_ip", "hi_ip", "lo_ip"),
        ("src_port", "lo_port", "hi_port"), ("dst_port", "hi_port", "lo_port"))})
    f, b = (lambda n: F.col("fwd")[n]), (lambda n: F.col("bwd")[n])
    took = F.greatest((F.col("t1") - F.col("t0")).cast("double"), F.lit(1.0))
    total = f("Pkts") + b("Pkts")
    rate = lambda c: c / took * F.lit(1e6)
    own = F.col
    out = {
        "Flow ID": F.concat_ws("-", "src_ip", "dst_ip", own("src_port").cast("string"),
                               own("dst_port").cast("string"), own("proto").cast("string")),
        "Source IP": own("src_ip"), "Source Port": own("src_port"),
        "Destination IP": own("dst_ip"), "Dst Port": own("dst_port"), "Protocol": own("proto"),
        "Timestamp": secs(own("t0")), "Flow Duration": took,
        "Tot Fwd Pkts": f("Pkts"), "Tot Bwd Pkts": b("Pkts"),
        "TotLen Fwd Pkts": f("Bytes"), "TotLen Bwd Pkts": b("Bytes"),
        **{f"Fwd Pkt Len {k}": f(f"Pkt Len {k}") for k in four},
        **{f"Bwd Pkt Len {k}": b(f"Pkt Len {k}") for k in four},
        "Flow Byts/s": rate(own("tot_bytes")), "Flow Pkts/s": rate(total),
        **{f"Flow IAT {k}": own(f"Flow IAT {k}") for k in ("Mean", "Std", "Max", "Min")},
        **{f"Fwd IAT {k}": f(f"IAT {k}") for k in ("Tot", "Mean", "Std", "Max", "Min")},
        **{f"Bwd IAT {k}": b(f"IAT {k}") for k in ("Tot", "Mean", "Std", "Max", "Min")},
        "Fwd PSH Flags": f("PSH"), "Bwd PSH Flags": b("PSH"), "Fwd URG Flags": f("URG"), "Bwd URG Flags": b("URG"),
        "Fwd Header Len": f("Header"), "Bwd Header Len": b("Header"),
        "Fwd Pkts/s": rate(f("Pkts")), "Bwd Pkts/s": rate(b("Pkts")),
        **{f"Pkt Len {k}": own(f"Pkt Len {k}") for k in ("Min", "Max", "Mean", "Std", "Var")},
        **{n: own(n) for n in ("FIN Flag Cnt", "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt",
                               "URG Flag Cnt", "CWE Flag Count", "ECE Flag Cnt")},
        "Down/Up Ratio": F.when(f("Pkts") > 0, b("Pkts") / f("Pkts")).otherwise(0.0),
        "Pkt Size Avg": own("tot_bytes") / total,
        "Fwd Seg Size Avg": f("Seg Avg"), "Bwd Seg Size Avg": b("Seg Avg"),
        **{f"{way} {n} Avg": F.lit(0) for way in ("Fwd", "Bwd") for n in ("Byts/b", "Pkts/b", "Blk Rate")},
        "Subflow Fwd Pkts": f("Pkts"), "Subflow Fwd Byts": f("Bytes"),
        "Subflow Bwd Pkts": b("Pkts"), "Subflow Bwd Byts": b("Bytes"),
        "Init Fwd Win Byts": own("first_window"), "Init Bwd Win Byts": b("Win"),
        "Fwd Act Data Pkts": f("Data"), "Fwd Header Length.1": f("Header"), "Fwd Seg Size Min": f("Seg Min"),
        **{f"{n} {k}": own(f"{n} {k}") for n in ("Active", "Idle") for k in ("Mean", "Std", "Max", "Min")},
    }
    return sides.select("flow_key", "seg", *[e.alias(n) for n, e in out.items()])
