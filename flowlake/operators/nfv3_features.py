"""NetFlow-v3 records: one wide row per flow from segmented packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators.l7 import port_app_id

# Upper edges of the packet-size histogram; larger packets are not counted.
SIZE_EDGES = [128, 256, 512, 1024, 1514]
ENDS = ["client_ip", "client_port", "server_ip", "server_port", "proto"]
SIDES = {"SRC_TO_DST": True, "DST_TO_SRC": False}  # prefix of a direction's columns -> whether it is the client's
US = 1_000_000


def _sided(expr: Column, fwd: bool) -> Column:
    return F.when(F.col("fwd") if fwd else ~F.col("fwd"), expr)


def partial_records(segmented: DataFrame, slot_s: int = 10) -> DataFrame:
    """One mergeable record per flow and time slot of ``slot_s`` seconds.

    Sums, extremes and flag unions merge as they are.  For inter-arrival times a slot keeps, per direction, its first and
    last packet's time, and the extremes and squared deviations of the gaps inside; for DNS fields its newest values.  A
    repeated segment is marked in its slot first, and only the first one of each slot is compared across slots.  So no
    window spans more than one flow's slot, or one row per slot, and a flow of any size is spread over tasks.
    """
    order = ["ts_us", "pkt_id"]
    flow = ["flow_key", "flow_id"]
    in_slot = Window.partitionBy(*flow, "slot").orderBy(*order)
    earlier = in_slot.rowsBetween(Window.unboundedPreceding, -1)
    copies = [*flow, "fwd", "tcp_seq", "payload_len"]
    tcp = F.col("proto") == 6
    last_us = lambda fwd: F.last(_sided(F.col("ts_us"), fwd), ignorenulls=True).over(earlier)
    pkts = segmented.withColumn("slot", F.floor(F.col("ts_us") / F.lit(slot_s * US)))
    pkts = pkts.withColumns({"at": F.row_number().over(in_slot), "last_fwd": last_us(True), "last_bwd": last_us(False),
                             "first_here": F.row_number().over(Window.partitionBy(*copies, "slot").orderBy(*order)) == 1})
    # firsts of all slots meet in one group; the others, which are repeats anyway, stay with their slot
    among = Window.partitionBy(*copies, F.when(F.col("first_here"), F.lit(None)).otherwise(F.col("slot"))).orderBy(*order)
    pkts = pkts.withColumns({
        "gap_us": F.col("ts_us") - F.when(F.col("fwd"), F.col("last_fwd")).otherwise(F.col("last_bwd")),
        "again": tcp & (~F.col("first_here") | (F.row_number().over(among) > 1)),
        **{f"{who}_{what}": F.when(F.col("fwd") == F.lit(who == "client"), F.col(f"src_{what}"))
           .otherwise(F.col(f"dst_{what}")) for who in ("client", "server") for what in ("ip", "port")},
    })
    size = F.col("ip_len")
    lows = [-1, *SIZE_EDGES[:-1]]
    query, reply = F.col("dns_qr") == 0, (F.col("dns_qr") == 1) & (F.col("dns_ancount") > 0)
    asked = query & (F.col("dns_qdcount") > 0)
    aggs = {
        "t0": F.min("ts_us"), "t1": F.max("ts_us"),
        "IN_BYTES": F.sum(_sided(size, True)), "IN_PKTS": F.count_if("fwd"),
        "OUT_BYTES": F.sum(_sided(size, False)), "OUT_PKTS": F.count_if(~F.col("fwd")),
        "TCP_FLAGS": F.bit_or("tcp_flags"),
        "CLIENT_TCP_FLAGS": F.bit_or(_sided(F.col("tcp_flags"), True)),
        "SERVER_TCP_FLAGS": F.bit_or(_sided(F.col("tcp_flags"), False)),
        "MIN_TTL": F.min("ttl"), "MAX_TTL": F.max("ttl"),
        "LONGEST_FLOW_PKT": F.max(size), "SHORTEST_FLOW_PKT": F.min(size),
        "RETRANSMITTED_IN_BYTES": F.sum(F.when(F.col("again") & F.col("fwd"), size)),
        "RETRANSMITTED_IN_PKTS": F.count_if(F.col("again") & F.col("fwd")),
        "RETRANSMITTED_OUT_BYTES": F.sum(F.when(F.col("again") & ~F.col("fwd"), size)),
        "RETRANSMITTED_OUT_PKTS": F.count_if(F.col("again") & ~F.col("fwd")),
        **{name: F.count_if((size > lo) & (size <= hi)) for name, lo, hi in zip(fv.SIZE_COLUMNS, lows, SIZE_EDGES)},
        "TCP_WIN_MAX_IN": F.max(_sided(F.col("tcp_window"), True)),
        "TCP_WIN_MAX_OUT": F.max(_sided(F.col("tcp_window"), False)),
    }
    for name, cond, column in (("DNS_QUERY_ID", query, "dns_id"), ("DNS_QUERY_TYPE", asked, "dns_qtype"), ("DNS_TTL_ANSWER", reply, "dns_ttl")):
        aggs |= {name: F.max_by(F.when(cond, F.col(column)), F.when(cond, F.col("at"))), f"{name}_at": F.max(F.when(cond, F.col("slot")))}
    for prefix, fwd in SIDES.items():
        time, gap = _sided(F.col("ts_us"), fwd), _sided(F.col("gap_us"), fwd)
        aggs |= {f"{prefix}_first": F.min(time), f"{prefix}_last": F.max(time), f"{prefix}_least": F.min(gap), f"{prefix}_most": F.max(gap),
                 f"{prefix}_n": F.count(gap), f"{prefix}_m2": F.var_pop(gap) * F.count(gap)}
    return pkts.groupBy(*flow, *ENDS, "slot").agg(*[e.alias(n) for n, e in aggs.items()])


SPAN_FIELDS = ("first", "last", "n", "least", "most", "m2")


def merged_slots(slots: Column) -> Column:
    """One direction's slots, in order of time, as one: a record of the same shape, so that slots merge in steps.

    Between two slots lies one more gap.  All gaps of a slot add up to last minus first, so its mean is known at once, and squared
    deviations follow from those inside both parts and the means' distances.  Each slot is visited once.
    """
    kinds = "struct<first:bigint,last:bigint,n:bigint,least:bigint,most:bigint,m2:double>"
    off = lambda value, mean: (value - mean) * (value - mean)
    inside = lambda x, mean: F.coalesce(x["m2"] + x["n"] * off((x["last"] - x["first"]) / F.nullif(x["n"], F.lit(0)), mean), F.lit(0.0))

    def add(a: Column, x: Column) -> Column:
        gap, n = x["first"] - a["last"], a["n"] + x["n"] + 1
        mean = (x["last"] - a["first"]) / n
        return F.struct(a["first"].alias("first"), x["last"].alias("last"), n.alias("n"),
                        F.least(a["least"], x["least"], gap).alias("least"), F.greatest(a["most"], x["most"], gap).alias("most"),
                        (inside(a, mean) + inside(x, mean) + off(gap, mean)).alias("m2")).cast(kinds)

    head = F.get(slots, F.lit(0)).cast(kinds)
    return F.aggregate(F.slice(slots, 2, F.greatest(F.size(slots), F.lit(1))), head, add)


def gap_figures(span: Column) -> dict[str, Column]:
    """Least, most, mean and deviation (milliseconds) of one direction's gaps, from its merged slots."""
    n = span["n"]
    figures = {"MIN": span["least"], "MAX": span["most"], "AVG": (span["last"] - span["first"]) / n, "STDDEV": F.sqrt(span["m2"] / n)}
    return {name: F.when(n > 0, value / F.lit(1000.0)).otherwise(0.0) for name, value in figures.items()}


def nfv3_record(segmented: DataFrame, slot_s: int = 10) -> DataFrame:
    """All 53 columns of a flow record, plus ``flow_id``: the partial records of the flow's slots, merged.

    Windows and aggregations are keyed by ``flow_key`` first, so on the ordinary segmentation path all of them reuse its
    one shuffle; packets of a hot key come spread over time and stay so.  Merging sees one row per slot of a flow.  DNS
    fields count wherever a packet has a DNS layer (``dns_qr`` is not null): the last query, its type if it has a
    question, the TTL of the last reply with an answer.  ICMP and FTP columns are constant 0: only TCP and UDP packets
    form flows.
    """
    parts = partial_records(segmented, slot_s)
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = ["IN_BYTES", "IN_PKTS", "OUT_BYTES", "OUT_PKTS", "RETRANSMITTED_IN_BYTES", "RETRANSMITTED_IN_PKTS", "RETRANSMITTED_OUT_BYTES",
             "RETRANSMITTED_OUT_PKTS", *fv.SIZE_COLUMNS]
    aggs = {
        **{c: zero(F.sum(c)) for c in total},
        **{c: F.min(c) for c in ("t0", "MIN_TTL", "SHORTEST_FLOW_PKT")}, **{c: F.max(c) for c in ("t1", "MAX_TTL", "LONGEST_FLOW_PKT")},
        **{c: zero(F.max(c)) for c in ("TCP_WIN_MAX_IN", "TCP_WIN_MAX_OUT")},
        **{c: zero(F.bit_or(c)) for c in ("TCP_FLAGS", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS")},
        **{c: zero(F.max_by(c, f"{c}_at")) for c in ("DNS_QUERY_ID", "DNS_QUERY_TYPE", "DNS_TTL_ANSWER")},
    }
    for prefix in SIDES:
        one = F.struct(*[F.col(f"{prefix}_{c}").alias(c) for c in SPAN_FIELDS])
        aggs[f"{prefix}_slots"] = F.array_sort(F.collect_list(F.when(F.col(f"{prefix}_first").isNotNull(), one)))
    flows = parts.groupBy("flow_key", "flow_id", *ENDS).agg(*[e.alias(n) for n, e in aggs.items()])
    flows = flows.withColumns({f"{prefix}_span": merged_slots(F.col(f"{prefix}_slots")) for prefix in SIDES})
    for prefix, column in zip(SIDES, ("DURATION_IN", "DURATION_OUT"), strict=True):
        span = F.col(f"{prefix}_span")
        flows = flows.withColumns({column: F.coalesce(span["last"] - span["first"], F.lit(0)) / F.lit(1000.0),
                                   **{f"{prefix}_IAT_{k}": v for k, v in gap_figures(span).items()}})

    took = F.col("t1") - F.col("t0")
    rate = lambda amount: F.when(took > 0, amount / (took / F.lit(1e6))).otherwise(0.0)
    derived = {
        "FLOW_START_MILLISECONDS": F.floor(F.col("t0") / 1000), "FLOW_END_MILLISECONDS": F.floor(F.col("t1") / 1000),
        "IPV4_SRC_ADDR": F.col("client_ip"), "L4_SRC_PORT": F.col("client_port"),
        "IPV4_DST_ADDR": F.col("server_ip"), "L4_DST_PORT": F.col("server_port"),
        "PROTOCOL": F.col("proto"),
        "L7_PROTO": port_app_id(F.col("server_port"), F.col("client_port"), F.col("proto")),
        "FLOW_DURATION_MILLISECONDS": took / F.lit(1000.0),
        "MIN_IP_PKT_LEN": F.col("SHORTEST_FLOW_PKT"), "MAX_IP_PKT_LEN": F.col("LONGEST_FLOW_PKT"),
        "SRC_TO_DST_SECOND_BYTES": rate(F.col("IN_BYTES")), "DST_TO_SRC_SECOND_BYTES": rate(F.col("OUT_BYTES")),
        "SRC_TO_DST_AVG_THROUGHPUT": rate(F.col("IN_BYTES") * 8),
        "DST_TO_SRC_AVG_THROUGHPUT": rate(F.col("OUT_BYTES") * 8),
        "ICMP_TYPE": F.lit(0), "ICMP_IPV4_TYPE": F.lit(0), "FTP_COMMAND_RET_CODE": F.lit(0),
    }
    return flows.withColumns(derived).select("flow_id", *fv.NFV3_RAW_COLUMNS)
