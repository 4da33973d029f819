"""Queries over packets: keys, segmentation, NetFlow-v3 and CIC records, application ids."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators import cic, flow_keys, l7, nfv3_features, nfv3_segments, sessions
from flowlake.plans.derived import cte, table
from flowlake.plans.registry import query, rounded

PK = cte("packets")
KEYED = """keyed AS (
 SELECT *, CASE WHEN from_lo THEN src_ip || ':' || src_port ELSE dst_ip || ':' || dst_port END || '-' ||
   CASE WHEN from_lo THEN dst_ip || ':' || dst_port ELSE src_ip || ':' || src_port END || '-' || proto AS flow_key,
  row_number() OVER (PARTITION BY least(src_ip || ':' || src_port, dst_ip || ':' || dst_port),
    greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port), proto ORDER BY ts_us, pkt_id) AS rn
 FROM (SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) AS from_lo,
   proto = 6 AND (tcp_flags & 1) <> 0 AS fin, proto = 6 AND (tcp_flags & 4) <> 0 AS rst,
   proto <> 6 OR (tcp_flags & 2) <> 0 AS may_start FROM packets WHERE proto IN (6, 17)) k0)
"""


def nf_segments_sql(may_start: str = "may_start") -> str:
    """Reference: the close rules as a recursive CTE, one packet per step."""
    return PK.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + KEYED + f""",
steps AS (
 SELECT DISTINCT flow_key, CAST(0 AS BIGINT) AS rn, false AS o, CAST(0 AS BIGINT) AS t0, CAST(0 AS BIGINT) AS last_us,
  CAST(0 AS BIGINT) AS id, false AS lo0, false AS fa, false AS fb, CAST(NULL AS BIGINT) AS dl, false AS live FROM keyed
 UNION ALL
 SELECT flow_key, rn, live AND NOT (rst OR ts_us - t0 > 120000000 OR (held IS NOT NULL AND ts_us > held) OR (fa AND fb)),
  t0, ts_us, id, lo0, fa, fb, coalesce(held, CASE WHEN fin THEN ts_us + 5000000 END), live
 FROM (SELECT k.flow_key, k.rn, k.ts_us, k.rst, k.fin, (s.cont OR {may_start}) AS live,
   CASE WHEN s.cont THEN s.t0 ELSE k.ts_us END AS t0, CASE WHEN s.cont THEN s.id ELSE k.pkt_id END AS id,
   CASE WHEN s.cont THEN s.lo0 ELSE k.from_lo END AS lo0, (s.cont AND s.fa) OR (k.fin AND k.from_lo) AS fa,
   (s.cont AND s.fb) OR (k.fin AND NOT k.from_lo) AS fb, CASE WHEN s.cont THEN s.dl END AS held
  FROM (SELECT p.*, n.ts_us AS now_us, p.o AND n.ts_us - p.last_us <= 15000000 AS cont, n.rn AS n_rn
        FROM steps p JOIN keyed n ON n.flow_key = p.flow_key AND n.rn = p.rn + 1) s
  JOIN keyed k ON k.flow_key = s.flow_key AND k.rn = s.n_rn) x),
seg AS (SELECT k.*, s.id AS flow_id, k.from_lo = s.lo0 AS fwd FROM steps s
 JOIN keyed k ON k.flow_key = s.flow_key AND k.rn = s.rn WHERE s.live)
"""


NF_SEG = nf_segments_sql()
NF_REC = NF_SEG + """,
marked AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY flow_id, fwd ORDER BY ts_us, pkt_id)) / 1000.0::DOUBLE AS iat,
  proto = 6 AND row_number() OVER (PARTITION BY flow_id, fwd, tcp_seq, payload_len ORDER BY ts_us, pkt_id) > 1 AS again,
  coalesce(dns_qr = 0, false) AS dq, coalesce(dns_qr = 0 AND dns_qdcount > 0, false) AS dt, coalesce(dns_qr = 1 AND dns_ancount > 0, false) AS dr
 FROM seg),
rec AS (SELECT flow_id, min(ts_us) AS t0, max(ts_us) AS t1,
  arg_min(src_ip, rn) AS src_ip, arg_min(src_port, rn) AS src_port, arg_min(dst_ip, rn) AS dst_ip,
  arg_min(dst_port, rn) AS dst_port, min(proto) AS proto,
  coalesce(sum(ip_len) FILTER (fwd), 0)::BIGINT AS in_bytes, count(*) FILTER (fwd) AS in_pkts,
  coalesce(sum(ip_len) FILTER (NOT fwd), 0)::BIGINT AS out_bytes, count(*) FILTER (NOT fwd) AS out_pkts,
  bit_or(tcp_flags) AS flags, coalesce(bit_or(tcp_flags) FILTER (fwd), 0) AS cflags,
  coalesce(bit_or(tcp_flags) FILTER (NOT fwd), 0) AS sflags,
  CASE WHEN count(*) FILTER (fwd) > 1 THEN (max(ts_us) FILTER (fwd) - min(ts_us) FILTER (fwd)) / 1000.0::DOUBLE ELSE 0 END AS din,
  CASE WHEN count(*) FILTER (NOT fwd) > 1 THEN (max(ts_us) FILTER (NOT fwd) - min(ts_us) FILTER (NOT fwd)) / 1000.0::DOUBLE ELSE 0 END AS dout,
  min(ttl) AS min_ttl, max(ttl) AS max_ttl, max(ip_len) AS longest, min(ip_len) AS shortest,
  coalesce(sum(ip_len) FILTER (again AND fwd), 0)::BIGINT AS rib, count(*) FILTER (again AND fwd) AS rip,
  coalesce(sum(ip_len) FILTER (again AND NOT fwd), 0)::BIGINT AS rob, count(*) FILTER (again AND NOT fwd) AS rop,
  count(*) FILTER (ip_len <= 128) AS n128, count(*) FILTER (ip_len > 128 AND ip_len <= 256) AS n256,
  count(*) FILTER (ip_len > 256 AND ip_len <= 512) AS n512, count(*) FILTER (ip_len > 512 AND ip_len <= 1024) AS n1024,
  count(*) FILTER (ip_len > 1024 AND ip_len <= 1514) AS n1514,
  coalesce(max(tcp_window) FILTER (fwd), 0) AS win_in, coalesce(max(tcp_window) FILTER (NOT fwd), 0) AS win_out,
  coalesce(arg_max(dns_id, rn) FILTER (dq), 0) AS dns_id, coalesce(arg_max(dns_qtype, rn) FILTER (dt), 0) AS dns_qtype,
  coalesce(arg_max(dns_ttl, rn) FILTER (dr), 0) AS dns_ttl,
  coalesce(min(iat) FILTER (fwd), 0) AS fmin, coalesce(max(iat) FILTER (fwd), 0) AS fmax,
  coalesce(avg(iat) FILTER (fwd), 0) AS favg, coalesce(stddev_pop(iat) FILTER (fwd), 0) AS fstd,
  coalesce(min(iat) FILTER (NOT fwd), 0) AS bmin, coalesce(max(iat) FILTER (NOT fwd), 0) AS bmax,
  coalesce(avg(iat) FILTER (NOT fwd), 0) AS bavg, coalesce(stddev_pop(iat) FILTER (NOT fwd), 0) AS bstd
 FROM marked GROUP BY flow_id)
"""


def _case_map(table_: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(
        f"WHEN {k!r} THEN {v}" for k, v in table_.items()) + " END"


def _guess_sql(dst: str, src: str, proto: str) -> str:
    return (f"coalesce({_case_map(fv.PORT_APP_ID, dst)}, {_case_map(fv.PORT_APP_ID, src)}, "
            f"{_case_map(fv.PROTO_APP_ID, proto)}, 0)")


_RATE = "round(CASE WHEN t1 > t0 THEN {0} / ((t1 - t0) / 1000000.0::DOUBLE) ELSE 0 END, 4)"
NF_COLUMN_SQL = {
    "FLOW_START_MILLISECONDS": "t0 // 1000", "FLOW_END_MILLISECONDS": "t1 // 1000", "IPV4_SRC_ADDR": "src_ip",
    "L4_SRC_PORT": "src_port", "IPV4_DST_ADDR": "dst_ip", "L4_DST_PORT": "dst_port", "PROTOCOL": "proto",
    "L7_PROTO": _guess_sql("dst_port", "src_port", "proto"), "IN_BYTES": "in_bytes", "IN_PKTS": "in_pkts",
    "OUT_BYTES": "out_bytes", "OUT_PKTS": "out_pkts", "TCP_FLAGS": "flags", "CLIENT_TCP_FLAGS": "cflags",
    "SERVER_TCP_FLAGS": "sflags", "FLOW_DURATION_MILLISECONDS": "round((t1 - t0) / 1000.0::DOUBLE, 4)",
    "DURATION_IN": "round(din, 4)", "DURATION_OUT": "round(dout, 4)", "MIN_TTL": "min_ttl", "MAX_TTL": "max_ttl",
    "LONGEST_FLOW_PKT": "longest", "SHORTEST_FLOW_PKT": "shortest", "MIN_IP_PKT_LEN": "shortest",
    "MAX_IP_PKT_LEN": "longest", "SRC_TO_DST_SECOND_BYTES": _RATE.format("in_bytes"),
    "DST_TO_SRC_SECOND_BYTES": _RATE.format("out_bytes"), "SRC_TO_DST_AVG_THROUGHPUT": _RATE.format("in_bytes * 8"),
    "DST_TO_SRC_AVG_THROUGHPUT": _RATE.format("out_bytes * 8"), "RETRANSMITTED_IN_BYTES": "rib",
    "RETRANSMITTED_IN_PKTS": "rip", "RETRANSMITTED_OUT_BYTES": "rob", "RETRANSMITTED_OUT_PKTS": "rop",
    "NUM_PKTS_UP_TO_128_BYTES": "n128", "NUM_PKTS_128_TO_256_BYTES": "n256", "NUM_PKTS_256_TO_512_BYTES": "n512",
    "NUM_PKTS_512_TO_1024_BYTES": "n1024", "NUM_PKTS_1024_TO_1514_BYTES": "n1514", "TCP_WIN_MAX_IN": "win_in",
    "TCP_WIN_MAX_OUT": "win_out", "ICMP_TYPE": "0", "ICMP_IPV4_TYPE": "0", "DNS_QUERY_ID": "dns_id",
    "DNS_QUERY_TYPE": "dns_qtype", "DNS_TTL_ANSWER": "dns_ttl", "FTP_COMMAND_RET_CODE": "0",
    "SRC_TO_DST_IAT_MIN": "round(fmin, 4)", "SRC_TO_DST_IAT_MAX": "round(fmax, 4)",
    "SRC_TO_DST_IAT_AVG": "round(favg, 4)", "SRC_TO_DST_IAT_STDDEV": "round(fstd, 4)",
    "DST_TO_SRC_IAT_MIN": "round(bmin, 4)", "DST_TO_SRC_IAT_MAX": "round(bmax, 4)",
    "DST_TO_SRC_IAT_AVG": "round(bavg, 4)", "DST_TO_SRC_IAT_STDDEV": "round(bstd, 4)",
}
NF_VIEWS = {
    "nfv3_volume": fv.VOLUME_COLUMNS + fv.TTL_COLUMNS + fv.LENGTH_COLUMNS,
    "nfv3_flags": fv.FLAG_COLUMNS + fv.WINDOW_COLUMNS,
    "nfv3_timing": fv.TIMESTAMP_COLUMNS + fv.IDENTITY_COLUMNS + ["PROTOCOL"] + fv.TIMING_COLUMNS,
    "nfv3_throughput": fv.RATE_COLUMNS,
    "nfv3_retransmissions": fv.RETRANSMIT_COLUMNS,
    "nfv3_size_histogram": fv.SIZE_COLUMNS,
    "nfv3_l7_fields": fv.ICMP_COLUMNS + fv.DNS_COLUMNS + fv.FTP_COLUMNS,
    "nfv3_iat": fv.IAT_COLUMNS,
    "nfv3_flows": fv.NFV3_RAW_COLUMNS,
}


def nf_columns_sql(columns: list[str]) -> str:
    return NF_REC + "SELECT flow_id, " + ", ".join(f"{NF_COLUMN_SQL[c]} AS {c}" for c in columns) + " FROM rec"


def _add_nf_view(name: str, columns: list[str]) -> None:
    @query(name, nf_columns_sql(columns))
    def run(spark, sf):
        flows = nfv3_features.nfv3_record(nfv3_segments.segment_flows(table(spark, sf, "packets")))
        return rounded(flows.select("flow_id", *columns), 4)


for _name, _columns in NF_VIEWS.items():
    _add_nf_view(_name, _columns)


# All but one packet of a hundred belong to one UDP conversation, and no rule closes it: one flow holds 99 % of all packets.
ONE_FLOW_COLUMNS = {"src_ip": ("'10.9.9.9'", "'10.8.8.8'"), "dst_ip": ("'10.8.8.8'", "'10.9.9.9'"), "src_port": ("5000", "6000"), "dst_port": ("6000", "5000")}


def one_flow_sql() -> str:
    """Packets where every row but one in a hundred goes to one conversation, both ways."""
    hot = "pkt_id % 100 <> 0"
    cols = [f"CAST(CASE WHEN {hot} AND pkt_id % 3 > 0 THEN {there} WHEN {hot} THEN {back} ELSE {c} END AS {'VARCHAR(20)' if 'ip' in c else 'BIGINT'}) AS {c}"
            for c, (there, back) in ONE_FLOW_COLUMNS.items()]
    rest = [c for c in ("pkt_id", "ts_us", "ip_len", "frame_len", "ttl", "ip_ihl", "tcp_flags", "tcp_window", "tcp_seq", "tcp_dataofs",
                        "payload_len", "dns_qr", "dns_id", "dns_qdcount", "dns_qtype", "dns_ancount", "dns_ttl")]
    return f"SELECT {', '.join(rest)}, {', '.join(cols)}, CASE WHEN {hot} THEN 17 ELSE proto END AS proto FROM all_packets"


HOT_REC = (PK.replace("packets AS (", "all_packets AS (", 1).rstrip() + f",\npackets AS ({one_flow_sql()}), " + KEYED + """,
seg AS (SELECT *, first_value(pkt_id) OVER w AS flow_id, first_value(from_lo) OVER w = from_lo AS fwd FROM keyed WHERE proto = 17
 WINDOW w AS (PARTITION BY flow_key ORDER BY ts_us, pkt_id))""" + NF_REC[len(NF_SEG):]
           + "SELECT flow_id, " + ", ".join(f"{NF_COLUMN_SQL[c]} AS {c}" for c in fv.NFV3_RAW_COLUMNS) + " FROM rec")


@query("nfv3_flows_one_hot", HOT_REC)
def nfv3_flows_one_hot(spark, sf):
    """UDP records where one flow has 99 % of the packets; both its key and the flow itself take the spread way."""
    packets = spark.sql(one_flow_sql().replace("all_packets", "{packets}"), packets=table(spark, sf, "packets"))
    forever = nfv3_segments.CloseRules(active_s=1 << 31, inactive_s=1 << 31)
    seg = nfv3_segments.segment_flows(packets.where("proto = 17"), forever, hot_rows=1000)
    return rounded(nfv3_features.nfv3_record(seg).select("flow_id", *fv.NFV3_RAW_COLUMNS), 4)


@query("packets_infra_filter", PK + """SELECT pkt_id, src_ip, src_port, dst_ip, dst_port, proto FROM packets
WHERE src_port NOT IN (6379, 5432, 8000) AND dst_port NOT IN (6379, 5432, 8000)""")
def packets_infra_filter(spark, sf):
    return flow_keys.drop_infra_ports(table(spark, sf, "packets")).select(
        "pkt_id", "src_ip", "src_port", "dst_ip", "dst_port", "proto")


@query("flow_keys", PK + ", " + KEYED + "SELECT pkt_id, flow_key, from_lo FROM keyed")
def flow_keys_query(spark, sf):
    return flow_keys.flow_keys(table(spark, sf, "packets")).select("pkt_id", "flow_key", "from_lo")


@query("nfv3_segments", NF_SEG + "SELECT pkt_id, flow_key, flow_id, fwd FROM seg")
def nfv3_segments_query(spark, sf):
    return nfv3_segments.segment_flows(table(spark, sf, "packets")).select("pkt_id", "flow_key", "flow_id", "fwd")


@query("nfv3_segments_gap", PK + ", " + KEYED + """, c AS (SELECT *, CASE WHEN p IS NULL OR ts_us - p > 15000000 OR pr
 THEN 1 ELSE 0 END AS cut FROM (SELECT *, lag(ts_us) OVER w AS p, lag(rst) OVER w AS pr FROM keyed
 WINDOW w AS (PARTITION BY flow_key ORDER BY ts_us, pkt_id)) q)
SELECT pkt_id, flow_key, CAST(sum(cut) OVER (PARTITION BY flow_key ORDER BY ts_us, pkt_id) AS BIGINT) AS piece FROM c""")
def nfv3_segments_gap(spark, sf):
    marked = nfv3_segments.mark_flags(flow_keys.flow_keys(table(spark, sf, "packets")), nfv3_segments.CloseRules())
    return nfv3_segments.gap_pieces(marked).select("pkt_id", "flow_key", "piece")


@query("nfv3_syn_gate", NF_SEG + """, gated AS (SELECT k.proto, count(*) AS eligible,
  count(s.pkt_id) AS kept FROM keyed k LEFT JOIN seg s ON s.pkt_id = k.pkt_id GROUP BY k.proto)
SELECT proto, eligible, kept, eligible - kept AS dropped FROM gated""")
def nfv3_syn_gate(spark, sf):
    packets = table(spark, sf, "packets")
    kept = nfv3_segments.segment_flows(packets).groupBy("proto").agg(F.count("*").alias("kept"))
    all_ = flow_keys.flow_keys(packets).groupBy("proto").agg(F.count("*").alias("eligible"))
    return all_.join(kept, "proto", "left").select(
        "proto", "eligible", F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.col("eligible") - F.coalesce("kept", F.lit(0))).alias("dropped"))


CIC_SEG = PK + ", " + KEYED + """, c AS (SELECT *, CASE WHEN p IS NULL OR ts_us - p > 120000000 OR pe THEN 1 ELSE 0 END AS cut,
 ts_us - p AS gap FROM (SELECT *, lag(ts_us) OVER w AS p, lag(fin OR rst) OVER w AS pe FROM keyed
 WINDOW w AS (PARTITION BY flow_key ORDER BY ts_us, pkt_id)) q),
seg0 AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY flow_key ORDER BY ts_us, pkt_id) AS BIGINT) AS seg FROM c),
seg1 AS (SELECT *, first_value(from_lo) OVER (PARTITION BY flow_key, seg ORDER BY ts_us, pkt_id) = from_lo AS fwd,
  CASE WHEN cut = 0 THEN gap END AS g FROM seg0),
seg AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow_key, seg, fwd ORDER BY ts_us, pkt_id) AS sg,
  ip_ihl * 4 + CASE WHEN proto = 6 THEN tcp_dataofs * 4 ELSE 8 END AS hdr FROM seg1)
"""


def _stat_sql(expr: str, cond: str, kind: str) -> str:
    fn = {"Max": "max", "Min": "min", "Mean": "avg", "Std": "stddev_pop", "Var": "var_pop", "Tot": "sum"}[kind]
    where = f" FILTER ({cond})" if cond else ""
    return f"round(coalesce({fn}({expr}){where}, 0)::DOUBLE, 4)"


def _cic_sql() -> dict[str, str]:
    took = "greatest((max(ts_us) - min(ts_us))::DOUBLE, 1.0)"
    cols = {
        "Flow ID": "arg_min(src_ip || '-' || dst_ip || '-' || src_port || '-' || dst_port || '-' || proto, rn)",
        "Source IP": "arg_min(src_ip, rn)", "Source Port": "arg_min(src_port, rn)",
        "Destination IP": "arg_min(dst_ip, rn)", "Dst Port": "arg_min(dst_port, rn)", "Protocol": "min(proto)",
        "Timestamp": "round(min(ts_us) / 1000000.0::DOUBLE, 4)", "Flow Duration": took,
        "Tot Fwd Pkts": "count(*) FILTER (fwd)", "Tot Bwd Pkts": "count(*) FILTER (NOT fwd)",
        "TotLen Fwd Pkts": "coalesce(sum(frame_len) FILTER (fwd), 0)::BIGINT",
        "TotLen Bwd Pkts": "coalesce(sum(frame_len) FILTER (NOT fwd), 0)::BIGINT",
        "Flow Byts/s": f"round(sum(frame_len) / {took} * 1e6::DOUBLE, 4)",
        "Flow Pkts/s": f"round(count(*) / {took} * 1e6::DOUBLE, 4)",
        "Fwd Pkts/s": f"round(count(*) FILTER (fwd) / {took} * 1e6::DOUBLE, 4)",
        "Bwd Pkts/s": f"round(count(*) FILTER (NOT fwd) / {took} * 1e6::DOUBLE, 4)",
        "Down/Up Ratio": "round(count(*) FILTER (NOT fwd) / count(*) FILTER (fwd), 4)",
        "Pkt Size Avg": "round(sum(frame_len) / count(*), 4)",
        "Init Fwd Win Byts": "arg_min(tcp_window, rn)",
        "Init Bwd Win Byts": "coalesce(arg_min(tcp_window, rn) FILTER (NOT fwd AND proto = 6), 0)",
        "Fwd Act Data Pkts": "count(*) FILTER (fwd AND frame_len > hdr)",
        "Fwd Seg Size Min": "min(greatest(0, frame_len - hdr)) FILTER (fwd)",
        "Fwd Header Length.1": "coalesce(sum(hdr) FILTER (fwd), 0)::BIGINT",
    }
    for k in ("Min", "Max", "Mean", "Std", "Var"):
        cols[f"Pkt Len {k}"] = _stat_sql("frame_len", "", k)
    for k in ("Mean", "Std", "Max", "Min"):
        cols[f"Flow IAT {k}"] = _stat_sql("g / 1e6::DOUBLE", "", k)
        cols[f"Active {k}"] = _stat_sql("g / 1e6::DOUBLE", "g <= 5000000", k)
        cols[f"Idle {k}"] = _stat_sql("g / 1e6::DOUBLE", "g > 5000000", k)
    for way, cond in (("Fwd", "fwd"), ("Bwd", "NOT fwd")):
        for k in ("Max", "Min", "Mean", "Std"):
            cols[f"{way} Pkt Len {k}"] = _stat_sql("frame_len", cond, k)
        for k in ("Tot", "Mean", "Std", "Max", "Min"):
            cols[f"{way} IAT {k}"] = _stat_sql("sg / 1e6::DOUBLE", cond, k)
        cols[f"{way} PSH Flags"] = f"count(*) FILTER ({cond} AND proto = 6 AND (tcp_flags & 8) <> 0)"
        cols[f"{way} URG Flags"] = f"count(*) FILTER ({cond} AND proto = 6 AND (tcp_flags & 32) <> 0)"
        cols[f"{way} Header Len"] = f"coalesce(sum(hdr) FILTER ({cond}), 0)::BIGINT"
        cols[f"{way} Seg Size Avg"] = _stat_sql("greatest(0, frame_len - hdr)", cond, "Mean")
        cols[f"Subflow {way} Pkts"] = cols[f"Tot {way} Pkts"]
        cols[f"Subflow {way} Byts"] = cols[f"TotLen {way} Pkts"]
        for n in ("Byts/b", "Pkts/b", "Blk Rate"):
            cols[f"{way} {n} Avg"] = "0"
    for bit, n in enumerate(("FIN Flag Cnt", "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt",
                             "URG Flag Cnt", "ECE Flag Cnt", "CWE Flag Count")):
        cols[n] = f"count(*) FILTER (proto = 6 AND (tcp_flags & {1 << bit}) <> 0)"
    return cols


CIC_COLUMN_SQL = _cic_sql()
CIC_VIEWS = {
    "cic_basic": ["Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts",
                  "Flow Byts/s", "Flow Pkts/s", "Fwd Pkts/s", "Bwd Pkts/s"],
    "cic_pkt_len": [f"{w} Pkt Len {k}" for w in ("Fwd", "Bwd") for k in ("Max", "Min", "Mean", "Std")]
    + [f"Pkt Len {k}" for k in ("Min", "Max", "Mean", "Std", "Var")],
    "cic_iat": [f"Flow IAT {k}" for k in ("Mean", "Std", "Max", "Min")]
    + [f"{w} IAT {k}" for w in ("Fwd", "Bwd") for k in ("Tot", "Mean", "Std", "Max", "Min")],
    "cic_flags": ["FIN Flag Cnt", "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt", "URG Flag Cnt",
                  "CWE Flag Count", "ECE Flag Cnt", "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags",
                  "Bwd URG Flags"],
    "cic_headers": ["Fwd Header Len", "Bwd Header Len", "Fwd Header Length.1", "Down/Up Ratio", "Pkt Size Avg",
                    "Fwd Seg Size Avg", "Bwd Seg Size Avg", "Fwd Seg Size Min", "Fwd Act Data Pkts"],
    "cic_init_win": ["Init Fwd Win Byts", "Init Bwd Win Byts"],
    "cic_active_idle": [f"{n} {k}" for n in ("Active", "Idle") for k in ("Mean", "Std", "Max", "Min")],
    "cic_flows": list(CIC_COLUMN_SQL),
}


def snake(name: str) -> str:
    """Plain column name for a result set: ``Flow Byts/s`` -> ``flow_byts_s``."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def _add_cic_view(name: str, columns: list[str]) -> None:
    sql = (CIC_SEG + "SELECT flow_key, seg, " + ", ".join(f"{CIC_COLUMN_SQL[c]} AS {snake(c)}" for c in columns)
           + " FROM seg GROUP BY flow_key, seg")

    @query(name, sql)
    def run(spark, sf):
        flows = cic.cic_record(cic.cic_segments(table(spark, sf, "packets")))
        return rounded(flows.select("flow_key", "seg", *[F.col(f"`{c}`").alias(snake(c)) for c in columns]), 4)


for _name, _columns in CIC_VIEWS.items():
    _add_cic_view(_name, _columns)


@query("cic_segments", CIC_SEG + "SELECT pkt_id, flow_key, seg, coalesce(g, -1) AS gap_us, coalesce(sg, -1) AS side_gap_us FROM seg")
def cic_segments_query(spark, sf):
    return cic.cic_segments(table(spark, sf, "packets")).select(
        "pkt_id", "flow_key", "seg", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("gap_us", "side_gap_us")])


@query("l7_port_guess", PK + f"SELECT pkt_id, {_guess_sql('dst_port', 'src_port', 'proto')} AS app_id FROM packets")
def l7_port_guess(spark, sf):
    return table(spark, sf, "packets").select(
        "pkt_id", l7.port_app_id(F.col("dst_port"), F.col("src_port"), F.col("proto")).alias("app_id"))


APP_CACHE = f"""app_ids AS (SELECT *, coalesce({_case_map(fv.APP_NAME_ID, "split_part(app_name, '.', 1)")}, 0) AS app_id FROM app_flows),
cache AS (SELECT src_ip, src_port, dst_ip, dst_port, proto,
  arg_max(app_id, ts_us::HUGEINT * 1000000000 + flow_no) AS app_id, max(ts_us) AS seen_us
 FROM app_ids WHERE NOT (app_id = 0 AND is_guessed) GROUP BY ALL)
"""


@query("l7_app_cache", cte("app_flows") + ", " + APP_CACHE + "SELECT * FROM cache")
def l7_app_cache(spark, sf):
    return l7.app_cache(table(spark, sf, "app_flows"))


def flow_ends(packets):
    """Identity and end of each flow, from the segmentation alone."""
    seg = nfv3_segments.segment_flows(packets)
    first = lambda c: F.max(F.when(F.col("pkt_id") == F.col("flow_id"), F.col(c))).alias(c)
    ends = seg.groupBy("flow_key", "flow_id").agg(*[first(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "proto")],
                                                  (F.floor(F.max("ts_us") / 1000) * 1000).alias("end_us"))
    return ends.drop("flow_key")


@query("l7_resolved", nf_segments_sql() + ", " + "app_flows AS (" + cte("app_flows").split("app_flows AS (", 1)[1].rstrip()
       + ", " + APP_CACHE + """, fl AS (SELECT flow_id, arg_min(src_ip, rn) AS src_ip, arg_min(src_port, rn) AS src_port,
 arg_min(dst_ip, rn) AS dst_ip, arg_min(dst_port, rn) AS dst_port, min(proto) AS proto, max(ts_us) // 1000 * 1000 AS end_us FROM seg GROUP BY flow_id),
near AS (SELECT f.flow_id, a.app_id, a.ts_us::HUGEINT * 1000000000 + a.flow_no AS moment, a.src_ip = f.src_ip AND a.src_port = f.src_port AS own
 FROM fl f JOIN app_ids a ON a.proto = f.proto AND NOT (a.app_id = 0 AND a.is_guessed) AND a.ts_us BETWEEN f.end_us - 600000000 AND f.end_us
  AND ((a.src_ip = f.src_ip AND a.src_port = f.src_port AND a.dst_ip = f.dst_ip AND a.dst_port = f.dst_port)
    OR (a.src_ip = f.dst_ip AND a.src_port = f.dst_port AND a.dst_ip = f.src_ip AND a.dst_port = f.src_port))),
best AS (SELECT flow_id, coalesce(arg_max(app_id, moment) FILTER (own), arg_max(app_id, moment) FILTER (NOT own)) AS cached_app FROM near GROUP BY flow_id),
res AS (SELECT f.*, cached_app FROM fl f LEFT JOIN best USING (flow_id))
""" + f"SELECT flow_id, coalesce(cached_app, -1) AS cached_app, coalesce(nullif(cached_app, 0), {_guess_sql('dst_port', 'src_port', 'proto')}) AS l7_proto FROM res")
def l7_resolved(spark, sf):
    return l7.resolve_apps(flow_ends(table(spark, sf, "packets")), table(spark, sf, "app_flows")).select(
        "flow_id", F.coalesce("cached_app", F.lit(-1)).alias("cached_app"), "l7_proto")


@query("flow_session_window", PK + ", " + KEYED + """, c AS (SELECT *, CASE WHEN p IS NULL OR ts_us - p > 15000000 THEN 1 ELSE 0 END AS cut
 FROM (SELECT *, lag(ts_us) OVER (PARTITION BY flow_key ORDER BY ts_us, pkt_id) AS p FROM keyed) q),
s AS (SELECT *, sum(cut) OVER (PARTITION BY flow_key ORDER BY ts_us, pkt_id) AS n FROM c)
SELECT flow_key, min(ts_us) AS start_us, max(ts_us) + 15000000 AS end_us, count(*) AS pkts, CAST(sum(ip_len) AS BIGINT) AS bytes
FROM s GROUP BY flow_key, n""")
def flow_session_window(spark, sf):
    return sessions.idle_sessions(table(spark, sf, "packets"))
