"""NetFlow-v3 flow segmentation: split each bidirectional key's packets into flows.

Rules per key, in (ts_us, pkt_id) order:

* a packet more than ``inactive_s`` after the previous packet never continues a flow;
* when no flow is open, a non-TCP packet or a TCP packet with SYN starts one (``require_syn``); its sender is the
  forward side.  Other TCP packets are dropped;
* the packet is included, and then the flow closes on RST, on age above ``active_s``, on a packet later than the
  FIN deadline held before it (first FIN + ``fin_grace_s``), or when both sides have sent FIN.

Timeouts are judged per key: traffic of other keys never changes a flow.

Two ways give the same flows.  Keys of ordinary size take one shuffle by key: cut at gaps and after RST with ``lag``
(after either, nothing is open), then fold each piece with ``aggregate``.  A key above ``hot_rows`` packets would
overload its task, so hot keys are spread over time slots: each packet that could start a flow gets a pointer to the
next possible start, and pointer doubling finds the starts really reached, in log2(flows) rounds of equi joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators.flow_keys import FIN, RST, SYN, flow_keys, hot_keys
from flowlake.operators.ordered import nearest_mark, previous_row, row_numbers
from flowlake.session import settle

US = 1_000_000
NEVER = (1 << 63) - 1


@dataclass(frozen=True)
class CloseRules:
    active_s: int = fv.ACTIVE_TIMEOUT_S
    inactive_s: int = fv.INACTIVE_TIMEOUT_S
    fin_grace_s: int = fv.FIN_GRACE_S
    require_syn: bool = True


def mark_flags(keyed: DataFrame, rules: CloseRules) -> DataFrame:
    tcp = F.col("proto") == 6
    bit = lambda mask: tcp & (F.col("tcp_flags").bitwiseAND(F.lit(mask)) != 0)
    may_start = (~tcp | bit(SYN)) if rules.require_syn else F.lit(True)
    return keyed.withColumns({"fin": bit(FIN), "rst": bit(RST), "may_start": may_start})


def gap_pieces(keyed: DataFrame, inactive_s: int = fv.INACTIVE_TIMEOUT_S) -> DataFrame:
    """Number the pieces of each key: a new one after a gap above ``inactive_s`` and after an RST."""
    w = Window.partitionBy("flow_key").orderBy("ts_us", "pkt_id")
    near = keyed.withColumns({"prev_us": F.lag("ts_us").over(w), "prev_rst": F.lag("rst").over(w)})
    cut = F.col("prev_us").isNull() | (F.col("ts_us") - F.col("prev_us") > inactive_s * US) | F.col("prev_rst")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return near.withColumn("piece", F.sum(cut.cast("long")).over(upto)).drop("prev_us", "prev_rst")


def segment_flows(packets: DataFrame, rules: CloseRules = CloseRules(), hot_rows: int = 200_000) -> DataFrame:
    """Packets that belong to a flow, with ``flow_key``, ``flow_id`` (first packet's id), ``fwd`` (direction)."""
    marked = mark_flags(flow_keys(packets), rules)
    hot = hot_keys(marked, hot_rows)
    if hot is None:
        found = _fold(marked, rules)
    else:
        hot = settle(hot, "hot-keys")
        found = _fold(marked.join(hot, "flow_key", "left_anti"), rules).unionByName(
            _chain(marked.join(hot, "flow_key", "left_semi"), rules))
    return found.drop("fin", "rst", "may_start")


def _fold(marked: DataFrame, rules: CloseRules) -> DataFrame:
    pieces = gap_pieces(marked, rules.inactive_s)
    cols = [c for c in pieces.columns if c not in ("flow_key", "piece")]
    rows = F.array_sort(F.collect_list(F.struct("ts_us", "pkt_id", *[c for c in cols if c not in ("ts_us", "pkt_id")])))
    grouped = pieces.groupBy("flow_key", "piece").agg(rows.alias("pkts"))

    start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("open"), F.lit(0).alias("first"),
                     F.lit(0).cast("long").alias("t0"), F.lit(False).alias("fin_lo"), F.lit(False).alias("fin_hi"),
                     F.lit(NEVER).alias("deadline"), F.array().cast("array<struct<a:int,b:int>>").alias("flows"))

    def step(s: Column, p: Column) -> Column:
        live = s["open"] | p["may_start"]
        t0 = F.when(s["open"], s["t0"]).otherwise(p["ts_us"])
        first = F.when(s["open"], s["first"]).otherwise(s["i"])
        fin_lo = (s["open"] & s["fin_lo"]) | (p["fin"] & p["from_lo"])
        fin_hi = (s["open"] & s["fin_hi"]) | (p["fin"] & ~p["from_lo"])
        held = F.when(s["open"], s["deadline"]).otherwise(F.lit(NEVER))
        closes = (p["rst"] | (p["ts_us"] - t0 > rules.active_s * US) | (p["ts_us"] > held) | (fin_lo & fin_hi))
        deadline = F.when((held == NEVER) & p["fin"], p["ts_us"] + rules.fin_grace_s * US).otherwise(held)
        done = F.when(live & closes, F.array_append(s["flows"], F.struct(first.alias("a"), s["i"].alias("b"))))
        return F.struct((s["i"] + 1).alias("i"), (live & ~closes).alias("open"), first.alias("first"),
                        t0.alias("t0"), fin_lo.alias("fin_lo"), fin_hi.alias("fin_hi"),
                        deadline.alias("deadline"), done.otherwise(s["flows"]).alias("flows"))

    def finish(s: Column) -> Column:
        last = F.array_append(s["flows"], F.struct(s["first"].alias("a"), (s["i"] - 1).alias("b")))
        return F.when(s["open"], last).otherwise(s["flows"])

    flows = grouped.select("flow_key", "pkts", F.explode(F.aggregate("pkts", start, step, finish)).alias("f"))
    return (flows.select("flow_key", F.slice("pkts", F.col("f.a") + 1, F.col("f.b") - F.col("f.a") + 1).alias("pkts"))
            .select("flow_key", F.col("pkts")[0]["pkt_id"].alias("flow_id"), F.col("pkts")[0]["from_lo"].alias("lo0"),
                    F.explode("pkts").alias("p"))
            .select("flow_key", "flow_id", *[F.col(f"p.{c}").alias(c) for c in cols],
                    (F.col("p.from_lo") == F.col("lo0")).alias("fwd")))


def _chain(marked: DataFrame, rules: CloseRules, slot_s: int = 300) -> DataFrame:
    slot = lambda t: F.floor(t / F.lit(slot_s * US)).cast("long")
    by = ["flow_key"]
    rows = row_numbers(marked.withColumn("slot", slot(F.col("ts_us"))), by, "slot", ["ts_us", "pkt_id"], "pos")
    rows = settle(previous_row(rows, by, ["ts_us", "pkt_id"], ["ts_us"], "prev", "slot"), "hot-packets")

    # nearest close signal and nearest possible start, at or after each packet
    gap = F.col("ts_us") - F.col("prev.ts_us") > rules.inactive_s * US
    at = F.struct("pos", "ts_us")
    skeleton = nearest_mark(
        rows.select("flow_key", "slot", "pos", "pkt_id", "ts_us", "from_lo", "fin", "rst", "may_start", "prev"),
        by, "slot", ["pos"],
        {"next_rst": F.when(F.col("rst"), F.col("pos")), "next_gap": F.when(gap, F.col("pos")),
         "next_start": F.when(F.col("may_start"), F.col("pos")),
         "fin_lo": F.when(F.col("fin") & F.col("from_lo"), at),
         "fin_hi": F.when(F.col("fin") & ~F.col("from_lo"), at)},
        ahead=True, strict=("next_gap",))
    skeleton = settle(skeleton.drop("prev", "fin", "rst"), "hot-skeleton")
    starts = skeleton.filter("may_start").withColumn("fin0", F.least("fin_lo", "fin_hi"))

    # first packet later than start + active, and later than first FIN + grace
    limits = starts.select("flow_key", "pos", F.explode(F.array(
        F.struct(F.lit("active").alias("kind"), (F.col("ts_us") + rules.active_s * US).alias("t")),
        F.struct(F.lit("grace").alias("kind"), (F.col("fin0.ts_us") + rules.fin_grace_s * US).alias("t")))).alias("q"))
    asked = (limits.select("flow_key", slot(F.col("q.t")).alias("slot"), F.col("q.t").alias("t"), F.lit(1).alias("ask"),
                           "pos", F.col("q.kind").alias("kind")).filter("t is not null")
             .unionByName(skeleton.select("flow_key", "slot", F.col("ts_us").alias("t"), F.lit(0).alias("ask"), "pos",
                                          F.lit(None).cast("string").alias("kind"))))
    answered = nearest_mark(asked, by, "slot", ["t", "ask"], {"hit": F.when(F.col("ask") == 0, F.col("pos"))},
                            ahead=True).filter("ask = 1")
    hits = answered.groupBy("flow_key", "pos").agg(
        F.min(F.when(F.col("kind") == "active", F.col("hit"))).alias("hit_active"),
        F.min(F.when(F.col("kind") == "grace", F.col("hit"))).alias("hit_grace"))
    both = F.when(F.col("fin_lo").isNotNull() & F.col("fin_hi").isNotNull(),
                  F.greatest("fin_lo.pos", "fin_hi.pos"))
    ended = starts.join(hits, ["flow_key", "pos"]).select(
        "flow_key", "pos", "pkt_id", "from_lo",
        F.least(F.col("next_rst") + 1, F.col("hit_active") + 1, F.col("hit_grace") + 1, both + 1,
                F.col("next_gap")).alias("resume"))
    following = skeleton.select("flow_key", F.col("pos").alias("resume"), F.col("next_start").alias("nxt"))
    edges = settle(ended.join(following, ["flow_key", "resume"], "left"), "hot-edges")

    # starts reached from the first one: after round k all within 2^k flows of it
    jump = edges.select("flow_key", "pos", "nxt").filter("nxt is not null")
    reached = starts.groupBy("flow_key").agg(F.min("pos").alias("pos"))
    while True:
        fresh = settle(reached.join(jump, ["flow_key", "pos"]).select("flow_key", F.col("nxt").alias("pos")), "reached")
        if not fresh.take(1):
            break
        reached = settle(reached.unionByName(fresh), "reached")
        far = jump.select("flow_key", F.col("pos").alias("nxt"), F.col("nxt").alias("far"))
        jump = settle(jump.join(far, ["flow_key", "nxt"]).select("flow_key", "pos", F.col("far").alias("nxt")), "jump")

    flows = edges.join(reached, ["flow_key", "pos"]).select(
        "flow_key", "pos", F.struct("pos", F.col("pkt_id").alias("flow_id"), F.col("from_lo").alias("lo0"),
                                    "resume").alias("opened"))
    tagged = nearest_mark(rows.join(flows, ["flow_key", "pos"], "left"), by, "slot", ["pos"],
                          {"owner": F.col("opened")}, ahead=False)
    kept = tagged.filter("owner is not null and (owner.resume is null or pos < owner.resume)")
    return kept.select(*[c for c in marked.columns], F.col("owner.flow_id").alias("flow_id"),
                       (F.col("from_lo") == F.col("owner.lo0")).alias("fwd"))
