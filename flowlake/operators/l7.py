"""Application ids: port tables, the classifier side channel, and their join to flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators.flow_keys import flow_keys
from flowlake.operators.ordered import nearest_mark


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def port_app_id(dst_port: Column, src_port: Column, proto: Column) -> Column:
    """Application id from the destination port, else the source port, else the protocol, else 0."""
    return F.coalesce(_lookup(fv.PORT_APP_ID, dst_port.cast("int")), _lookup(fv.PORT_APP_ID, src_port.cast("int")),
                      _lookup(fv.PROTO_APP_ID, proto.cast("int")), F.lit(0))


def app_name_id(name: Column) -> Column:
    """Application id from ``Master.Sub`` text; unknown names give 0."""
    return F.coalesce(_lookup(fv.APP_NAME_ID, F.split(name, r"\.")[0]), F.lit(0))


def known_apps(app_flows: DataFrame) -> DataFrame:
    """Entries of the side channel with ``app_id``; guessed and unknown ones are ignored."""
    return app_flows.withColumn("app_id", app_name_id(F.col("app_name"))).filter(
        ~((F.col("app_id") == 0) & F.col("is_guessed")))


def app_cache(app_flows: DataFrame) -> DataFrame:
    """Latest application id per directed 5-tuple, as the cache holds it after the last entry."""
    return known_apps(app_flows).groupBy("src_ip", "src_port", "dst_ip", "dst_port", "proto").agg(
        F.max_by("app_id", F.struct("ts_us", "flow_no")).alias("app_id"), F.max("ts_us").alias("seen_us"))


def resolve_apps(flows: DataFrame, app_flows: DataFrame, max_age_s: int = 600) -> DataFrame:
    """Add ``l7_proto`` to flows (``src_ip, src_port, dst_ip, dst_port, proto, end_us``).

    A flow asks at its end for the newest entry of its 5-tuple that is at most ``max_age_s`` old then; entries that come
    later are not known yet.  Its own direction wins over the other.  No entry, or entry 0, falls back to the port
    tables.  Entries and questions are one list per key in order of time, cut into time slots, so a key with any number
    of entries is spread over tasks.
    """
    age = max_age_s * 1_000_000
    entries = flow_keys(known_apps(app_flows)).select(
        "flow_key", "from_lo", F.col("ts_us").alias("t"), F.lit(0).alias("ask"),
        F.struct(F.col("ts_us").alias("seen_us"), "flow_no", "app_id").alias("entry"))
    asked = flow_keys(flows).withColumns({"t": F.col("end_us"), "ask": F.lit(1), "entry": F.lit(None).cast(
        entries.schema["entry"].dataType)})
    both = asked.unionByName(entries, allowMissingColumns=True).withColumn("slot", F.floor(F.col("t") / age))
    seen = nearest_mark(both, ["flow_key"], "slot", ["t", "ask"], {
        "lo": F.when(F.col("from_lo"), F.col("entry")), "hi": F.when(~F.col("from_lo"), F.col("entry"))}, ahead=False)
    fresh = lambda e: F.when(F.col("end_us") - e["seen_us"] <= age, e["app_id"])
    own = F.when(F.col("from_lo"), F.col("lo")).otherwise(F.col("hi"))
    other = F.when(F.col("from_lo"), F.col("hi")).otherwise(F.col("lo"))
    resolved = F.coalesce(fresh(own), fresh(other))
    guess = port_app_id(F.col("dst_port"), F.col("src_port"), F.col("proto"))
    return seen.filter("ask = 1").withColumns({
        "cached_app": resolved, "l7_proto": F.coalesce(F.nullif(resolved, F.lit(0)), guess)}).select(
        *flows.columns, "cached_app", "l7_proto")
