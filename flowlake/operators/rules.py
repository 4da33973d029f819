"""Allow and deny rules: active set, CIDR match, annotation of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.ip import cidr_range, ip_hex, network
from flowlake.session import settle


def active_rules(rules: DataFrame, as_of: Column) -> DataFrame:
    """Rules in force at ``as_of``."""
    return rules.filter(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))


def list_rules(rules: DataFrame, list_type: str | None = None) -> DataFrame:
    """Rules, newest first, optionally of one list."""
    return (rules.filter(F.col("list_type") == list_type) if list_type else rules).orderBy(F.desc("id"))


def rule_ranges(rules: DataFrame) -> DataFrame:
    """Rules as address ranges with their rank: deny before allow, then by id.  Invalid CIDR texts are skipped."""
    return rules.select(
        F.struct(F.when(F.col("list_type") == "blacklist", 0).otherwise(1).alias("rank"), "id", "list_type").alias("rule"),
        F.inline(F.array(cidr_range(F.col("cidr"))))).filter("lo is not null")


def match_rules(df: DataFrame, ip: str, rules: DataFrame) -> DataFrame:
    """Add ``verdict`` (list type or null) and ``rule_id`` for the address in column ``ip``.

    The distinct addresses meet the rules by an equi join on (prefix length, network), and the verdicts are joined back
    by address; AQE may split a hot address on the row side.  The plan is the same for any number of rules.
    """
    verdicts = _match_by_prefix(df.select(ip).distinct(), ip, settle(rule_ranges(rules), "rules"))
    return df.join(verdicts, ip, "left").select(*df.columns, "verdict", "rule_id")


def _match_by_prefix(addresses: DataFrame, ip: str, ranges: DataFrame) -> DataFrame:
    # at most 33 + 129 prefix lengths exist, so the one-row list is bounded
    lengths = ranges.select(F.substring("lo", 1, 1).alias("family"), "bits").distinct().agg(
        F.collect_list(F.struct("family", "bits")).alias("lengths"))
    each = (addresses.select(ip, ip_hex(F.col(ip)).alias("__ip"), lengths.scalar().alias("lengths"))
            .select(ip, "__ip", F.explode("lengths").alias("l"))
            .filter(F.col("l.family") == F.substring("__ip", 1, 1))
            .select(ip, F.col("l.bits").alias("bits"), network(F.col("__ip"), F.col("l.bits")).alias("lo")))
    best = each.join(ranges.select("rule", "lo", "bits"), ["bits", "lo"]).groupBy(ip).agg(F.min("rule").alias("rule"))
    return best.select(ip, F.col("rule.list_type").alias("verdict"), F.col("rule.id").alias("rule_id"))


def annotate_alerts(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts with the CIDR and list of the rule that decided them."""
    listed = rules.select(F.col("id").alias("rule_id"), "cidr", "list_type")
    return alerts.join(listed, "rule_id", "left")
