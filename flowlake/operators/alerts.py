"""Alerts: parsing, views, counters, top lists, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALERT_JSON = ("timestamp double, source string, is_attack boolean, confidence double, attack_type string, "
              "rule_id int, original_features map<string,double>")
# Feature names that may hold the destination port, in order of preference.
PORT_KEYS = ["Destination Port", "Dst Port", "dst_port"]
# Upper edges of the confidence bands.
BANDS = [("<0.1", 0.1), ("0.1-0.3", 0.3), ("0.3-0.5", 0.5), ("0.5-0.7", 0.7), ("0.7-0.9", 0.9)]
LAST_BAND = ">=0.9"


def parse_alerts(df: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON alerts as columns; absent fields take their defaults."""
    a = F.from_json(payload, ALERT_JSON)
    return df.withColumn("__a", a).select(
        *[c for c in df.columns if c != payload], "__a.timestamp", "__a.source",
        F.coalesce("__a.is_attack", F.lit(False)).alias("is_attack"),
        F.coalesce("__a.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("__a.attack_type", F.lit("Unknown")).alias("attack_type"), "__a.rule_id",
        F.coalesce("__a.original_features", F.create_map().cast("map<string,double>")).alias("original_features"))


def alert_json(columns: list[str]) -> Column:
    """JSON text of an alert; null fields are left out."""
    return F.to_json(F.struct(*columns))


def dst_host(source: Column) -> Column:
    parts = F.split(source, "->")
    return F.nullif(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), F.lit(""))


def alert_view(alerts: DataFrame) -> DataFrame:
    """Add ``src``, ``dest`` (port if a feature names one, else host), ``list_type`` and ``risk``."""
    port = F.coalesce(*[F.element_at("features", k) for k in PORT_KEYS])
    src = F.nullif(F.trim(F.substring_index("source", "->", 1)), F.lit(""))
    kind = F.when(F.col("attack_type") == "Whitelisted", "whitelist").when(F.col("attack_type") == "Blacklisted", "blacklist")
    c = F.col("confidence")
    tier = F.when(c > 0.8, "critical").when(c > 0.5, "high").when(c > 0.3, "medium").otherwise("low")
    return alerts.withColumns({
        "src": F.coalesce(src, F.lit("Gizli IP")),
        "dest": F.coalesce(F.round(port).cast("long").cast("string"), dst_host(F.col("source")), F.lit("—")),
        "list_type": F.coalesce(kind, F.lit("model")),
        "risk": F.coalesce(kind, tier)})


def counters(alerts: DataFrame) -> DataFrame:
    """(scope, name, n): all alerts, all attacks, and attacks per type, from one rollup."""
    kind = F.when(F.col("is_attack"), F.coalesce("attack_type", F.lit("Unknown")))
    grouped = alerts.withColumn("kind", kind).rollup("is_attack", "kind").agg(
        F.count("*").alias("n"), F.grouping_id().alias("level"))
    scope = (F.when(F.col("level") == 3, "total").when((F.col("level") == 1) & F.col("is_attack"), "attacks")
             .when((F.col("level") == 0) & F.col("is_attack"), "type"))
    return grouped.select(scope.alias("scope"), F.coalesce("kind", F.lit("")).alias("name"), "n").filter("scope is not null")


def attack_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.filter("is_attack").groupBy("attack_type").agg(F.count("*").alias("n"))


def per_second(alerts: DataFrame) -> DataFrame:
    """Traffic and attacks per second."""
    return alerts.groupBy(F.window("ts", "1 second").alias("w")).agg(
        F.count("*").alias("traffic"), F.count_if("is_attack").alias("attacks")).select(
        F.col("w.start").alias("second"), "traffic", "attacks")


def recent(alerts: DataFrame, n: int, only_attacks: bool = False) -> DataFrame:
    """Newest ``n`` alerts."""
    return (alerts.filter("is_attack") if only_attacks else alerts).orderBy(F.desc("id")).limit(n)


def confidence_stats(alerts: DataFrame) -> DataFrame:
    """Confidence per predicted class; for benign rows one minus the attack confidence."""
    c = F.when(F.col("is_attack"), F.col("confidence")).otherwise(1 - F.col("confidence"))
    return alerts.groupBy("is_attack").agg(F.count("*").alias("n"), F.min(c).alias("c_min"), F.max(c).alias("c_max"),
                                           F.avg(c).alias("c_mean"), F.stddev_pop(c).alias("c_std"))


def confidence_bands(alerts: DataFrame) -> DataFrame:
    """Alerts per confidence band with their share."""
    band = F.lit(LAST_BAND)
    for name, top in reversed(BANDS):
        band = F.when(F.col("confidence") < top, name).otherwise(band)
    counts = alerts.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def top_flagged(alerts: DataFrame, k: int = 5) -> DataFrame:
    """Destinations with most attack alerts."""
    return (alerts.filter("is_attack").groupBy(dst_host(F.col("source")).alias("dst"))
            .agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))
            .orderBy(F.desc("n"), "dst").limit(k))


def top_values(alerts: DataFrame, value: Column, name: str, k: int) -> DataFrame:
    """Most frequent values with total and attack counts."""
    return (alerts.groupBy(value.alias(name)).agg(F.count("*").alias("total"), F.count_if("is_attack").alias("attacks"))
            .orderBy(F.desc("total"), name).limit(k))


def phase_comparison(alerts: DataFrame, baseline_end: Column, targets: list[str]) -> DataFrame:
    """Attack share before ``baseline_end``, after it, and after it among flows that touch a target."""
    src, dst = F.trim(F.substring_index("source", "->", 1)), dst_host(F.col("source"))
    after = F.col("ts") > baseline_end
    hit = after & (src.isin(targets) | dst.isin(targets))
    slices = F.array_compact(F.array(F.when(~after, "baseline"), F.when(after, "attack-window"), F.when(hit, "target")))
    return alerts.withColumn("phase", F.explode(slices)).groupBy("phase").agg(
        F.count("*").alias("flows"), F.count_if("is_attack").alias("attacks"),
        (F.count_if("is_attack") * 100.0 / F.count("*")).alias("attack_pct"))


def health(alerts: DataFrame) -> DataFrame:
    """Attack rate with its verdict: above 30 % warning, above 10 % notice."""
    rate = F.count_if("is_attack") * 100.0 / F.count("*")
    return alerts.agg(F.count("*").alias("flows"), F.count_if("is_attack").alias("attacks"), rate.alias("attack_pct")
                      ).withColumn("status", F.when(F.col("attack_pct") > 30, "warning")
                                   .when(F.col("attack_pct") > 10, "notice").otherwise("healthy"))


def critical_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(F.col("confidence") > 0.8).alias("critical"))


def login_severity(action: Column) -> Column:
    """fail, ok or warn from the wording of an auth-log action."""
    return (F.when(action.contains("BAŞARISIZ") | action.contains("Yanlış"), "fail")
            .when(action.contains("Başarılı"), "ok").otherwise("warn"))
