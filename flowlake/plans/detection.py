"""Queries over rules, scores, alerts and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators import alerts as al
from flowlake.operators import datasets, drift, labels, metrics, nfv3_features, nfv3_segments, rules, scoring
from flowlake.plans.derived import cte, table
from flowlake.plans.flows import NF_COLUMN_SQL, NF_REC
from flowlake.plans.registry import query, rounded
from flowlake.plans.tables import FIT_SQL, INPUTS, NUMERIC, RF, _fit, raw_flows
from flowlake.plans.training import SHOTS
from flowlake.session import new_path, settle

AS_OF = "2024-06-01 00:00:00"
AL = cte("alerts")
PR = cte("predictions")
LG = cte("logits")
ACTIVE_SQL = f"SELECT * FROM ip_rules WHERE is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')"


def v4(col: str) -> str:
    return "(" + " + ".join(f"CAST(split_part({col}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)) + ")"


RANGES_SQL = f"""act AS ({ACTIVE_SQL}),
rng AS (SELECT id, list_type, CASE WHEN list_type = 'blacklist' THEN 0 ELSE 1 END AS rank,
 {v4("split_part(cidr, '/', 1)")} // CAST(pow(2, 32 - CAST(split_part(cidr, '/', 2) AS INT)) AS BIGINT) AS net,
 CAST(pow(2, 32 - CAST(split_part(cidr, '/', 2) AS INT)) AS BIGINT) AS size FROM act)
"""


def hit_sql(ip: str, taken: str, key: str) -> str:
    order = "rng.rank * 1000 + rng.id"
    return (f"hit AS (SELECT {taken}.{key}, arg_min(rng.list_type, {order}) AS verdict, arg_min(rng.id, {order}) AS rule_id "
            f"FROM {taken}, rng WHERE {v4(ip)} // size = net GROUP BY {taken}.{key})\n")


def active_rules(spark, sf):
    return rules.active_rules(table(spark, sf, "ip_rules"), F.lit(AS_OF).cast("timestamp"))


def alerts(spark, sf):
    """Alerts with a confidence in [0, 1] and features as a map."""
    return table(spark, sf, "alerts").withColumns({
        "ts": F.col("ts").cast("timestamp"), "confidence": F.col("conf_milli") / F.lit(1000.0),
        "features": F.from_json("features_json", "map<string,double>")})


USED_SQL = "LEFT JOIN (SELECT rule_id, count(*) AS n FROM alerts GROUP BY rule_id) u ON u.rule_id = q.id"


def with_use(spark, sf, listed):
    """Rules with the number of alerts they decided."""
    used = alerts(spark, sf).groupBy(F.col("rule_id").alias("id")).agg(F.count("*").alias("n"))
    return listed.join(used, "id", "left").withColumn("n_alerts", F.coalesce("n", F.lit(0))).drop("n")


@query("ip_rules_active", cte("ip_rules", "alerts") + f"SELECT id, cidr, list_type, coalesce(n, 0) AS n_alerts FROM ({ACTIVE_SQL}) q {USED_SQL}")
def ip_rules_active(spark, sf):
    return with_use(spark, sf, active_rules(spark, sf)).select("id", "cidr", "list_type", "n_alerts")


@query("ip_rules_list", cte("ip_rules", "alerts") + f"SELECT id, cidr, is_active, coalesce(n, 0) AS n_alerts FROM (SELECT * FROM ip_rules WHERE list_type = 'blacklist') q {USED_SQL}")
def ip_rules_list(spark, sf):
    listed = rules.list_rules(with_use(spark, sf, table(spark, sf, "ip_rules")), "blacklist")
    return listed.select("id", "cidr", "is_active", "n_alerts")


@query("ip_rule_match", cte("packets", "ip_rules") + f", {RANGES_SQL}, " + hit_sql("src_ip", "packets", "pkt_id") + """
SELECT pkt_id, src_ip, coalesce(verdict, 'none') AS verdict, coalesce(rule_id, -1) AS rule_id FROM packets LEFT JOIN hit USING (pkt_id)""")
def ip_rule_match(spark, sf):
    matched = rules.match_rules(table(spark, sf, "packets"), "src_ip", active_rules(spark, sf))
    return matched.select("pkt_id", "src_ip", F.coalesce("verdict", F.lit("none")).alias("verdict"),
                          F.coalesce("rule_id", F.lit(-1)).alias("rule_id"))


# As many rules as there are orders, of both families and all lengths from /25 to /32, and packets of which some are IPv6.
LONG_RULES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN concat('2001:db8:', o_orderkey % 50, '::/48')
 ELSE concat('10.', o_orderkey % 3, '.0.', (o_orderkey * 7919) % 256, '/', 25 + o_orderkey % 8) END AS cidr,
 CASE WHEN o_orderkey % 3 = 0 THEN 'blacklist' ELSE 'whitelist' END AS list_type FROM orders"""
BOTH_FAMILIES = "SELECT pkt_id, CASE WHEN pkt_id % 11 = 0 THEN concat('2001:db8:', pkt_id % 60, '::1') ELSE src_ip END AS src_ip FROM packets"


@query("ip_rule_match_long_list", cte("packets") + f""", long_rules AS ({LONG_RULES}), seen AS ({BOTH_FAMILIES}), ips AS (SELECT DISTINCT src_ip FROM seen),
v4r AS (SELECT *, CAST(pow(2, 32 - CAST(split_part(cidr, '/', 2) AS INT)) AS BIGINT) AS size, {v4("split_part(cidr, '/', 1)")} AS low FROM long_rules WHERE id % 5 <> 0),
hits AS (SELECT src_ip, id, list_type FROM (SELECT src_ip, {v4("src_ip")} AS n FROM ips WHERE src_ip NOT LIKE '%:%') i JOIN v4r ON n // size = low // size
 UNION ALL SELECT src_ip, id, list_type FROM ips JOIN long_rules ON id % 5 = 0 AND src_ip LIKE '%:%' AND split_part(src_ip, ':', 3) = split_part(cidr, ':', 3)),
hit AS (SELECT src_ip, arg_min(list_type, k) AS verdict, arg_min(id, k) AS rule_id FROM (
 SELECT *, CASE WHEN list_type = 'blacklist' THEN 0 ELSE 1000000000000 END + id AS k FROM hits) q GROUP BY src_ip)
SELECT pkt_id, src_ip, coalesce(verdict, 'none') AS verdict, coalesce(rule_id, -1) AS rule_id FROM seen LEFT JOIN hit USING (src_ip)""")
def ip_rule_match_long_list(spark, sf):
    """A long list of rules meets addresses of both families."""
    many = spark.sql(LONG_RULES.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf}/orders.parquet"))
    seen = spark.sql(BOTH_FAMILIES.replace("FROM packets", "FROM {packets}"), packets=table(spark, sf, "packets"))
    matched = rules.match_rules(seen, "src_ip", many)
    return matched.select("pkt_id", "src_ip", F.coalesce("verdict", F.lit("none")).alias("verdict"),
                          F.coalesce("rule_id", F.lit(-1)).alias("rule_id"))


@query("alerts_with_rules", cte("alerts", "ip_rules") + """SELECT a.id, a.source, a.attack_type, coalesce(a.rule_id, -1) AS rule_id,
 coalesce(r.cidr, '') AS cidr, coalesce(r.list_type, '') AS list_type FROM alerts a LEFT JOIN ip_rules r ON r.id = a.rule_id""")
def alerts_with_rules(spark, sf):
    out = rules.annotate_alerts(alerts(spark, sf), table(spark, sf, "ip_rules"))
    return out.select("id", "source", "attack_type", F.coalesce("rule_id", F.lit(-1)).alias("rule_id"),
                      *[F.coalesce(c, F.lit("")).alias(c) for c in ("cidr", "list_type")])


# ---- scoring --------------------------------------------------------------------------------------------------

def formula(df):
    """Scorer used where results must be reproducible in SQL: the probability already stored with the row."""
    return df.withColumns(scoring.decide(F.col("conf_milli") / F.lit(1000.0), scoring.FOREST_THRESHOLD))


scoring.register_scorer("stored", formula)


@query("score_placeholder", AL + "SELECT id, false AS is_attack, 0.0::DOUBLE AS confidence, 'ModelNotLoaded' AS attack_type FROM alerts")
def score_placeholder(spark, sf):
    return scoring.score(table(spark, sf, "alerts").select("id"), "placeholder")


@query("score_registry", AL + """SELECT id, conf_milli > 400 AS is_attack, conf_milli::DOUBLE / 1000 AS confidence,
 CASE WHEN conf_milli > 400 THEN 'Malicious' ELSE 'Benign' END AS attack_type FROM alerts""")
def score_registry(spark, sf):
    return scoring.score(table(spark, sf, "alerts").select("id", "conf_milli"), "stored").drop("conf_milli")


@query("decide_argmax", LG + """SELECT row_id, l1 > l0 AS is_attack, round(exp(l1) / (exp(l0) + exp(l1)), 6) AS confidence,
 CASE WHEN l1 > l0 THEN 'Malicious' ELSE 'Benign' END AS attack_type FROM logits""")
def decide_argmax(spark, sf):
    df = table(spark, sf, "logits").withColumns(scoring.decide_binary(F.col("l0"), F.col("l1")))
    return rounded(df.select("row_id", "is_attack", "confidence", "attack_type"))


@query("decide_multiclass", LG + """, b AS (SELECT row_id, CASE greatest(m0, m1, m2, m3, m4) WHEN m0 THEN 0 WHEN m1 THEN 1 WHEN m2 THEN 2 WHEN m3 THEN 3 ELSE 4 END AS k,
 exp(m0) / (exp(m0) + exp(m1) + exp(m2) + exp(m3) + exp(m4)) AS p0 FROM logits)
SELECT row_id, k <> 0 AS is_attack, round(1 - p0, 6) AS confidence, CASE k WHEN 0 THEN 'Benign' WHEN 1 THEN 'DDoS' WHEN 2 THEN 'PortScan'
 WHEN 3 THEN 'WebAttack' ELSE 'Botnet' END AS attack_type FROM b""")
def decide_multiclass(spark, sf):
    df = table(spark, sf, "logits").withColumns(scoring.decide_classes([F.col(f"m{i}") for i in range(5)]))
    return rounded(df.select("row_id", "is_attack", "confidence", "attack_type"))


def flows_to_judge(df):
    """Rows of ``alerts`` as flows; every seventh has odd numbers to clean."""
    odd = F.when(F.col("id") % 14 == 0, float("nan")).when(F.col("id") % 7 == 0, float("inf"))
    return df.select("id", "source", "conf_milli", F.transform_values("features", lambda _, v: F.coalesce(odd, v)).alias("features"))


def judged(out):
    return out.select("id", "is_attack", "confidence", "attack_type", F.coalesce("rule_id", F.lit(-1)).alias("rule_id"),
                      F.aggregate(F.map_values("features"), F.lit(0.0), lambda a, x: a + x).alias("feature_sum"))


@query("alerts_short_circuit", cte("alerts", "ip_rules") + f", {RANGES_SQL}, " + hit_sql("split_part(source, '->', 1)", "alerts", "id") + """
SELECT a.id, CASE verdict WHEN 'blacklist' THEN true WHEN 'whitelist' THEN false ELSE conf_milli > 400 END AS is_attack,
 CASE verdict WHEN 'blacklist' THEN 1.0 WHEN 'whitelist' THEN 0.0 ELSE conf_milli::DOUBLE / 1000 END AS confidence,
 CASE verdict WHEN 'blacklist' THEN 'Blacklisted' WHEN 'whitelist' THEN 'Whitelisted' ELSE CASE WHEN conf_milli > 400 THEN 'Malicious' ELSE 'Benign' END END AS attack_type,
 coalesce(h.rule_id, -1) AS rule_id, (CASE WHEN a.id % 7 = 0 THEN 0 ELSE 1 END) * (CASE a.id % 3 WHEN 0 THEN 443 + a.id % 5 + a.id % 1500 WHEN 1 THEN 8000 + a.id % 90 ELSE 53 END)::DOUBLE AS feature_sum
FROM alerts a LEFT JOIN hit h USING (id)""")
def alerts_short_circuit(spark, sf):
    return judged(scoring.raise_alerts(flows_to_judge(alerts(spark, sf)), active_rules(spark, sf), "stored"))


@query("outcome_classes", PR + """SELECT CASE WHEN y_true = 1 AND y_pred = 1 THEN 'HIT' WHEN y_true = 1 THEN 'MISS' WHEN y_pred = 1 THEN 'FALSE ALARM' ELSE 'OK' END AS outcome,
 count(*) AS n FROM predictions GROUP BY 1""")
def outcome_classes(spark, sf):
    return table(spark, sf, "predictions").groupBy(
        labels.outcome(F.col("y_true") == 1, F.col("y_pred") == 1).alias("outcome")).agg(F.count("*").alias("n"))


# ---- alerts ---------------------------------------------------------------------------------------------------

@query("alerts_parse_json", AL + """SELECT id, source, is_attack, CASE WHEN id % 50 = 0 THEN 0.0 ELSE conf_milli::DOUBLE / 1000 END AS confidence,
 CASE WHEN id % 50 = 0 THEN 'Unknown' ELSE attack_type END AS attack_type, coalesce(rule_id, -1) AS rule_id,
 CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS n_features FROM alerts""")
def alerts_parse_json(spark, sf):
    df = alerts(spark, sf)
    bare = F.col("id") % 50 == 0
    sent = df.select("id", "source", "is_attack", F.when(~bare, F.col("confidence")).alias("confidence"),
                     F.when(~bare, F.col("attack_type")).alias("attack_type"), "rule_id",
                     F.col("features").alias("original_features"))
    payload = sent.select("id", al.alert_json(sent.columns[1:]).alias("payload"))
    return al.parse_alerts(payload).select(
        "id", "source", "is_attack", "confidence", "attack_type", F.coalesce("rule_id", F.lit(-1)).alias("rule_id"),
        F.size("original_features").alias("n_features"))


VIEW_PORT = """CASE WHEN id % 3 = 0 THEN CAST(443 + id % 5 AS VARCHAR) WHEN id % 3 = 1 THEN CAST(8000 + id % 90 AS VARCHAR)
 ELSE split_part(source, '->', 2) END"""


@query("alert_view", AL + f"""SELECT id, split_part(source, '->', 1) AS src, {VIEW_PORT} AS dest,
 CASE attack_type WHEN 'Whitelisted' THEN 'whitelist' WHEN 'Blacklisted' THEN 'blacklist' ELSE 'model' END AS list_type,
 CASE WHEN attack_type = 'Whitelisted' THEN 'whitelist' WHEN attack_type = 'Blacklisted' THEN 'blacklist' WHEN conf_milli > 800 THEN 'critical'
 WHEN conf_milli > 500 THEN 'high' WHEN conf_milli > 300 THEN 'medium' ELSE 'low' END AS risk FROM alerts""")
def alert_view(spark, sf):
    return al.alert_view(alerts(spark, sf)).select("id", "src", "dest", "list_type", "risk")


@query("alert_counters", AL + """SELECT 'total' AS scope, '' AS name, count(*) AS n FROM alerts
UNION ALL SELECT 'attacks', '', count(*) FROM alerts WHERE is_attack
UNION ALL SELECT 'type', attack_type, count(*) FROM alerts WHERE is_attack GROUP BY attack_type""")
def alert_counters(spark, sf):
    return al.counters(alerts(spark, sf))


@query("attack_distribution", AL + "SELECT attack_type, count(*) AS n FROM alerts WHERE is_attack GROUP BY attack_type")
def attack_distribution(spark, sf):
    return al.attack_distribution(alerts(spark, sf))


@query("traffic_per_second", AL + """SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS second_s, count(*) AS traffic, count(*) FILTER (is_attack) AS attacks
FROM alerts GROUP BY 1 ORDER BY 1 DESC LIMIT 20""")
def traffic_per_second(spark, sf):
    return al.per_second(alerts(spark, sf)).orderBy(F.desc("second")).limit(20).select(
        F.unix_seconds("second").alias("second_s"), "traffic", "attacks")


@query("recent_alerts", AL + "SELECT id, source, is_attack, attack_type FROM alerts ORDER BY id DESC LIMIT 100")
def recent_alerts(spark, sf):
    return al.recent(alerts(spark, sf), 100).select("id", "source", "is_attack", "attack_type")


@query("recent_attacks50", AL + "SELECT id, source, attack_type FROM alerts WHERE is_attack ORDER BY id DESC LIMIT 50")
def recent_attacks50(spark, sf):
    return al.recent(alerts(spark, sf), 50, only_attacks=True).select("id", "source", "attack_type")


@query("authlog_recent", cte("auth_logs") + """SELECT id, username, ip_address, CASE WHEN contains(action, 'BAŞARISIZ') OR contains(action, 'Yanlış') THEN 'fail'
 WHEN contains(action, 'Başarılı') THEN 'ok' ELSE 'warn' END AS severity FROM auth_logs ORDER BY id DESC LIMIT 100""")
def authlog_recent(spark, sf):
    logs = table(spark, sf, "auth_logs").orderBy(F.desc("id")).limit(100)
    return logs.select("id", "username", "ip_address", al.login_severity(F.col("action")).alias("severity"))


@query("confidence_stats", AL + """, c AS (SELECT is_attack, CASE WHEN is_attack THEN conf_milli::DOUBLE / 1000 ELSE 1 - conf_milli::DOUBLE / 1000 END AS c FROM alerts)
SELECT is_attack, count(*) AS n, round(min(c), 6) AS c_min, round(max(c), 6) AS c_max, round(avg(c), 6) AS c_mean, round(stddev_pop(c), 6) AS c_std FROM c GROUP BY is_attack""")
def confidence_stats(spark, sf):
    return rounded(al.confidence_stats(alerts(spark, sf)))


@query("confidence_bands", AL + """SELECT CASE WHEN conf_milli < 100 THEN '<0.1' WHEN conf_milli < 300 THEN '0.1-0.3' WHEN conf_milli < 500 THEN '0.3-0.5' WHEN conf_milli < 700 THEN '0.5-0.7'
 WHEN conf_milli < 900 THEN '0.7-0.9' ELSE '>=0.9' END AS band, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM alerts GROUP BY 1""")
def confidence_bands(spark, sf):
    return rounded(al.confidence_bands(alerts(spark, sf)))


@query("top_flagged_destinations", AL + """SELECT split_part(source, '->', 2) AS dst, count(*) AS n, round(avg(conf_milli) / 1000, 6) AS avg_confidence FROM alerts WHERE is_attack
GROUP BY 1 ORDER BY n DESC, dst LIMIT 5""")
def top_flagged_destinations(spark, sf):
    return rounded(al.top_flagged(alerts(spark, sf)))


@query("top_dst_ips", AL + """SELECT split_part(source, '->', 2) AS dst, count(*) AS total, count(*) FILTER (is_attack) AS attacks FROM alerts GROUP BY 1 ORDER BY total DESC, dst LIMIT 6""")
def top_dst_ips(spark, sf):
    return al.top_values(alerts(spark, sf), al.dst_host(F.col("source")), "dst", 6)


@query("top_dst_ports", AL + """SELECT CASE WHEN id % 3 = 0 THEN 443 + id % 5 WHEN id % 3 = 1 THEN 8000 + id % 90 ELSE 53 END AS port, count(*) AS total, count(*) FILTER (is_attack) AS attacks
FROM alerts GROUP BY 1 ORDER BY total DESC, port LIMIT 10""")
def top_dst_ports(spark, sf):
    port = F.coalesce(*[F.element_at("features", k) for k in (*al.PORT_KEYS, "L4_DST_PORT")]).cast("long")
    return al.top_values(alerts(spark, sf), port, "port", 10)


PHASES = "('192.168.0.1', '192.168.1.7', '10.1.0.12')"


@query("phase_comparison", AL + f""", p AS (SELECT *, ts > TIMESTAMP '2024-01-16 00:00:00' AS after,
 split_part(source, '->', 1) IN {PHASES} OR split_part(source, '->', 2) IN {PHASES} AS hit FROM alerts),
s AS (SELECT 'baseline' AS phase, is_attack FROM p WHERE NOT after UNION ALL SELECT 'attack-window', is_attack FROM p WHERE after
 UNION ALL SELECT 'target', is_attack FROM p WHERE after AND hit)
SELECT phase, count(*) AS flows, count(*) FILTER (is_attack) AS attacks, round(count(*) FILTER (is_attack) * 100.0 / count(*), 6) AS attack_pct FROM s GROUP BY phase""")
def phase_comparison(spark, sf):
    end = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return rounded(al.phase_comparison(alerts(spark, sf), end, ["192.168.0.1", "192.168.1.7", "10.1.0.12"])
                   .withColumn("attack_pct", F.col("attack_pct").cast("double")))


@query("attack_rate_health", AL + """, r AS (SELECT count(*) AS flows, count(*) FILTER (is_attack) AS attacks FROM alerts)
SELECT flows, attacks, round(attacks * 100.0 / flows, 6) AS attack_pct, CASE WHEN attacks * 100.0 / flows > 30 THEN 'warning' WHEN attacks * 100.0 / flows > 10 THEN 'notice' ELSE 'healthy' END AS status FROM r""")
def attack_rate_health(spark, sf):
    return rounded(al.health(alerts(spark, sf)).withColumn("attack_pct", F.col("attack_pct").cast("double")))


@query("critical_count", AL + "SELECT count(*) AS critical FROM alerts WHERE conf_milli > 800")
def critical_count(spark, sf):
    return al.critical_count(alerts(spark, sf))


EVIDENCE = ["RETRANSMITTED_IN_BYTES", "SRC_TO_DST_IAT_STDDEV", "TCP_FLAGS", "SRC_TO_DST_SECOND_BYTES", "FLOW_DURATION_MILLISECONDS"]


@query("high_conf_evidence", NF_REC + f""", f AS (SELECT flow_id, least(1.0::DOUBLE, in_bytes::DOUBLE / 5000) AS confidence, {', '.join(f"{NF_COLUMN_SQL[c]} AS {c}" for c in EVIDENCE)} FROM rec)
SELECT * FROM f WHERE confidence >= 0.95""")
def high_conf_evidence(spark, sf):
    flows = nfv3_features.nfv3_record(nfv3_segments.segment_flows(table(spark, sf, "packets")))
    scored = flows.withColumn("confidence", F.least(F.lit(1.0), F.col("IN_BYTES").cast("double") / 5000))
    return rounded(scored.filter("confidence >= 0.95").select("flow_id", "confidence", *EVIDENCE), 4)


# ---- metrics --------------------------------------------------------------------------------------------------

CONF_SQL = """conf AS (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
 count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM {0})"""
BIN_SQL = """SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
 round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS fpr,
 round(CASE WHEN fp + tn = 0 THEN 0 ELSE tn / (fp + tn) END, 6) AS specificity, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM conf"""


def predictions(spark, sf):
    return table(spark, sf, "predictions")


@query("confusion_binary", PR + ", " + CONF_SQL.format("predictions") + " SELECT * FROM conf")
def confusion_binary(spark, sf):
    return metrics.confusion(predictions(spark, sf), "y_true", "y_pred")


@query("metrics_binary", PR + ", " + CONF_SQL.format("predictions") + BIN_SQL)
def metrics_binary(spark, sf):
    return rounded(metrics.binary_metrics(metrics.confusion(predictions(spark, sf), "y_true", "y_pred")))


@query("metrics_multiclass", PR + """, cl AS (SELECT c_true AS cls FROM predictions UNION SELECT c_pred FROM predictions),
per AS (SELECT cls, (SELECT count(*) FROM predictions WHERE c_true = cls AND c_pred = cls) AS hits, (SELECT count(*) FROM predictions WHERE c_true = cls) AS support,
 (SELECT count(*) FROM predictions WHERE c_pred = cls) AS predicted FROM cl),
m AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
 2 * hits / (support + predicted) AS f1 FROM per)
SELECT CAST(cls AS VARCHAR) AS cls, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m
UNION ALL SELECT 'macro', CAST(sum(support) AS BIGINT), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM m
UNION ALL SELECT 'weighted', CAST(sum(support) AS BIGINT), round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM m""")
def metrics_multiclass(spark, sf):
    per = metrics.class_metrics(predictions(spark, sf), "c_true", "c_pred")
    avg = metrics.averaged_metrics(per)
    kinds = ("precision", "recall", "f1")
    rows = per.select(F.col("cls").cast("string").alias("cls"), "support", *kinds)
    for way in ("macro", "weighted"):
        rows = rows.unionByName(avg.select(F.lit(way).alias("cls"), F.col("n").alias("support"),
                                           *[F.col(f"{k}_{way}").alias(k) for k in kinds]))
    return rounded(rows)


AUC_SQL = """SELECT round(CASE WHEN np * nn = 0 THEN 0 ELSE (rs - np * (np + 1) / 2.0::DOUBLE) / (np * nn) END, 6) AS auroc, np AS n_pos, nn AS n_neg FROM (
 SELECT sum(CASE WHEN y = 1 THEN r END) AS rs, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn FROM (
  SELECT {y} AS y, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0::DOUBLE AS r FROM {t}) q) z"""


@query("auroc_binary", PR + AUC_SQL.format(y="y_true", s="p_milli", t="predictions"))
def auroc_binary(spark, sf):
    df = predictions(spark, sf).withColumn("all", F.lit(1))
    return rounded(metrics.auroc(df, "y_true", "p_milli", ["all"]).drop("all"))


@query("auroc_ovr", LG + "SELECT CASE WHEN min(least(n_pos, n_neg)) = 0 THEN 0 ELSE round(avg(auroc), 6) END AS auroc_macro, count(*) AS classes FROM (" + " UNION ALL ".join(
    f"(SELECT auroc, n_pos, n_neg FROM ({AUC_SQL.format(y=f'CASE WHEN c_true = {k} THEN 1 ELSE 0 END', s=f'm{k}', t='logits').replace(', 6)', ', 12)')}) x{k})" for k in range(3)) + ") u")
def auroc_ovr(spark, sf):
    return rounded(metrics.auroc_one_vs_rest(table(spark, sf, "logits"), "c_true", ["m0", "m1", "m2"]))


@query("recall_by_attack", PR + """SELECT attack_name, count(*) FILTER (y_pred = 1) AS caught, count(*) AS n, round(count(*) FILTER (y_pred = 1) / count(*), 6) AS recall
FROM predictions WHERE y_true = 1 GROUP BY attack_name""")
def recall_by_attack(spark, sf):
    return rounded(metrics.recall_by(predictions(spark, sf), "attack_name", "y_true", "y_pred"))


def protocol_sql(pred: str = "y_pred") -> str:
    return PR + f""", base AS (SELECT row_id, dataset, y_true, {pred} AS y_pred, p_milli, row_number() OVER (PARTITION BY dataset ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY dataset) AS cnt,
 row_number() OVER (PARTITION BY dataset, y_true ORDER BY md5('42|' || row_id), row_id) AS fs FROM predictions),
ev AS (SELECT 'a' AS protocol, dataset, 0 AS shots, y_true, y_pred, p_milli FROM base WHERE rn > floor(cnt * 0.9::DOUBLE)
 UNION ALL SELECT 'b', dataset, 0, y_true, y_pred, p_milli FROM base
 UNION ALL SELECT 'c', dataset, shots, y_true, y_pred, p_milli FROM base, (VALUES (5), (10), (20), (50)) s(shots) WHERE fs > shots),
k AS (SELECT *, rank() OVER (PARTITION BY protocol, dataset, shots ORDER BY p_milli) + (count(*) OVER (PARTITION BY protocol, dataset, shots, p_milli) - 1) / 2.0::DOUBLE AS r FROM ev),
g AS (SELECT protocol, dataset, shots, count(*) AS n, count(*) FILTER (y_true = 1) AS np, count(*) FILTER (y_true = 0) AS nn, sum(r) FILTER (y_true = 1) AS rs,
 count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
 count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM k GROUP BY ALL),
res AS (SELECT protocol, dataset, shots, n, (tp + tn) / n AS accuracy, (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 AS f1_macro,
 (rs - np * (np + 1) / 2.0::DOUBLE) / (np * nn) AS auroc, fp / (fp + tn) AS fpr FROM g)
"""


def protocol_results(spark, sf, predicted=None):
    df = predictions(spark, sf)
    if predicted is not None:
        df = df.withColumn("y_pred", predicted)
    keys = ["y_true", "y_pred", "p_milli"]
    split = datasets.split_ordered(df.select("row_id", "dataset", *keys))
    adapted = datasets.few_shot_rows(df, SHOTS, "y_true", keep=keys).withColumnRenamed("holdout", "dataset")
    counts = metrics.protocol_counts(split, F.col("split") == "test", adapted, SHOTS, keys)
    return metrics.protocol_results(counts, "y_true", "y_pred", "p_milli")


@query("protocol_eval", protocol_sql() + "SELECT protocol, dataset, shots, n, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(auroc, 6) AS auroc, round(fpr, 6) AS fpr FROM res")
def protocol_eval(spark, sf):
    return rounded(protocol_results(spark, sf))


@query("results_sink", protocol_sql() + "SELECT protocol, dataset, shots, round(accuracy, 6) AS accuracy, round(auroc, 6) AS auroc FROM res")
def results_sink(spark, sf):
    path = new_path(spark, "results")
    protocol_results(spark, sf).write.json(path)
    back = spark.read.schema("protocol string, dataset string, shots int, accuracy double, auroc double").json(path)
    return rounded(back)


@query("comparison_table", protocol_sql() + """SELECT 'threshold-0.4' AS phase, upper(protocol) AS protocol, dataset, CASE WHEN shots > 0 THEN CAST(shots AS VARCHAR) ELSE '-' END AS shots,
 printf('%.4f', accuracy) AS accuracy, printf('%.4f', f1_macro) AS f1_macro, printf('%.4f', auroc) AS auroc, printf('%.4f', fpr) AS fpr FROM res""")
def comparison_table(spark, sf):
    return metrics.comparison_table(protocol_results(spark, sf).withColumn("phase", F.lit("threshold-0.4")))


ATTRIBUTION = {c: i + 1 for i, c in enumerate(INPUTS)}


Z_SQL = FIT_SQL.replace("SELECT row_id, dataset, label, round", ", z AS (SELECT row_id, dataset, label, round", 1) + ")"


@query("importance_rank", Z_SQL + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(abs({c} * {w})), 3) AS importance FROM z" for c, w in ATTRIBUTION.items()))
def importance_rank(spark, sf):
    rows, _, _ = _fit(spark, sf)
    weighted = rows.select(*[(F.round(F.col(c).cast("double"), 4) * w).alias(c) for c, w in ATTRIBUTION.items()])
    return rounded(metrics.mean_absolute_rank(weighted, INPUTS), 3)


@query("fedavg_aggregate", RF + "SELECT 0 AS idx, round(avg(out_bytes), 4) AS value FROM raw_flows UNION ALL SELECT 1, round(avg(in_pkts), 4) FROM raw_flows UNION ALL SELECT 2, round(avg(out_pkts), 4) FROM raw_flows")
def fedavg_aggregate(spark, sf):
    local = raw_flows(spark, sf).groupBy("dataset").agg(
        F.array(F.avg("out_bytes"), F.avg("in_pkts"), F.avg("out_pkts")).alias("params"), F.count("*").alias("n"))
    return rounded(metrics.weighted_parameters(local, "params", "n"), 4)


@query("batch_eval", Z_SQL + """,
scored AS (SELECT z.row_id, z.label AS y_true, CASE WHEN z.in_pkts + z.out_pkts > 0.5 THEN 1 ELSE 0 END AS y_pred FROM z), """ + CONF_SQL.format("scored") + BIN_SQL)
def batch_eval(spark, sf):
    rows, _, _ = _fit(spark, sf)
    z = lambda c: F.round(F.col(c).cast("double"), 4)
    scored = rows.select(F.col("label").alias("y_true"),
                         F.when(z("in_pkts") + z("out_pkts") > 0.5, 1).otherwise(0).alias("y_pred"))
    return rounded(metrics.binary_metrics(metrics.confusion(scored, "y_true", "y_pred")))


# ---- drift ----------------------------------------------------------------------------------------------------

def hist_sql(where: str, name: str) -> str:
    """CTEs ``name`` (dataset, feature, bin, n) and ``name``_p with shares, by comparing each value with all edges."""
    parts = " UNION ALL ".join(
        f"SELECT dataset, '{c}' AS feature, least(len(list_filter(es, lambda e: e <= {c})), 50) - 1 AS bin, count(*) AS n FROM raw_flows, edges "
        f"WHERE {where} AND feature = '{c}' AND {c} BETWEEN lo AND hi GROUP BY ALL" for c in NUMERIC)
    return f"""{name}_c AS ({parts}), {name}_k AS (SELECT DISTINCT dataset FROM raw_flows WHERE {where}),
{name} AS (SELECT dataset, feature, bin, coalesce(n, 0) AS n FROM (SELECT dataset, feature, unnest(range(50)) AS bin FROM {name}_k, edges) b LEFT JOIN {name}_c USING (dataset, feature, bin)),
{name}_d AS (SELECT dataset, feature, bin, coalesce(n / (nullif(sum(n) OVER (PARTITION BY dataset, feature), 0) * (hi - lo) / 50), 0) + 1e-10::DOUBLE AS d FROM {name} JOIN edges USING (feature)),
{name}_p AS (SELECT dataset, feature, bin, d / sum(d) OVER (PARTITION BY dataset, feature) AS p FROM {name}_d)
"""


EDGES_SQL = "bounds AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, min({c}) AS lo, max({c}) AS hi FROM raw_flows WHERE dataset = 'unsw' AND isfinite({c})" for c in NUMERIC) + """),
edges AS (SELECT feature, lo, hi, list_transform(range(51), lambda i: CASE WHEN i = 50 THEN hi ELSE lo + i * ((hi - lo) / 50) END) AS es FROM bounds), """
KL_SQL = RF + ", " + EDGES_SQL + hist_sql("dataset = 'unsw'", "a") + ", " + hist_sql("true", "b") + \
    ", kl AS (SELECT b_p.dataset, feature, sum(a_p.p * ln(a_p.p / b_p.p)) AS kl FROM a_p JOIN b_p USING (feature, bin) GROUP BY ALL) "


def _reference(spark, sf):
    df = raw_flows(spark, sf)
    return df, drift.fit_reference(df.filter("dataset = 'unsw'"), NUMERIC)


@query("feature_histogram", RF + ", " + EDGES_SQL + hist_sql("true", "a") + "SELECT dataset, feature, bin, n FROM a")
def feature_histogram(spark, sf):
    df = raw_flows(spark, sf)
    edges = settle(drift.bin_edges(df.filter("dataset = 'unsw'"), NUMERIC), "edges")
    return drift.histogram(df, NUMERIC, edges, ["dataset"]).select("dataset", "feature", "bin", "n")


@query("drift_kl", KL_SQL + "SELECT dataset, feature, round(kl, 5) + 0.0 AS kl, kl > 0.1 AS drifted FROM kl")
def drift_kl(spark, sf):
    df, (edges, ref) = _reference(spark, sf)
    return rounded(drift.kl_by_feature(edges, ref, df, NUMERIC, by=["dataset"]), 5).withColumn("kl", F.col("kl") + 0.0)


@query("drift_summary", KL_SQL + """SELECT dataset, bool_or(kl > 0.1) AS drifted, round(avg(kl), 5) + 0.0 AS mean_kl, round(max(kl), 5) + 0.0 AS max_kl,
 coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (kl > 0.1), '') AS drifted_features FROM kl GROUP BY dataset""")
def drift_summary(spark, sf):
    df, (edges, ref) = _reference(spark, sf)
    return rounded(drift.drift_summary(drift.kl_by_feature(edges, ref, df, NUMERIC, by=["dataset"]), ["dataset"]), 5).withColumns(
        {c: F.col(c) + 0.0 for c in ("mean_kl", "max_kl")})
