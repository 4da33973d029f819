"""Rules, scoring, alerts, metrics, drift and augmentation."""

import ipaddress
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.functions.ip import cidr_range, ip_hex, register
from flowlake import fixed_values as fv
from flowlake.operators import alerts, datasets, drift, l7, metrics, rules, scoring
from flowlake.streaming.alerts import drift_so_far


def hex_of(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    return f"{ip.version}:{int(ip):0{8 if ip.version == 4 else 32}x}"


ADDRESSES = ["10.0.0.1", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "::", "::1", "2001:db8::ff00:42:8329", "1::",
             "2001:0db8:0000:0000:0000:ff00:0042:8329", "::ffff:10.1.2.3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
             "1:2:3:4:5:6:7:8:9", "1::2::3", "fe80::1%eth0", "hello", "", "12345::", ":1", "1:", ":::"]


def test_addresses(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string").select("ip", ip_hex(F.col("ip")).alias("h"))
    want = {a: hex_of(a) for a in ADDRESSES if "%" not in a}
    assert {r.ip: r.h for r in df.collect() if "%" not in r.ip} == want


def test_cidr_bounds(spark):
    cidrs = ["10.0.0.0/24", "10.0.0.77/25", "10.1.2.3/32", "0.0.0.0/0", "10.9.8.7", "2001:db8::/33", "2001:db8::1/128", "::/0",
             "fe80::abcd/61", "10.0.0.0/33", "bad/8", "10.0.0.0/x"]
    got = {r.c: (r.r.lo, r.r.hi) for r in spark.createDataFrame([(c,) for c in cidrs], "c string").select(
        "c", cidr_range(F.col("c")).alias("r")).collect()}
    for c in cidrs:
        try:
            net = ipaddress.ip_network(c, strict=False)
            assert got[c] == (hex_of(str(net[0])), hex_of(str(net[-1]))), c
        except ValueError:
            assert None in got[c], c


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT ip_to_long('10.0.0.1') a, ip_to_long('10.0.0.999') b, ip_to_long('x') c, cidr_lo('10.0.0.77/25') d, "
                    "cidr_hi('10.0.0.77/25') e, cidr_hi('10.9.8.7') f").first()
    ten = 10 << 24
    assert tuple(row) == (ten + 1, None, None, ten, ten + 127, ten + (9 << 16) + (8 << 8) + 7)


def test_rule_match(spark):
    rng = random.Random(3)
    listed = [(i, f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}/{rng.choice([8, 16, 20, 24, 27, 30, 32])}",
               rng.choice(["blacklist", "whitelist"])) for i in range(1, 30)] + [(40, "2001:db8::/40", "blacklist"), (41, "junk", "blacklist")]
    ips = [f"10.{rng.randrange(4)}.{rng.randrange(5)}.{rng.randrange(256)}" for _ in range(200)] + ["2001:db8:11::5", "2001:db9::1", "oops"]

    def want(ip):
        for kind in ("blacklist", "whitelist"):
            for i, c, k in listed:
                try:
                    if k == kind and ipaddress.ip_address(ip) in ipaddress.ip_network(c, strict=False):
                        return kind, i
                except ValueError:
                    pass
        return None, None

    df = spark.createDataFrame([(ip,) for ip in ips], "ip string")
    got = rules.match_rules(df, "ip", spark.createDataFrame(listed, "id int, cidr string, list_type string"))
    assert len(got.collect()) == len(ips)
    assert {r.ip: (r.verdict, r.rule_id) for r in got.collect()} == {ip: want(ip) for ip in ips}


def test_scorers(spark):
    row = scoring.score(spark.range(1), "placeholder").first()
    assert (row.is_attack, row.confidence, row.attack_type) == (False, 0.0, "ModelNotLoaded")
    with pytest.raises(KeyError):
        scoring.scorer("nothing")
    scoring.register_scorer("broken", lambda df: df)
    with pytest.raises(ValueError):
        scoring.score(spark.range(1), "broken")


def test_features_are_cleaned_before_scoring(spark):
    seen = []
    scoring.register_scorer("spy", lambda df: (seen.append(df), scoring.placeholder(df))[1])
    flows = spark.createDataFrame([("10.0.0.1->1.1.1.1", {"a": math.nan, "b": math.inf, "c": 2.0}), ("9.9.9.9->1.1.1.1", {"a": 1.0})],
                                  "source string, features map<string,double>")
    listed = spark.createDataFrame([(1, "9.0.0.0/8", "blacklist")], "id int, cidr string, list_type string")
    out = {r.source: r for r in scoring.raise_alerts(flows, listed, "spy").collect()}
    assert out["10.0.0.1->1.1.1.1"].features == {"a": 0.0, "b": 0.0, "c": 2.0}
    assert (out["9.9.9.9->1.1.1.1"].attack_type, out["9.9.9.9->1.1.1.1"].rule_id) == ("Blacklisted", 1)
    assert seen[0].count() == 2 and len(seen) == 1  # one pass over all rows; listed addresses override the score


def binary(spark, y, p):
    df = spark.createDataFrame(list(zip(y, p)), "y int, p int")
    return metrics.binary_metrics(metrics.confusion(df, "y", "p")).first()


def test_binary_metrics(spark):
    row = binary(spark, [0, 0, 1, 1, 0, 1], [0, 0, 1, 1, 0, 1])
    assert (row.accuracy, row.f1, row.fpr) == (1, 1, 0)
    row = binary(spark, [0, 0, 1, 1], [1, 1, 0, 0])
    assert (row.accuracy, row.fpr, row.f1) == (0, 1, 0)
    row = binary(spark, [0, 0, 1, 1, 0], [0, 1, 1, 1, 0])
    assert (row.tn, row.fp, row.fn, row.tp) == (2, 1, 0, 2)


def test_auroc_against_pairs(spark):
    rng = random.Random(5)
    data = [(rng.randrange(2), rng.randrange(40) / 40) for _ in range(300)]
    df = spark.createDataFrame([("g", *d) for d in data] + [("one", 1, 0.5)], "g string, y int, s double")
    got = {r.g: r.auroc for r in metrics.auroc(df, "y", "s", ["g"]).collect()}
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert got["g"] == pytest.approx(want) and got["one"] == 0.0
    easy = spark.createDataFrame([("g", 0, .1), ("g", 0, .2), ("g", 1, .8), ("g", 1, .9)], "g string, y int, s double")
    assert metrics.auroc(easy, "y", "s", ["g"]).first().auroc == 1.0


def test_drift(spark):
    base = spark.range(1000).select(F.randn(1).alias("x"), F.randn(2).alias("y"))
    edges, ref = drift.fit_reference(base, ["x", "y"])
    same = drift.drift_summary(drift.kl_by_feature(edges, ref, spark.range(500).select(F.randn(3).alias("x"), F.randn(4).alias("y")), ["x", "y"])).first()
    assert same.mean_kl < 0.5
    moved = drift.drift_summary(drift.kl_by_feature(edges, ref, base.select(F.col("x") + 5, F.col("y") + 50).toDF("x", "y"), ["x", "y"])).first()
    assert moved.drifted and moved.mean_kl > 0.1 and moved.drifted_features == "x,y"


def test_histogram_equals_numpy_on_edges(spark):
    values = [i / 10 for i in range(101)] + [0.1 * i for i in range(101)] + [3.3, 7.7000000000000001]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = {r.bin: r.n for r in drift.histogram(df, ["x"], drift.bin_edges(df, ["x"], 50)).collect()}
    assert [got[i] for i in range(50)] == np.histogram(values, bins=50)[0].tolist()


def test_drift_of_counts_added_up_equals_drift_of_all(spark):
    base = spark.range(900).select(F.randn(1).alias("x"), (F.col("id") % 2).alias("g"))
    edges, ref = drift.fit_reference(base, ["x"])
    new = base.withColumn("x", F.col("x") * 2)
    parts = [drift.histogram(new.where(cond), ["x"], edges, ["g"]) for cond in ("x < 0.3", "x >= 0.3 and g = 0", "x >= 0.3 and g = 1")]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    whole = {(r.g, r.feature): r.kl for r in drift.kl_by_feature(edges, ref, new, ["x"], by=["g"]).collect()}
    added = {(r.g, r.feature): r.kl for r in drift_so_far(counts, edges, ref, ["g"]).collect()}
    assert added == pytest.approx(whole) and len(whole) == 2


def test_auroc_of_an_absent_class(spark):
    df = spark.createDataFrame([(0, 0.9, 0.1, 0.0), (1, 0.2, 0.8, 0.0)], "t int, a double, b double, c double")
    assert metrics.auroc_one_vs_rest(df, "t", ["a", "b", "c"]).first().auroc_macro == 0.0
    assert metrics.auroc_one_vs_rest(df, "t", ["a", "b"]).first().auroc_macro == 1.0


def test_constant_feature_histogram(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    hist = drift.histogram(df, ["x"], drift.bin_edges(df, ["x"], 10))
    assert sorted(r.n for r in hist.collect()) == [0] * 9 + [4]


def test_augmentation(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), F.lit(0.0).alias("zero"), F.lit(1.0).alias("one"), F.lit(2.0).alias("two"))
    share = datasets.mask_features(df, ["one"], "s").agg(F.avg((F.col("one") == 0).cast("double"))).first()[0]
    assert 0.17 < share < 0.23
    std = datasets.add_noise(df, ["zero"], "s", std=0.1).agg(F.stddev("zero")).first()[0]
    assert 0.09 < std < 0.11
    swapped = datasets.swap_directions(df, [("one", "two")], "s").agg(F.avg((F.col("one") == 2).cast("double")), F.min(F.col("one") + F.col("two"))).first()
    assert 0.08 < swapped[0] < 0.12 and swapped[1] == 3
    low, high = datasets.jitter(df, ["one"], "s").agg(F.min("one"), F.max("one")).first()
    assert 0.95 <= low < 0.96 and 1.04 < high <= 1.05
    views = datasets.two_views(df, ["one"], [], [], "s", ops=())
    assert views.filter("one <> 1").count() == 0 and views.count() == 8000
    both = datasets.two_views(df, ["one"], [], [], "s", ops=("mask",))
    assert both.groupBy("row_id").agg(F.count_distinct("one").alias("n")).filter("n > 1").count() > 500


def test_warm_up(spark):
    df = spark.range(12).select(F.col("id").alias("row_id"), F.lit("d").alias("dataset"))
    states = [r.state for r in datasets.warm_up(df).orderBy("row_id").collect()]
    assert states[0] == "Warmup (1/10)" and states[8] == "Warmup (9/10)" and states[9:] == ["Ready"] * 3


def test_alert_defaults(spark):
    df = spark.createDataFrame([(1, "{}"), (2, '{"confidence": 0.9, "is_attack": true, "attack_type": "DoS", "original_features": {"a": 1}}')],
                               "id int, payload string")
    a, b = alerts.parse_alerts(df).orderBy("id").collect()
    assert (a.is_attack, a.confidence, a.attack_type, a.original_features) == (False, 0.0, "Unknown", {})
    assert (b.is_attack, b.confidence, b.attack_type, b.original_features) == (True, 0.9, "DoS", {"a": 1.0})


def test_apps_are_resolved_as_of_the_end(spark):
    s = 1_000_000
    tup = ("10.0.0.1", 40000, "10.0.0.2", 9999, 6)
    back = ("10.0.0.2", 9999, "10.0.0.1", 40000, 6)
    apps = [(0, *tup, "HTTP", False, 100 * s), (1, *tup, "QUIC", False, 5000 * s), (2, *back, "DNS", False, 5100 * s),
            (3, *back, "DNS", False, 9000 * s), (4, *tup, "Unknown", True, 9100 * s)]
    flows = [(1, *tup, 99 * s), (2, *tup, 100 * s), (3, *tup, 110 * s), (4, *tup, 701 * s), (5, *tup, 5200 * s), (6, *back, 5200 * s),
             (7, *tup, 9101 * s), (8, *tup, 99_999 * s)]
    cols = "src_ip string, src_port int, dst_ip string, dst_port int, proto int"
    got = l7.resolve_apps(spark.createDataFrame(flows, f"flow_id int, {cols}, end_us long"),
                          spark.createDataFrame(apps, f"flow_no int, {cols}, app_name string, is_guessed boolean, ts_us long"))
    http, quic, dns = (fv.APP_NAME_ID[n] for n in ("HTTP", "QUIC", "DNS"))
    assert {r.flow_id: r.cached_app for r in got.collect()} == {
        1: None, 2: http, 3: http, 4: None, 5: quic, 6: dns, 7: dns, 8: None}
