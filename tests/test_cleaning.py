"""Cleaning, vectors, labels and fit/apply parity."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators import cleaning, labels, prep
from flowlake.sources import files


def test_schema_counts():
    assert len(fv.NFV3_RAW_COLUMNS) == 53 and len(fv.NFV3_INPUT_COLUMNS) == 53 and len(fv.NFV3_FILE_COLUMNS) == 55
    assert len(fv.CIC_SCORER_NAMES) == 48 and len(fv.LOG_COLUMNS) == 26 and len(fv.SWAP_PAIRS) == 13
    assert len(set(fv.NFV3_INPUT_COLUMNS)) == 53


def vector(spark, **values):
    names = {"port": "Dst Port", "rate": "Flow Byts/s"}
    df = spark.range(1).select(*[F.lit(v).alias(names[k]) for k, v in values.items()], F.lit("x").alias("extra"))
    out = cleaning.align(cleaning.rename(df, fv.CIC_SCORER_NAMES), list(fv.CIC_SCORER_NAMES.values()))
    return out.select(*[cleaning.zero_if_not_finite(cleaning.number(cleaning.q(c))).alias(c) for c in out.columns])


def test_vector_alignment(spark):
    empty = vector(spark)
    assert empty.columns == list(fv.CIC_SCORER_NAMES.values()) and set(empty.first()) == {0.0}
    row = vector(spark, port=80).first()
    assert row["Destination Port"] == 80 and sum(row) == 80
    for bad in (math.inf, -math.inf, math.nan):
        assert vector(spark, rate=bad).first()["Flow Bytes/s"] == 0
    assert vector(spark, rate="text").first()["Flow Bytes/s"] == 0


def test_port_buckets_sum_to_one(spark):
    df = spark.range(0, 65536, 251).select(F.col("id").cast("string").alias("p")).unionByName(
        spark.createDataFrame([("bad",), (None,), ("1023",), ("1024",), ("49151",), ("49152",), ("65535",)], "p string"))
    flags = list(cleaning.port_buckets(F.col("p"), "X").items())
    out = df.select("p", *[e.alias(n) for n, e in flags], sum([e for _, e in flags[1:]], flags[0][1]).alias("all"))
    assert out.filter("`all` <> 1").count() == 0
    assert out.filter("p = 'bad'").first().X_WELL_KNOWN == 1


def test_infinity_takes_group_maximum(spark):
    data = [("a", math.inf), ("a", 5.0), ("a", -math.inf), ("a", None), ("a", math.nan), ("b", math.inf), ("b", None)]
    df = cleaning.clip_infinite(spark.createDataFrame(data, "g string, x double"), ["x"], ["g"])
    assert sorted((r.g, r.x) for r in df.collect()) == [("a", 0.0), ("a", 0.0), ("a", 5.0), ("a", 5.0), ("a", 5.0),
                                                         ("b", 0.0), ("b", 0.0)]


@pytest.mark.parametrize("label,want", [
    ("BENIGN", 0), (" Benign ", 0), ("DDoS", 1), ("DoS Hulk", 1), ("DDOS attack-HOIC", -1), ("DDoS attacks-LOIC-HTTP", -1),
    ("PortScan", 2), ("SSH-Bruteforce", 2), ("FTP-Patator", 2), ("Web Attack  XSS", 3), ("SQL Injection", 3), ("Bot", 4),
    ("Infiltration", -1)])
def test_class_cascade(spark, label, want):
    assert spark.range(1).select(labels.cic_class(F.lit(label))).first()[0] == want


def test_fit_and_apply_agree(spark):
    df = spark.range(300).select(
        F.col("id").alias("row_id"), F.lit("d").alias("dataset"), (F.col("id") % 2).alias("Label"),
        F.lit("DoS").alias("Attack"), (F.col("id") * 331 % 65536).alias("L4_SRC_PORT"), F.lit("443").alias("L4_DST_PORT"),
        F.lit("10.0.0.1").alias("IPV4_SRC_ADDR"), F.exp(F.col("id") % 17).alias("IN_BYTES"), (F.col("id") % 64).alias("TCP_FLAGS"))
    rows, stats, features = prep.nfv3_fit(df, ["dataset"], ["row_id"])
    again = prep.nfv3_apply(df, stats, features, ["dataset"], ["row_id"])
    pairs = rows.alias("a").join(again.alias("b"), "row_id")
    for c in features:
        assert pairs.filter(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > 1e-6).count() == 0
    assert "IPV4_SRC_ADDR" not in rows.columns and "L4_SRC_PORT" not in rows.columns
    assert "DST_PORT_WELL_KNOWN" in features


def test_csv_scan_prefers_plain_file_and_reads_windows_text(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b" id , Label \n1,Web Attack \x96 XSS\n2,BENIGN\n")
    assert files.raw_path(spark, str(tmp_path), "a.csv").endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        files.raw_path(spark, str(tmp_path), "b.csv")
    got = files.scan_csv_dir(spark, str(tmp_path), "id int, Label string", limit=1).collect()
    assert [(r.id, r.Label) for r in got] == [(1, "Web Attack – XSS")]


def test_gzip_scan(spark, tmp_path):
    import gzip
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write(" id , x\n1,Infinity\n2,3.5\n")
    df = files.scan_csv(spark, files.raw_path(spark, str(tmp_path), "c.csv"), "id int, x double")
    assert df.columns == ["id", "x"] and sorted(r.x for r in df.collect()) == [3.5, math.inf]


def test_stats_order(spark):
    stats = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord int, feature string")
    assert prep.stats_order_check(stats, stats).count() == 0
    other = spark.createDataFrame([(0, "a"), (1, "c")], "ord int, feature string")
    assert sorted(tuple(r) for r in prep.stats_order_check(stats, other).collect()) == [(1, "b", "c"), (2, "c", None)]


def test_files_with_a_defect_give_no_row_and_one_report_row(spark, tmp_path):
    lines = "id,name\n" + "".join(f"{i},n{i}\n" for i in range(3000))
    packed = gzip.compress(lines.encode())
    contents = {"good.csv": lines.encode(), "good2.csv.gz": packed, "two.csv.gz": packed + gzip.compress(b"7,seven\n"),
                "cut.csv.gz": packed[:len(packed) // 2], "crc.csv.gz": packed[:-8] + b"12345678", "junk.csv.gz": b"not gzip at all",
                "odd.csv": b"id,name\n1,caf\x81\n", "bad.csv": b"id,name\n1,a\nx,b\n", "none.csv": b"id,name\n"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    report = {r["file"].rpartition("/")[2]: r for r in files.check_files(spark, str(tmp_path), "id int, name string").collect()}
    assert {k: r["problem"] for k, r in report.items()} == {
        "good.csv": None, "good2.csv.gz": None, "two.csv.gz": None, "cut.csv.gz": "unreadable", "crc.csv.gz": "unreadable", "junk.csv.gz": "unreadable",
        "odd.csv": "encoding", "bad.csv": "records", "none.csv": "empty"}
    assert report["bad.csv"]["n_bad"] == 1 and report["good.csv"]["n_rows"] == 3000
    got = files.scan_csv_dir(spark, str(tmp_path), "id int, name string").groupBy("file").count().collect()
    assert {r["file"].rpartition("/")[2]: r["count"] for r in got} == {"good.csv": 3000, "good2.csv.gz": 3000, "two.csv.gz": 3001}
    kept = files.check_files(spark, str(tmp_path), "id int, name string", max_bad_share=0.5).where("problem is null")
    assert kept.count() == 4


def test_clipped_moments_equal_statistics_of_clipped_rows_and_merge(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 1.0, 2), ("a", inf, 3), ("a", -inf, None), ("a", nan, 5), ("b", None, 1), ("b", 7.0, 1), ("b", -3.5, 1), ("c", inf, 1), ("d", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y int")
    for logs in ([], ["x"]):
        for by in (["k"], []):
            clean = cleaning.clip_infinite(df.withColumn("y", F.col("y").cast("double")), ["x", "y"], by)
            clean = clean.withColumns({c: cleaning.log_scale(F.col(c)) for c in logs})
            keys = [*by, "feature"]
            want = {tuple(r[k] for k in keys): r for r in prep.fit_stats(clean, ["x", "y"], by).collect()}
            direct = prep.clipped_stats(df, ["x", "y"], by, logs)
            parts = prep.moments(df, ["x", "y"], ["k"], logs)
            merged = prep.clipped(prep.merge_moments(parts, by))
            for got in (direct, merged):
                found = {tuple(r[k] for k in keys): r for r in got.collect()}
                assert set(found) == set(want)
                for k, r in found.items():
                    for c in ("mean", "std", "min", "max", "n"):
                        assert r[c] == pytest.approx(want[k][c]) if want[k][c] is not None else r[c] is None
