"""Queries over raw flows: scans and sinks, cleaning, labels, statistics, preprocessing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators import cic, cleaning, datasets, labels, nfv3_features, nfv3_segments, prep
from flowlake.plans.derived import cte, table
from flowlake.plans.flows import CIC_COLUMN_SQL, CIC_SEG, NF_COLUMN_SQL, NF_REC, snake
from flowlake.plans.registry import query, rounded
from flowlake.session import new_path, settle
from flowlake.sources import files

RF = cte("raw_flows")
RAW_SCHEMA = ("row_id long, ipv4_src_addr string, l4_src_port string, l4_dst_port string, protocol int, "
              "in_bytes double, out_bytes double, in_pkts double, out_pkts double, "
              "flow_duration_milliseconds double, label int, attack string, cic_label string")
NUMERIC = ["in_bytes", "out_bytes", "in_pkts", "out_pkts", "flow_duration_milliseconds"]
DATASETS = list(fv.DATASETS)


def raw_flows(spark, sf):
    return table(spark, sf, "raw_flows")


# ---- scans and sinks ------------------------------------------------------------------------------------------

@query("scan_csv_trim", RF + "SELECT row_id, trim(attack) AS attack, out_bytes, l4_dst_port FROM raw_flows")
def scan_csv_trim(spark, sf):
    path = new_path(spark, "csv")
    padded = raw_flows(spark, sf).select(*[F.col(c).alias(f" {c} ") for c in
                                           ("row_id", "attack", "out_bytes", "l4_dst_port")])
    padded.write.options(**files.CSV_OPTIONS).csv(path)
    df = files.scan_csv(spark, path, "` row_id ` long, ` attack ` string, ` out_bytes ` double, ` l4_dst_port ` string")
    return df.withColumn("attack", F.trim("attack"))


def _csv_folder(spark, sf):
    path = new_path(spark, "csv-dir")
    df = raw_flows(spark, sf)
    (df.repartitionByRange(8, "dataset", "row_id").sortWithinPartitions("dataset", "row_id")
     .write.options(**files.CSV_OPTIONS, maxRecordsPerFile=10_000_000).partitionBy("dataset").csv(path))
    return path


@query("scan_dir_limit_per_file", RF + """SELECT dataset, part, count(*) AS n_rows, min(row_id) AS first_id, max(row_id) AS last_id FROM (
 SELECT dataset, row_id // 16 % 16 AS part, row_id, row_number() OVER (PARTITION BY dataset, row_id // 16 % 16 ORDER BY row_id) AS rn FROM raw_flows) q
WHERE rn <= 100 GROUP BY dataset, part""")
def scan_dir_limit_per_file(spark, sf):
    path = new_path(spark, "csv-dir")
    parted = raw_flows(spark, sf).withColumn("part", F.expr("row_id DIV 16 % 16"))
    (parted.repartition("dataset", "part").sortWithinPartitions("dataset", "part", "row_id")
     .write.options(**files.CSV_OPTIONS).partitionBy("dataset", "part").csv(path))
    df = files.scan_csv_dir(spark, path, RAW_SCHEMA, limit=100)
    return df.groupBy(F.regexp_extract("file", "dataset=([^/]+)", 1).alias("dataset"),
                      F.regexp_extract("file", "part=([^/]+)", 1).cast("long").alias("part")).agg(
        F.count("*").alias("n_rows"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))


@query("scan_dir_quarantine", RF + """SELECT dataset AS name, CAST(NULL AS VARCHAR) AS problem, count(*) AS n_rows, sum(row_id)::BIGINT AS ids FROM raw_flows GROUP BY dataset
UNION ALL SELECT * FROM (VALUES ('cut', 'unreadable', 0, 0), ('odd', 'encoding', 0, 0), ('short', 'records', 0, 0)) b""")
def scan_dir_quarantine(spark, sf):
    """A folder of sound gzip files, and three that are not: cut off, of another encoding, with lines that don't fit."""
    path, df = new_path(spark, "csv-quarantine"), raw_flows(spark, sf)
    schema = RAW_SCHEMA.replace("row_id long,", "row_id long, dataset string,")
    out = lambda rows, name, **more: rows.write.options(**files.CSV_OPTIONS, **more).csv(f"{path}/{name}")
    out(df.repartitionByRange(8, "dataset", "row_id"), "sound", compression="gzip")
    some = df.where("dataset = 'unsw'")
    out(some.withColumn("attack", F.concat("attack", F.lit("\x81"))).coalesce(1), "odd", encoding="ISO-8859-1")
    out(some.withColumn("row_id", F.concat(F.lit("no. "), "row_id")).coalesce(1), "short")
    whole = files.file_sizes(spark, f"{path}/sound", "*.csv.gz").orderBy(F.desc("length")).first()
    files.copy_part(whole["path"], f"{path}/cut/part-0.csv.gz", whole["length"] // 2)
    report = settle(files.check_files(spark, path, schema), "file-report")
    read = files.scan_csv_dir(spark, path, schema, report=report)
    bad = report.where("problem is not null").select(F.regexp_extract("file", "/(cut|odd|short)/", 1).alias("name"), "problem")
    lost = read.where(F.regexp_extract("file", "/(cut|odd|short)/", 1) != "").count()
    return read.groupBy(F.col("dataset").alias("name"), F.lit(None).cast("string").alias("problem")).agg(
        F.count("*").alias("n_rows"), F.sum("row_id").alias("ids")).unionByName(
        bad.select("name", "problem", F.lit(lost).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("ids")))


SCHEMAS = {  # columns wanted of each table; one of each is not there, and others are there that nobody asks for
    "orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_attack"],
    "lineitem": ["l_orderkey", "l_quantity", "l_attack"],
    "customer": ["c_custkey", "c_name", "c_attack"],
    "events": ["event_id", "user_id", "ts", "attack"],
}
HAVE = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "lineitem": ["l_orderkey", "l_quantity"],
        "customer": ["c_custkey", "c_name"], "events": ["event_id", "user_id", "ts"]}


@query("schema_compat_report", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'missing' AS status, 0::BIGINT AS n_values" for t, cs in SCHEMAS.items()
    for c in cs if c not in HAVE[t]) + "".join(
    f" UNION ALL SELECT '{t}', column_name, CASE WHEN column_name IN ({', '.join(repr(c) for c in cs)}) THEN 'present' ELSE 'extra' END, n "
    f"FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE n)" for t, cs in SCHEMAS.items()))
def schema_compat_report(spark, sf):
    reports = [files.schema_report(spark.read.parquet(f"{sf}/{t}.parquet"), want).select(F.lit(t).alias("table_name"), "*")
               for t, want in SCHEMAS.items()]
    return reduce(DataFrame.unionByName, reports)


@query("dataset_report", RF + """SELECT dataset, count(*) AS n_rows, 13 AS n_cols, true AS columns_match,
 true AS label_present FROM raw_flows GROUP BY dataset""")
def dataset_report(spark, sf):
    report = files.dataset_report(spark, _csv_folder(spark, sf), RAW_SCHEMA, ["row_id", "label", *NUMERIC], "label")
    return report.filter("size_mb > 0").drop("size_mb")


@query("scan_parquet", "SELECT * FROM orders")
def scan_parquet(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


@query("sample_every_20th", RF + """SELECT row_id, dataset, out_bytes FROM (
 SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM raw_flows) q WHERE rn % 20 = 0""")
def sample_every_20th(spark, sf):
    return datasets.every_nth(raw_flows(spark, sf)).select("row_id", "dataset", "out_bytes")


# ---- cleaning -------------------------------------------------------------------------------------------------

def clean_sql(by: str | None = "dataset", taken: str = "raw_flows", features: list[str] | None = None) -> str:
    """CTEs ``cleaned``: numbers, infinity to the largest finite value, null to 0, log scaling, port buckets."""
    features = features or NUMERIC
    part = f"PARTITION BY {by}" if by else ""
    top = {c: f"max(CASE WHEN isfinite({c}) THEN {c} END) OVER ({part})" for c in features}
    fix = ", ".join(f"CASE WHEN isinf({c}) THEN coalesce({top[c]}, 0) WHEN isfinite({c}) THEN {c} ELSE 0 END AS {c}"
                    for c in features)
    logs = ", ".join(f"ln(1 + abs({c})) AS {c}" for c in features)
    buckets = ", ".join(
        f"CASE WHEN coalesce(try_cast(l4_{s}_port AS BIGINT), 0) BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END AS {s.upper()}_PORT_{n}"
        for s in ("src", "dst") for n, (lo, hi) in fv.PORT_BUCKETS.items())
    return (f"fixed AS (SELECT row_id, dataset, label, trim(attack) AS attack, protocol::DOUBLE AS protocol, {buckets}, {fix} FROM {taken}), "
            f"cleaned AS (SELECT row_id, dataset, label, protocol, {', '.join(fv.PORT_BUCKET_COLUMNS)}, {logs} FROM fixed)\n")


INPUTS = ["protocol", *NUMERIC, *fv.PORT_BUCKET_COLUMNS]


def clipped_flows(spark, sf):
    """Raw flows without infinities, NaN and nulls in the numeric columns."""
    return cleaning.clip_infinite(raw_flows(spark, sf), NUMERIC, ["dataset"])


@query("clean_inf_to_max", RF + ", " + clean_sql() + "SELECT row_id, " + ", ".join(NUMERIC) + " FROM fixed")
def clean_inf_to_max(spark, sf):
    return cleaning.clip_infinite(raw_flows(spark, sf), NUMERIC, ["dataset"]).select("row_id", *NUMERIC)


@query("clean_inf_to_zero", RF + "SELECT row_id, CASE WHEN isfinite(in_bytes) THEN in_bytes ELSE 0 END AS in_bytes FROM raw_flows")
def clean_inf_to_zero(spark, sf):
    return raw_flows(spark, sf).select("row_id", cleaning.zero_if_not_finite(F.col("in_bytes")).alias("in_bytes"))


@query("clean_fill_train_max", RF + ", m AS (SELECT " + ", ".join(f"max(CASE WHEN isfinite({c}) THEN {c} END) AS mx_{c}" for c in NUMERIC)
       + " FROM raw_flows WHERE dataset = 'unsw') SELECT row_id, " + ", ".join(
           f"CASE WHEN isfinite({c}) THEN {c} ELSE coalesce(mx_{c}, 0) END AS {c}" for c in NUMERIC) + " FROM raw_flows, m WHERE dataset <> 'unsw'")
def clean_fill_train_max(spark, sf):
    df = raw_flows(spark, sf)
    train_max = cleaning.finite_max(df.filter("dataset = 'unsw'"), NUMERIC)
    return cleaning.fill_with_max(df.filter("dataset <> 'unsw'"), NUMERIC, train_max, []).select("row_id", *NUMERIC)


@query("coerce_numeric", RF + """SELECT row_id, coalesce(try_cast(l4_dst_port AS DOUBLE), -1) AS dst_port,
 coalesce(try_cast(l4_src_port AS DOUBLE), -1) AS src_port FROM raw_flows""")
def coerce_numeric(spark, sf):
    number = lambda c: F.coalesce(cleaning.number(F.col(c)), F.lit(-1.0))
    return raw_flows(spark, sf).select("row_id", number("l4_dst_port").alias("dst_port"),
                                       number("l4_src_port").alias("src_port"))


@query("port_buckets", RF + ", " + clean_sql() + "SELECT row_id, " + ", ".join(fv.PORT_BUCKET_COLUMNS) + " FROM fixed")
def port_buckets(spark, sf):
    return raw_flows(spark, sf).select(
        "row_id", *[e.alias(n) for side in ("src", "dst") for n, e in
                    cleaning.port_buckets(F.col(f"l4_{side}_port"), f"{side.upper()}_PORT").items()])


@query("log1p_features", RF + ", " + clean_sql() + "SELECT row_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in NUMERIC) + " FROM cleaned")
def log1p_features(spark, sf):
    return rounded(clipped_flows(spark, sf).select("row_id", *[cleaning.log_scale(F.col(c)).alias(c) for c in NUMERIC]))


@query("nan_ratio_flags", RF + "".join(
    f"{' UNION ALL ' if i else ''}SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL OR isnan({c}) THEN 1 ELSE 0 END), 6) AS share, "
    f"avg(CASE WHEN {c} IS NULL OR isnan({c}) THEN 1 ELSE 0 END) > 0.005 AS flagged FROM raw_flows"
    for i, c in enumerate(NUMERIC)))
def nan_ratio_flags(spark, sf):
    return rounded(cleaning.flag_sparse(raw_flows(spark, sf), NUMERIC, max_share=0.005))


CIC_SHORT = ["Dst Port", "Tot Fwd Pkts", "Tot Bwd Pkts", "Flow Byts/s", "Flow Pkts/s"]


@query("cic_rename_align", RF + "SELECT row_id, " + ", ".join(
    f"{ {'Dst Port': 'coalesce(try_cast(l4_dst_port AS DOUBLE), 0)', 'Tot Fwd Pkts': 'in_pkts', 'Tot Bwd Pkts': 'out_pkts'}.get(k, '0.0::DOUBLE')} AS {snake(v)}"
    for k, v in fv.CIC_SCORER_NAMES.items()) + " FROM raw_flows")
def cic_rename_align(spark, sf):
    short = raw_flows(spark, sf).select(
        "row_id", cleaning.zero_if_not_finite(cleaning.number(F.col("l4_dst_port"))).alias("Dst Port"),
        F.col("in_pkts").alias("Tot Fwd Pkts"), F.col("out_pkts").alias("Tot Bwd Pkts"),
        F.col("attack").alias("an extra column"))
    wanted = list(fv.CIC_SCORER_NAMES.values())
    out = cleaning.align(cleaning.rename(short, fv.CIC_SCORER_NAMES), ["row_id", *wanted])
    return out.toDF("row_id", *[snake(c) for c in wanted])


_NAMES_2017 = {c: {**fv.CIC_SCORER_NAMES, **fv.CIC_2018_ONLY_NAMES}.get(c, c) for c in CIC_COLUMN_SQL if c != "Fwd Header Length.1"}


@query("cic2018_to_2017", CIC_SEG + "SELECT flow_key, seg, " + ", ".join(f"{CIC_COLUMN_SQL[c]} AS {snake(n)}" for c, n in _NAMES_2017.items())
       + f", {CIC_COLUMN_SQL['Fwd Header Len']} AS fwd_header_length_1 FROM seg GROUP BY flow_key, seg")
def cic2018_to_2017(spark, sf):
    """Whole records under the names of 2018, every other one with the blank that files have, to the names of 2017."""
    flows = rounded(cic.cic_record(cic.cic_segments(table(spark, sf, "packets"))), 4).drop("Fwd Header Length.1")
    padded = flows.toDF(*[f" {c}" if i % 2 else c for i, c in enumerate(flows.columns)])
    out = cleaning.to_2017_names(padded)
    return out.toDF(*[snake(c) for c in out.columns])


# ---- labels ---------------------------------------------------------------------------------------------------

@query("label_binary", RF + "SELECT row_id, CASE WHEN lower(trim(coalesce(attack, 'Benign'))) = 'benign' THEN 0 ELSE 1 END AS y FROM raw_flows")
def label_binary(spark, sf):
    return raw_flows(spark, sf).select("row_id", labels.binary_label(F.col("attack")).alias("y"))


@query("label_ground_truth", RF + """SELECT row_id, coalesce(CASE WHEN row_id % 2 = 0 THEN attack END,
 CASE WHEN label = 0 THEN 'Benign' ELSE 'Attack' END) AS truth FROM raw_flows""")
def label_ground_truth(spark, sf):
    attack = F.when(F.col("row_id") % 2 == 0, F.col("attack"))
    return raw_flows(spark, sf).select("row_id", labels.ground_truth(attack, F.col("label")).alias("truth"))


def cic_class_sql(col: str) -> str:
    t, u = f"trim({col})", f"upper(trim({col}))"
    exact = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fv.CIC_EXACT_LABELS.items())
    rules = " ".join("WHEN " + " OR ".join(f"contains({u}, '{w}')" for w in ws) + f" THEN {v}"
                     for ws, v in fv.CIC_LABEL_RULES)
    return f"coalesce(CASE {t} {exact} END, CASE {u} {exact} END, CASE {rules} ELSE -1 END)"


@query("label_cic_cascade", RF + f"""SELECT * FROM (SELECT row_id, {cic_class_sql('cic_label')} AS cls FROM raw_flows) q WHERE cls <> -1""")
def label_cic_cascade(spark, sf):
    return raw_flows(spark, sf).select("row_id", labels.cic_class(F.col("cic_label")).alias("cls")).filter("cls <> -1")


_GROUPS = " ".join(f"WHEN '{s}' THEN '{g}'" for g, ss in fv.ATTACK_GROUPS.items() for s in ss)


@query("label_taxonomy", RF + f"""SELECT row_id, coalesce(CASE trim(attack) {_GROUPS} END, trim(attack)) AS family,
 coalesce(CASE trim(attack) {_GROUPS} END, 'Other') AS family_or_other FROM raw_flows""")
def label_taxonomy(spark, sf):
    return raw_flows(spark, sf).select("row_id", labels.taxonomy(F.col("attack")).alias("family"),
                                       labels.taxonomy(F.col("attack"), "Other").alias("family_or_other"))


@query("label_index", RF + """, d AS (SELECT attack, row_number() OVER (ORDER BY attack) - 1 AS label_idx FROM (SELECT DISTINCT attack FROM raw_flows) q)
SELECT row_id, attack, label_idx FROM raw_flows JOIN d USING (attack)""")
def label_index(spark, sf):
    return labels.label_index(raw_flows(spark, sf), "attack").select("row_id", "attack", "label_idx")


@query("class_weights", RF + """, c AS (SELECT attack, count(*) AS n, 1.0::DOUBLE / (count(*) + 1e-8::DOUBLE) AS raw FROM raw_flows GROUP BY attack)
SELECT attack, n, round(raw / sum(raw) OVER () * count(*) OVER (), 6) AS weight FROM c""")
def class_weights(spark, sf):
    return rounded(prep.class_weights(raw_flows(spark, sf), "attack"))


@query("label_distribution", RF + "SELECT dataset, label, trim(attack) AS attack, count(*) AS n FROM raw_flows GROUP BY ALL")
def label_distribution(spark, sf):
    return raw_flows(spark, sf).groupBy("dataset", "label", F.trim("attack").alias("attack")).agg(F.count("*").alias("n"))


# ---- statistics and preprocessing -----------------------------------------------------------------------------

FIXED = RF + ", " + clean_sql()


def _long_stats(select: str) -> str:
    return " UNION ALL ".join(f"SELECT dataset, '{c}' AS feature, {select.format(c=c)} FROM fixed GROUP BY dataset" for c in NUMERIC)


@query("fit_zscore_stats", FIXED + _long_stats("round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, count({c}) AS n"))
def fit_zscore_stats(spark, sf):
    return rounded(prep.clipped_stats(raw_flows(spark, sf), NUMERIC, ["dataset"]).select("dataset", "feature", "mean", "std", "n"), 4)


@query("fit_minmax_stats", FIXED + _long_stats("min({c}) AS min, max({c}) AS max"))
def fit_minmax_stats(spark, sf):
    return prep.clipped_stats(raw_flows(spark, sf), NUMERIC, ["dataset"]).select("dataset", "feature", "min", "max")


@query("stats_summary", FIXED + f""", s AS ({_long_stats("avg({c}) AS mean, stddev_samp({c}) AS std")})
SELECT dataset, count(*) AS features, round(min(mean), 4) AS mean_min, round(max(mean), 4) AS mean_max,
 round(min(std), 4) AS std_min, round(max(std), 4) AS std_max FROM s GROUP BY dataset""")
def stats_summary(spark, sf):
    return rounded(prep.clipped_stats(raw_flows(spark, sf), NUMERIC, ["dataset"]).groupBy("dataset").agg(
        F.count("*").alias("features"), F.min("mean").alias("mean_min"), F.max("mean").alias("mean_max"),
        F.min("std").alias("std_min"), F.max("std").alias("std_max")), 4)


@query("stats_roundtrip", RF + ", " + clean_sql(None) + " UNION ALL ".join(
    f"SELECT {i} AS ord, '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM fixed"
    for i, c in enumerate(NUMERIC)))
def stats_roundtrip(spark, sf):
    """Moments per dataset are saved, read back and merged; clipping follows the largest value of all datasets."""
    path = new_path(spark, "stats")
    prep.moments(raw_flows(spark, sf), NUMERIC, ["dataset"]).write.parquet(path)
    merged = prep.clipped(prep.merge_moments(spark.read.parquet(path)))
    return rounded(merged.orderBy("ord").select("ord", "feature", "mean", "std"), 4)


@query("stats_order_check", """WITH a AS (SELECT row_number() OVER (ORDER BY column_name) AS ord, column_name AS saved FROM (DESCRIBE orders)),
b AS (SELECT row_number() OVER (ORDER BY column_name DESC) AS ord, column_name AS expected FROM (DESCRIBE orders))
SELECT ord, saved, expected FROM a FULL JOIN b USING (ord) WHERE saved IS DISTINCT FROM expected""")
def stats_order_check(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    names = sorted(df.columns)
    saved = prep.fit_stats(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
                           .select(*[F.length(c).cast("double").alias(c) for c in df.columns]), names)
    saved = saved.withColumn("ord", (F.col("ord") + 1).cast("long"))
    expected = spark.createDataFrame([(i + 1, c) for i, c in enumerate(reversed(names))], "ord long, feature string")
    return prep.stats_order_check(saved, expected)


def zscore_sql(by: str | None, columns: list[str], taken: str = "cleaned") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return ", ".join(f"round(CAST(({c} - avg({c}) OVER ({part})) / (stddev_samp({c}) OVER ({part}) + 1e-8::DOUBLE) AS FLOAT)::DOUBLE, 4) AS {c}"
                     for c in columns)


FIT_SQL = RF + ", " + clean_sql() + f"SELECT row_id, dataset, label, {zscore_sql('dataset', INPUTS)} FROM cleaned"


def _inputs(df):
    return df.select("row_id", "dataset", "protocol", "label", "attack", "l4_src_port", "l4_dst_port", "ipv4_src_addr", *NUMERIC)


def _fit(spark, sf):
    raw = _inputs(raw_flows(spark, sf)).withColumnRenamed("ipv4_src_addr", "IPV4_SRC_ADDR")
    return prep.nfv3_fit(raw, ["dataset"], ["row_id"])


def _floats(df, columns):
    return df.select("row_id", "dataset", "label", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in columns])


@query("nfv3_preprocess_fit", FIT_SQL)
def nfv3_preprocess_fit(spark, sf):
    return _floats(_fit(spark, sf)[0], INPUTS)


@query("write_processed_roundtrip", FIT_SQL)
def write_processed_roundtrip(spark, sf):
    rows, _, features = _fit(spark, sf)
    path = new_path(spark, "processed")
    files.write_processed(rows, path, features, ["row_id", "label", "attack"])
    return _floats(spark.read.parquet(path), INPUTS)


_APPLY = [c for c in INPUTS if c != "flow_duration_milliseconds"]


@query("nfv3_preprocess_apply", RF + ", " + clean_sql(None) + ", st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in INPUTS) + " FROM cleaned) SELECT row_id, dataset, label, " + ", ".join(
    f"round(CAST(({c} - m_{c}) / (s_{c} + 1e-8::DOUBLE) AS FLOAT)::DOUBLE, 4) AS {c}" for c in _APPLY)
    + ", round(CAST((0 - m_flow_duration_milliseconds) / (s_flow_duration_milliseconds + 1e-8::DOUBLE) AS FLOAT)::DOUBLE, 4) AS flow_duration_milliseconds FROM cleaned, st")
def nfv3_preprocess_apply(spark, sf):
    raw = _inputs(raw_flows(spark, sf)).withColumnRenamed("ipv4_src_addr", "IPV4_SRC_ADDR")
    _, stats, features = prep.nfv3_fit(raw, [], ["row_id", "dataset"])
    later = raw.drop("flow_duration_milliseconds")
    return _floats(prep.nfv3_apply(later, stats, features, [], ["row_id", "dataset"]), INPUTS)


@query("preprocess_all", RF + ", " + clean_sql() + f""", z AS (SELECT dataset, label, {zscore_sql('dataset', ['out_bytes', 'in_pkts'])} FROM cleaned)
SELECT dataset, count(*) AS n_rows, round(avg(out_bytes), 3) AS out_bytes, round(avg(in_pkts), 3) AS in_pkts FROM z GROUP BY dataset
UNION ALL SELECT 'combined_benign', count(*), round(avg(out_bytes), 3), round(avg(in_pkts), 3) FROM z WHERE label = 0""")
def preprocess_all(spark, sf):
    """Sums per dataset and label first; the union of all benign rows adds some of them up."""
    rows, _, _ = _fit(spark, sf)
    columns = ["out_bytes", "in_pkts"]
    parts = settle(rows.groupBy("dataset", "label").agg(
        F.count("*").alias("n_rows"), *[F.sum(F.round(F.col(c).cast("double"), 4)).alias(c) for c in columns]), "preprocessed-sums")
    means = [F.sum("n_rows").alias("n_rows"), *[(F.round(F.sum(c) / F.sum("n_rows"), 3) + 0.0).alias(c) for c in columns]]
    return parts.groupBy("dataset").agg(*means).unionByName(
        parts.filter("label = 0").groupBy(F.lit("combined_benign").alias("dataset")).agg(*means))


# ---- preprocessing of whole flow records ----------------------------------------------------------------------

def nf_records(spark, sf):
    """Flow records of all packets, with every column."""
    return nfv3_features.nfv3_record(nfv3_segments.segment_flows(table(spark, sf, "packets")))


def record_inputs_sql() -> str:
    """CTE ``inputs``: the 47 columns of a flow record that models read, log-scaled where they are, and six port buckets."""
    def value(c: str) -> str:
        return f"ln(1 + abs({c})) AS {c}" if c in fv.LOG_COLUMNS else f"{c}::DOUBLE AS {c}"
    buckets = [f"(L4_{s}_PORT BETWEEN {lo} AND {hi})::INT::DOUBLE AS {s}_PORT_{n}" for s in ("SRC", "DST") for n, (lo, hi) in fv.PORT_BUCKETS.items()]
    record = ", ".join(f"{NF_COLUMN_SQL[c]} AS {c}" for c in fv.NFV3_RAW_COLUMNS)
    return NF_REC + f""", records AS (SELECT flow_id, {record} FROM rec),
inputs AS (SELECT flow_id, {', '.join([value(c) for c in fv.NFV3_MODEL_COLUMNS] + buckets)} FROM records)
"""


RECORD_INPUTS = record_inputs_sql()


@query("record_stats", RECORD_INPUTS + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(min({c}), 3) AS min, round(max({c}), 3) AS max, count(*) AS n FROM inputs"
    for c in fv.NFV3_INPUT_COLUMNS))
def record_stats(spark, sf):
    """Statistics of all 53 model inputs of the flow records."""
    df, features, logs = prep.nfv3_numbers(rounded(nf_records(spark, sf), 4), [], ["flow_id"])
    return rounded(prep.clipped_stats(df, features, [], logs).select("feature", "mean", "std", "min", "max", "n"), 3)


@query("record_preprocess", RECORD_INPUTS + "SELECT flow_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER () + 1e-8::DOUBLE), 3) + 0.0 AS {c}" for c in fv.NFV3_INPUT_COLUMNS) + " FROM inputs")
def record_preprocess(spark, sf):
    """All 53 model inputs, fitted and transformed; the records are assembled once."""
    records = settle(rounded(nf_records(spark, sf), 4), "records")
    df, features, logs = prep.nfv3_numbers(records, [], ["flow_id"])
    rows = prep.clip_and_scale(df, prep.clipped_stats(df, features, [], logs), features, [], logs)
    return rows.select("flow_id", *[(F.round(F.col(c), 3) + 0.0).alias(c) for c in fv.NFV3_INPUT_COLUMNS])


@query("cic_preprocess", RF + f""", known AS (SELECT row_id, dataset, {cic_class_sql('cic_label')} AS cls, {', '.join(
    f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in NUMERIC)} FROM raw_flows),
filled AS (SELECT row_id, dataset, cls, {', '.join(f"coalesce({c}, max({c}) OVER (), 0) AS {c}" for c in NUMERIC)} FROM known WHERE cls <> -1),
scaled AS (SELECT row_id, dataset, cls, {', '.join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in NUMERIC)} FROM filled),
win AS (SELECT row_id, dataset, cls, row_number() OVER w AS pos, {', '.join(f"sum({c}) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS {c}" for c in NUMERIC)}
 FROM scaled WINDOW w AS (PARTITION BY dataset ORDER BY row_id))
SELECT row_id, dataset, cls, round({' + '.join(NUMERIC)}, 4) AS digest FROM win WHERE pos >= 10""")
def cic_preprocess(spark, sf):
    df = raw_flows(spark, sf).withColumn("cls", labels.cic_class(F.col("cic_label"))).filter("cls <> -1").select(
        "row_id", "dataset", "cls", *[cleaning.number(F.col(c)).alias(c) for c in NUMERIC])
    filled = cleaning.fill_with_max(df, NUMERIC, cleaning.finite_max(df, NUMERIC), [])
    scaled = prep.apply_minmax(filled, prep.fit_stats(filled, NUMERIC), NUMERIC)
    seqs = datasets.sequences(scaled, NUMERIC)
    digest = F.aggregate(F.flatten("seq"), F.lit(0.0), lambda a, x: a + x)
    return seqs.select("row_id", "dataset", "cls", F.round(digest, 4).alias("digest"))


_VEC = {k: v for k, v in fv.CIC_SCORER_NAMES.items()}


@query("cic_vector", CIC_SEG + ", fl AS (SELECT flow_key, seg, " + ", ".join(
    f"CAST({CIC_COLUMN_SQL[k]} AS FLOAT)::DOUBLE AS {snake(v)}" for k, v in _VEC.items()) + " FROM seg GROUP BY flow_key, seg) SELECT flow_key, seg, "
    + ", ".join(f"round(({snake(v)} - min({snake(v)}) OVER ()) / (CASE WHEN max({snake(v)}) OVER () = min({snake(v)}) OVER () THEN 1 ELSE "
                f"max({snake(v)}) OVER () - min({snake(v)}) OVER () END), 3) AS {snake(v)}" for v in _VEC.values()) + " FROM fl")
def cic_vector(spark, sf):
    flows = rounded(cic.cic_record(cic.cic_segments(table(spark, sf, "packets"))), 4)
    named = cleaning.align(cleaning.rename(flows, fv.CIC_SCORER_NAMES), ["flow_key", "seg", *_VEC.values()])
    plain = named.toDF("flow_key", "seg", *[snake(v) for v in _VEC.values()])
    names = [snake(v) for v in _VEC.values()]
    vec = plain.select("flow_key", "seg", *[cleaning.zero_if_not_finite(
        cleaning.number(F.col(c)).cast("float").cast("double")).alias(c) for c in names])
    return rounded(prep.apply_minmax(vec, prep.fit_stats(vec, names), names), 3)
