"""Queries over training sets: splits, samples, unions, sequences, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators import cleaning, datasets, labels
from flowlake.plans.flows import NF_COLUMN_SQL, NF_REC
from flowlake.plans.registry import query, rounded
from flowlake.plans.tables import DATASETS, FIXED, NUMERIC, RF, cic_class_sql, clipped_flows, nf_records, raw_flows

SHOTS = [5, 10, 20, 50]

SPLIT_SQL = RF + """, sp AS (SELECT *, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split
 FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY dataset) AS n FROM raw_flows) q)
"""


@query("split_ordered", SPLIT_SQL + "SELECT row_id, dataset, split FROM sp")
def split_ordered(spark, sf):
    return datasets.split_ordered(raw_flows(spark, sf)).select("row_id", "dataset", "split")


HOLD = "(VALUES ('unsw'), ('bot'), ('ton'), ('cic')) h(holdout)"
LODO_SQL = RF + f""", c AS (SELECT row_id, dataset, label, holdout, row_number() OVER (PARTITION BY holdout, label ORDER BY md5('42|' || row_id), row_id) AS rn,
 count(*) OVER (PARTITION BY holdout, label) AS n FROM raw_flows, {HOLD} WHERE dataset <> holdout)
SELECT holdout, row_id, label, CASE WHEN rn <= floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM c
UNION ALL SELECT dataset, row_id, label, 'test' FROM raw_flows"""


@query("split_lodo", LODO_SQL)
def split_lodo(spark, sf):
    df = raw_flows(spark, sf).select("row_id", "dataset", "label")
    return datasets.split_leave_one_out(df, DATASETS).select("holdout", "row_id", "label", "split")


FEW_SQL = RF + """, a AS (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY md5('42|' || row_id), row_id) AS rn FROM raw_flows)
SELECT dataset AS holdout, shots, row_id, label, CASE WHEN rn <= shots THEN 'adapt' ELSE 'test' END AS part
FROM a, (VALUES (5), (10), (20), (50)) s(shots)"""


@query("split_fewshot", FEW_SQL)
def split_fewshot(spark, sf):
    df = raw_flows(spark, sf).select("row_id", "dataset", "label")
    return datasets.split_few_shot(df, SHOTS).select("holdout", "shots", "row_id", "label", "part")


@query("sample_class_balanced", RF + """, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), row_id) AS rn,
 count(*) OVER (PARTITION BY label) AS n FROM raw_flows), s AS (SELECT least(max(n), 100000) AS size FROM r),
x AS (SELECT row_id, label, rn, n, unnest(range(CAST(floor((size - rn)::DOUBLE / n) AS BIGINT) + 1)) AS turn FROM r, s WHERE rn <= size)
SELECT row_id, label, rn + turn * n AS epoch_pos FROM x""")
def sample_class_balanced(spark, sf):
    return datasets.class_balanced(raw_flows(spark, sf).select("row_id", "label")).select("row_id", "label", "epoch_pos")


RF_SAMPLE_SQL = RF + """, s AS (SELECT row_id, l4_dst_port, in_pkts, out_pkts, out_bytes, CASE WHEN lower(trim(cic_label)) = 'benign' THEN 0 ELSE 1 END AS y
 FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM raw_flows) q WHERE rn % 20 = 0 AND try_cast(l4_dst_port AS DOUBLE) IS NOT NULL)
SELECT row_id, y, CAST(l4_dst_port AS DOUBLE) AS dst_port, in_pkts FROM s WHERE (SELECT count(DISTINCT y) FROM s) >= 2"""


def adaptation_sample(df):
    """1-in-20 rows with a numeric port and a 0/1 label; empty when only one class is present."""
    sample = datasets.every_nth(df).withColumn("dst_port", cleaning.number(F.col("l4_dst_port"))).filter(
        "dst_port is not null").withColumn("y", labels.binary_label(F.col("cic_label")))
    return sample.filter(sample.agg(F.min("y") != F.max("y")).scalar())


@query("rf_adapt_sample", RF_SAMPLE_SQL)
def rf_adapt_sample(spark, sf):
    return adaptation_sample(raw_flows(spark, sf)).select("row_id", "y", "dst_port", "in_pkts")


@query("probe_sample", SPLIT_SQL + """SELECT row_id, split FROM sp WHERE dataset = 'unsw' AND ((split = 'train' AND rn <= greatest(floor(floor(n * 0.8::DOUBLE) * 0.01::DOUBLE), 100))
 OR (split = 'test' AND rn - floor(n * 0.9::DOUBLE) <= 5000))""")
def probe_sample(spark, sf):
    return datasets.probe_sample(raw_flows(spark, sf), "unsw").select("row_id", "split")


@query("silo_counts", SPLIT_SQL + "SELECT dataset, split, count(*) AS n, CAST(sum(label) AS BIGINT) AS attacks FROM sp GROUP BY dataset, split")
def silo_counts(spark, sf):
    return datasets.split_ordered(raw_flows(spark, sf)).groupBy("dataset", "split").agg(
        F.count("*").alias("n"), F.sum("label").alias("attacks"))


@query("sample_head_per_dataset", SPLIT_SQL + "SELECT row_id, dataset, rn FROM sp WHERE rn <= 100")
def sample_head_per_dataset(spark, sf):
    return datasets.head_per_group(raw_flows(spark, sf), "dataset", 100).select("row_id", "dataset", "rn")


_KEEP = ["row_id", "dataset", *NUMERIC]
_KEPT_SQL = ", ".join(f"CASE WHEN isfinite({c}) THEN {c} ELSE 0 END AS {c}" if c in NUMERIC else c for c in _KEEP)


def _finite_flows(spark, sf):
    return raw_flows(spark, sf).withColumns({c: cleaning.zero_if_not_finite(F.col(c)) for c in NUMERIC})


@query("benign_union", RF + f"SELECT {_KEPT_SQL}, row_number() OVER (ORDER BY md5('42|' || row_id), row_id) AS shuffle_pos FROM raw_flows WHERE label = 0")
def benign_union(spark, sf):
    return datasets.benign_union(_finite_flows(spark, sf)).select(*_KEEP, "shuffle_pos")


@query("benign_union_capped", RF + f""", b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42|' || row_id), row_id) AS rn FROM raw_flows WHERE label = 0)
SELECT {_KEPT_SQL}, row_number() OVER (ORDER BY md5('42|' || row_id), row_id) AS shuffle_pos FROM b WHERE rn <= 1500""")
def benign_union_capped(spark, sf):
    return datasets.benign_union(_finite_flows(spark, sf), cap=1500).select(*_KEEP, "shuffle_pos")


@query("union_datasets", RF + """SELECT row_id, dataset, CASE WHEN dataset IN ('unsw', 'bot') THEN in_pkts ELSE -1 END AS in_pkts,
 CASE WHEN dataset IN ('ton', 'cic') THEN out_pkts ELSE -1 END AS out_pkts FROM raw_flows""")
def union_datasets(spark, sf):
    df = raw_flows(spark, sf)
    primary = df.filter(F.col("dataset").isin("unsw", "bot")).select("row_id", "dataset", "in_pkts")
    secondary = df.filter(F.col("dataset").isin("ton", "cic")).select("row_id", "dataset", "out_pkts")
    both = primary.unionByName(secondary, allowMissingColumns=True)
    return both.select("row_id", "dataset", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("in_pkts", "out_pkts")])


@query("sequences10", RF + """, w AS (SELECT row_id, dataset, label, row_number() OVER o AS pos, list(out_bytes) OVER (o ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a,
 sum(in_pkts) OVER (o ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS pkts FROM raw_flows WINDOW o AS (PARTITION BY dataset ORDER BY row_id))
SELECT row_id, dataset, label, a[1] AS first_bytes, a[10] AS last_bytes, pkts, a[1] + 2 * a[2] + 3 * a[3] + 4 * a[4] + 5 * a[5] + 6 * a[6] + 7 * a[7]
 + 8 * a[8] + 9 * a[9] + 10 * a[10] AS weighted FROM w WHERE pos >= 10""")
def sequences10(spark, sf):
    seqs = datasets.sequences(raw_flows(spark, sf), ["out_bytes", "in_pkts"])
    weighted = F.aggregate(F.transform("seq", lambda v, i: v[0] * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    pkts = F.aggregate("seq", F.lit(0.0), lambda a, v: a + v[1])
    return seqs.select("row_id", "dataset", "label", F.col("seq")[0][0].alias("first_bytes"),
                       F.col("seq")[9][0].alias("last_bytes"), pkts.alias("pkts"), weighted.alias("weighted"))


@query("sequence_warmup", RF + """SELECT row_id, dataset, CASE WHEN rn < 10 THEN 'Warmup (' || rn || '/10)' ELSE 'Ready' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_id) AS rn FROM raw_flows) q""")
def sequence_warmup(spark, sf):
    return datasets.warm_up(raw_flows(spark, sf)).select("row_id", "dataset", "state")


def u_sql(seed: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || row_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def mask_sql(c: str, seed: str, x: str | None = None) -> str:
    return f"CASE WHEN {u_sql(f'{seed}|mask|{c}')} > 0.2 THEN {x or c} ELSE 0.0 END"


def noise_sql(c: str, seed: str, x: str | None = None) -> str:
    return (f"({x or c} + sqrt(-2.0::DOUBLE * ln(1.0 - {u_sql(f'{seed}|noise1|{c}')})) * "
            f"cos(2.0::DOUBLE * pi() * {u_sql(f'{seed}|noise2|{c}')}) * 0.05::DOUBLE)")


def jitter_sql(c: str, seed: str, x: str | None = None) -> str:
    return f"({x or c} * (1 + (2 * {u_sql(f'{seed}|jitter|{c}')} - 1) * 0.05::DOUBLE))"


PAIRS = [("in_bytes", "out_bytes"), ("in_pkts", "out_pkts")]
TIMING = ["flow_duration_milliseconds"]


@query("aug_mask", FIXED + "SELECT row_id, " + ", ".join(f"{mask_sql(c, '7')} AS {c}" for c in NUMERIC) + " FROM fixed")
def aug_mask(spark, sf):
    return datasets.mask_features(clipped_flows(spark, sf), NUMERIC, "7").select("row_id", *NUMERIC)


@query("aug_noise", FIXED + "SELECT row_id, " + ", ".join(f"round({noise_sql(c, '7')}, 5) AS {c}" for c in NUMERIC) + " FROM fixed")
def aug_noise(spark, sf):
    return rounded(datasets.add_noise(clipped_flows(spark, sf), NUMERIC, "7").select("row_id", *NUMERIC), 5)


RECORDS = NF_REC + ", records AS (SELECT flow_id, flow_id AS row_id, " + ", ".join(f"{NF_COLUMN_SQL[c]} AS {c}" for c in fv.NFV3_RAW_COLUMNS) + " FROM rec) "
_SWAPPED = [c for pair in fv.SWAP_PAIRS for c in pair]
_OTHER = {a: b for x, y in fv.SWAP_PAIRS for a, b in ((x, y), (y, x))}
RECORD_TIMING = fv.TIMING_COLUMNS + fv.IAT_COLUMNS


@query("aug_swap", RECORDS + "SELECT flow_id, " + ", ".join(f"CASE WHEN {u_sql('7|swap')} < 0.1 THEN {_OTHER[c]} ELSE {c} END AS {c}" for c in _SWAPPED)
       + " FROM records")
def aug_swap(spark, sf):
    """All 13 pairs of forward and backward columns of the flow records."""
    swapped = datasets.swap_directions(nf_records(spark, sf), fv.SWAP_PAIRS, "7", key="flow_id")
    return rounded(swapped.select("flow_id", *_SWAPPED), 4)


@query("aug_jitter", RECORDS + "SELECT flow_id, " + ", ".join(f"round({jitter_sql(c, '7')}, 3) AS {c}" for c in RECORD_TIMING) + " FROM records")
def aug_jitter(spark, sf):
    """The eleven timing columns of the flow records."""
    records = rounded(nf_records(spark, sf).select("flow_id", *RECORD_TIMING), 4)
    return rounded(datasets.jitter(records, RECORD_TIMING, "7", key="flow_id"), 3)


def _views_sql() -> str:
    parts = []
    for v in (1, 2):
        s = f"7|{v}"
        stage = ", ".join(f"{noise_sql(c, s, mask_sql(c, s))} AS {c}" for c in NUMERIC)
        swap = f"{u_sql(f'{s}|swap')} < 0.1"
        cols = {c: c for c in NUMERIC} | {x: f"CASE WHEN {swap} THEN {y} ELSE {x} END" for a, b in PAIRS for x, y in ((a, b), (b, a))}
        cols |= {c: jitter_sql(c, s) for c in TIMING}
        parts.append(f"SELECT row_id, {v} AS view, " + ", ".join(f"round({e}, 4) AS {c}" for c, e in cols.items())
                     + f" FROM (SELECT row_id, {stage} FROM fixed) q{v}")
    return " UNION ALL ".join(parts)


@query("aug_two_views", FIXED + _views_sql())
def aug_two_views(spark, sf):
    return rounded(datasets.two_views(clipped_flows(spark, sf), NUMERIC, PAIRS, TIMING, "7").select("row_id", "view", *NUMERIC), 4)
