"""Fit and apply feature statistics: z-score and min-max, per dataset or overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.operators.cleaning import INF, attach, clip_infinite, finite, log_scale, number, port_buckets, q
from flowlake.operators.labels import taxonomy
from flowlake.session import settle

EPS = 1e-8


def fit_stats(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Long table (by..., ord, feature, mean, std, min, max, n): one aggregation pass over all columns.

    ``std`` is the sample deviation.  Only the aggregate row is unpivoted, never the input.  The table is written:
    fitting runs once, and joins to it are planned on its real size.
    """
    by = by or []
    wide = df.groupBy(*by).agg(*[F.struct(
        F.lit(i).alias("ord"), F.lit(c).alias("feature"), F.avg(q(c)).alias("mean"), F.stddev_samp(q(c)).alias("std"),
        F.min(q(c)).alias("min"), F.max(q(c)).alias("max"), F.count(q(c)).alias("n")).alias(f"s{i}")
        for i, c in enumerate(columns)])
    return settle(wide.select(*by, F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))]))), "stats")


def moments(df: DataFrame, columns: list[str], by: list[str] | None = None, logs: list[str] = ()) -> DataFrame:
    """Long table of mergeable figures per group and column, from one aggregation pass over rows that still hold infinities.

    ``rows``, how many are infinite (``inf``) and finite (``n``), the largest finite value ``top``, and of the finite
    values, log-scaled for ``logs``: ``mean``, sum of squared deviations ``m2``, ``lo`` and ``hi``.
    """
    by = by or []

    good = {c: finite(q(c).cast("double")) for c in columns}
    plain = df.select(*by, *[good[c].alias(f"__x{i}") for i, c in enumerate(columns)],
                      *[log_scale(good[c]).alias(f"__v{i}") for i, c in enumerate(columns) if c in logs],
                      *[(F.abs(q(c).cast("double")) == INF).alias(f"__i{i}") for i, c in enumerate(columns)])
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        v = f"__v{i}" if c in logs else f"__x{i}"
        aggs += [F.count_if(f"__i{i}").alias(f"inf{i}"), F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.var_pop(v).alias(f"var{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), *([F.max(f"__x{i}").alias(f"top{i}")] if c in logs else [])]
    wide = plain.groupBy(*by).agg(*aggs)
    figures = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias("feature"), F.lit(c in logs).alias("logged"), F.col("rows"), F.col(f"inf{i}").alias("inf"),
                        F.col(f"n{i}").alias("n"), F.col(f"top{i}" if c in logs else f"hi{i}").alias("top"), F.col(f"mean{i}").alias("mean"),
                        (F.col(f"var{i}") * F.col(f"n{i}")).alias("m2"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, c in enumerate(columns)]
    return wide.select(*by, F.inline(F.array(*figures)))


def merge_moments(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Moments of the union of groups, such as datasets or days: squared deviations move to the common mean."""
    one = F.struct("n", "mean", "m2")
    merged = parts.groupBy(*(by or []), "ord", "feature", "logged").agg(
        *[F.sum(c).alias(c) for c in ("rows", "inf", "n")], F.max("top").alias("top"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.collect_list(one).alias("parts"))
    shifted = F.aggregate(F.filter("parts", lambda x: x["n"] > 0), F.lit(0.0),
                          lambda acc, x: acc + x["m2"] + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean")))
    return merged.withColumn("m2", F.when(F.col("n") > 0, shifted)).select(
        *(by or []), "ord", "feature", "logged", "rows", "inf", "n", "top", "mean", "m2", "lo", "hi")


def clipped(parts: DataFrame) -> DataFrame:
    """``mean``, ``std`` (sample), ``min``, ``max`` and ``n`` as they are once infinities have become ``top`` and missing values 0.

    The clipped values are known from their counts alone, so no second pass over the rows is needed.
    """
    top = F.coalesce("top", F.lit(0.0))
    edge = F.when(F.col("logged"), log_scale(top)).otherwise(top)
    n, k, inf, mean = F.col("rows"), F.col("n"), F.col("inf"), F.coalesce("mean", F.lit(0.0))
    missing = n - k - inf
    whole = (k * mean + inf * edge) / n
    m2 = F.coalesce("m2", F.lit(0.0)) + k * (mean - whole) * (mean - whole) + inf * (edge - whole) * (edge - whole) + missing * whole * whole
    at_edge, at_zero = F.when(inf > 0, edge), F.when(missing > 0, F.lit(0.0))
    figures = {"mean": whole, "std": F.sqrt(m2 / F.nullif(n - 1, F.lit(0))), "min": F.least("lo", at_edge, at_zero),
               "max": F.greatest("hi", at_edge, at_zero), "n": n}
    return parts.select(*[c for c in parts.columns if c not in ("rows", "inf", "n", "mean", "m2", "lo", "hi", "logged")],
                        *[e.alias(name) for name, e in figures.items()])


def clipped_stats(df: DataFrame, columns: list[str], by: list[str] | None = None, logs: list[str] = ()) -> DataFrame:
    """Statistics of the clipped (and log-scaled) columns of raw rows, in one pass, written like those of ``fit_stats``."""
    return settle(clipped(moments(df, columns, by, logs)), "stats")


def clip_and_scale(df: DataFrame, stats: DataFrame, columns: list[str], by: list[str] | None = None, logs: list[str] = ()) -> DataFrame:
    """Clip, log-scale and z-score raw rows with the statistics of their group, in one projection."""
    by = by or []
    joined = attach(df, stats_as_columns(stats, by, columns, ("top", "mean", "std")), by)

    def scaled(c: str) -> Column:
        x = q(c).cast("double")
        value = F.coalesce(F.when(F.abs(x) < INF, x).when(F.abs(x) == INF, q(f"top_{c}")), F.lit(0.0))
        return ((log_scale(value) if c in logs else value) - q(f"mean_{c}")) / (q(f"std_{c}") + EPS)

    return joined.withColumns({c: scaled(c) for c in columns}).drop(*[f"{k}_{c}" for c in columns for k in ("top", "mean", "std")])


def stats_as_columns(stats: DataFrame, by: list[str], columns: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """One row per group with columns ``kind_feature``, ready to join to rows."""
    return stats.groupBy(*by).agg(*[F.max(F.when(F.col("feature") == c, F.col(k))).alias(f"{k}_{c}")
                                    for c in columns for k in kinds])


def apply_zscore(df: DataFrame, stats: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(x - mean) / (std + eps)`` with the statistics of the row's group."""
    by = by or []
    wide = stats_as_columns(stats, by, columns, ("mean", "std"))
    joined = attach(df, wide, by)
    scaled = {c: (q(c) - q(f"mean_{c}")) / (q(f"std_{c}") + EPS) for c in columns}
    return joined.withColumns(scaled).drop(*[f"{k}_{c}" for c in columns for k in ("mean", "std")])


def apply_minmax(df: DataFrame, stats: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``(x - min) / (max - min)``; a constant column divides by 1."""
    by = by or []
    wide = stats_as_columns(stats, by, columns, ("min", "max"))
    joined = attach(df, wide, by)

    def scaled(c: str) -> Column:
        span = q(f"max_{c}") - q(f"min_{c}")
        return (q(c) - q(f"min_{c}")) / F.when(span == 0, 1.0).otherwise(span)

    return joined.withColumns({c: scaled(c) for c in columns}).drop(
        *[f"{k}_{c}" for c in columns for k in ("min", "max")])


def nfv3_numbers(raw: DataFrame, by: list[str], keep: list[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """Raw flows to numbers: port buckets, drops, taxonomy; infinities stay.

    Columns are matched by name without regard to case.  Returns the table, its feature names and those to be log-scaled.
    """
    names = {c.upper(): c for c in raw.columns}
    buckets = {}
    for side in ("SRC", "DST"):
        if f"L4_{side}_PORT" in names:
            buckets |= port_buckets(q(names[f"L4_{side}_PORT"]), f"{side}_PORT")
    df = raw.withColumns(buckets)
    drop = [names[c] for c in fv.NFV3_DROP_COLUMNS if c in names]
    if "ATTACK" in names:
        df = df.withColumn(names["ATTACK"], taxonomy(q(names["ATTACK"])))
    df = df.drop(*drop)
    other = {*by, *keep, *[names[c] for c in ("LABEL", "ATTACK") if c in names]}
    features = [c for c in df.columns if c not in other]
    text = {n for n, t in df.dtypes if t == "string"}
    df = df.withColumns({c: number(q(c)) if c in text else q(c).cast("double") for c in features})
    return df, features, [c for c in features if c.upper() in fv.LOG_COLUMNS]


def nfv3_clean(raw: DataFrame, by: list[str], keep: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Raw flows to finite, log-scaled features.  Infinities take the largest finite value of the whole dataset."""
    df, features, logs = nfv3_numbers(raw, by, keep)
    return clip_infinite(df, features, by).withColumns({c: log_scale(q(c)) for c in logs}), features


def nfv3_fit(raw: DataFrame, by: list[str], keep: list[str] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """Fit z-scores per dataset and transform: (rows with float features, stats, feature names).

    The raw rows are read twice, for the statistics and for the result.
    """
    df, features, logs = nfv3_numbers(raw, by, keep)
    stats = clipped_stats(df, features, by, logs)
    scaled = clip_and_scale(df, stats, features, by, logs)
    return scaled.withColumns({c: q(c).cast("float") for c in features}), stats, features


def nfv3_apply(raw: DataFrame, stats: DataFrame, features: list[str], by: list[str], keep: list[str] = ()) -> DataFrame:
    """Transform with saved statistics; a feature absent from ``raw`` is 0 before log scaling and z-score."""
    clean, have = nfv3_clean(raw, by, keep)
    clean = clean.withColumns({c: F.lit(0.0) for c in features if c not in have})
    scaled = apply_zscore(clean, stats, features, by)
    rest = [c for c in scaled.columns if c not in have and c not in features]
    return scaled.select(*rest, *[q(c).cast("float").alias(c) for c in features])


def stats_order_check(stats: DataFrame, expected: DataFrame) -> DataFrame:
    """Positions where saved feature order and the expected list (ord, feature) differ."""
    a = stats.select("ord", F.col("feature").alias("saved"))
    b = expected.select("ord", F.col("feature").alias("expected"))
    return a.join(b, "ord", "full").filter(~F.col("saved").eqNullSafe(F.col("expected")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weights scaled to sum to the number of classes."""
    counts = df.groupBy(label).agg(F.count("*").alias("n")).withColumn("raw", 1.0 / (F.col("n") + EPS))
    all_ = Window.partitionBy()
    return counts.select(label, "n", (F.col("raw") / F.sum("raw").over(all_) * F.count("*").over(all_)).alias("weight"))
