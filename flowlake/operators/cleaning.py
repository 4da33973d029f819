"""Cleaning: name trimming, alignment, numeric coercion, infinities and nulls, port buckets, log scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake import fixed_values as fv
from flowlake.session import settle, single_row

INF = float("inf")


def q(name: str) -> Column:
    """Column by literal name; names may hold blanks, slashes or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def align(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Exactly ``columns``, in order: missing ones hold ``fill``, extra ones go."""
    have = set(df.columns)
    return df.select(*[q(c) if c in have else F.lit(fill).alias(c) for c in columns])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def to_2017_names(df: DataFrame) -> DataFrame:
    """CIC 2018 column names to 2017 names; the duplicate header-length column is added when absent."""
    out = rename(trim_names(df), {**fv.CIC_SCORER_NAMES, **fv.CIC_2018_ONLY_NAMES})
    if "Fwd Header Length" in out.columns and "Fwd Header Length.1" not in out.columns:
        out = out.withColumn("Fwd Header Length.1", q("Fwd Header Length"))
    return out


def number(col: Column) -> Column:
    """Number or null; text that is no number becomes null."""
    return col.try_cast("double")


def finite(col: Column) -> Column:
    """The value if finite, else null (NaN sorts above infinity, so one comparison covers both)."""
    return F.when(F.abs(col) < INF, col)


def zero_if_not_finite(col: Column) -> Column:
    return F.coalesce(finite(col), F.lit(0.0))


def finite_max(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Largest finite value of each column, per ``by`` group: one partial aggregation over all columns."""
    return df.groupBy(*(by or [])).agg(*[F.max(finite(q(c))).alias(f"max_{c}") for c in columns])


def attach(df: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """Columns of a per-group table on every row; without ``by`` the table has one row."""
    if by:
        return df.join(values, by, "left")
    held = df.withColumn("__row", single_row(values))
    return held.withColumns({c: F.col("__row")[c] for c in values.columns}).drop("__row")


def clip_infinite(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Infinities become the group's largest finite value, then nulls and NaN become 0.

    The maxima are written first: Spark then knows their real size and broadcasts them only below its threshold.
    """
    joined = attach(df, settle(finite_max(df, columns, by), "maxima"), by)
    size = {c: F.abs(q(c)) for c in columns}
    fixed = {c: F.coalesce(F.when(size[c] < INF, q(c)).when(size[c] == INF, q(f"max_{c}")), F.lit(0.0))
             for c in columns}
    return joined.withColumns(fixed).drop(*[f"max_{c}" for c in columns])


def fill_with_max(df: DataFrame, columns: list[str], maxima: DataFrame, by: list[str]) -> DataFrame:
    """Non-finite and missing values become the given maximum, or 0 where there is none."""
    joined = attach(df, maxima, by)
    fixed = {c: F.coalesce(finite(q(c)), q(f"max_{c}"), F.lit(0.0)) for c in columns}
    return joined.withColumns(fixed).drop(*[f"max_{c}" for c in columns])


def port_buckets(port: Column, prefix: str) -> dict[str, Column]:
    """Three 0/1 columns; a port that is no number counts as port 0."""
    n = F.coalesce(number(port).cast("long"), F.lit(0))
    return {f"{prefix}_{name}": n.between(lo, hi).cast("tinyint") for name, (lo, hi) in fv.PORT_BUCKETS.items()}


def log_scale(col: Column) -> Column:
    return F.log1p(F.abs(col))


def null_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of null or NaN values per column, as rows (feature, share)."""
    missing = lambda c: F.avg((q(c).isNull() | F.isnan(q(c))).cast("double")).alias(c)
    one = df.agg(*[missing(c) for c in columns])
    return one.unpivot([], columns, "feature", "share")


def flag_sparse(df: DataFrame, columns: list[str], max_share: float = 0.05) -> DataFrame:
    """Null shares with ``flagged`` for columns above ``max_share``."""
    return null_shares(df, columns).withColumn("flagged", F.col("share") > max_share)
