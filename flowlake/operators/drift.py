"""Feature histograms and distribution drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.operators.cleaning import finite
from flowlake.session import settle

EPS = 1e-10


def bin_edges(df: DataFrame, features: list[str], bins: int = 50) -> DataFrame:
    """(feature, lo, hi, bins): equal bins from the smallest to the largest finite value, one unit wide in all if they agree."""
    one = df.agg(*[F.struct(F.lit(c).alias("feature"), F.min(finite(F.col(c))).alias("lo"), F.max(finite(F.col(c))).alias("hi")).alias(c)
                   for c in features])
    rows = one.select(F.inline(F.array(*features)))
    flat = F.col("lo") == F.col("hi")
    return rows.select("feature", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), F.lit(bins).alias("bins"))


def edge(e: Column, i: Column) -> Column:
    """Edge number ``i`` of the bins ``e``; the last one is the largest value itself."""
    return F.when(i >= e["bins"], e["hi"]).otherwise(e["lo"] + i * ((e["hi"] - e["lo"]) / e["bins"]))


def bin_of(e: Column, x: Column) -> Column:
    """Bin whose edges hold ``x``: at or above its lower, below its upper edge, the last bin closed.

    The quotient can be one off where rounding moves a value across an edge; comparing with the edges mends that.
    """
    last = e["bins"].cast("long") - 1
    near = F.least(F.greatest(F.floor((x - e["lo"]) / (e["hi"] - e["lo"]) * e["bins"]), F.lit(0).cast("long")), last)
    return (near - (x < edge(e, near)).cast("long")
            + ((near < last) & (x >= edge(e, near + 1))).cast("long"))


def histogram(df: DataFrame, features: list[str], edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, feature, bin, n) for every bin; values outside the edges, infinite and missing ones are left out.

    ``edges`` is one row per feature and travels as a single packed row.  Rows are counted map-side, at most bins x
    features partial rows per group and task.
    """
    packed = edges.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lo", "hi", "bins")))).alias("__e"))
    values = df.select(*by, packed.scalar().alias("__e"), *features).select(*by, "__e", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("v"))
    e, x = F.element_at("__e", F.col("v.feature")), F.col("v.x")
    inside = values.filter((x >= e["lo"]) & (x <= e["hi"]))
    counts = inside.groupBy(*by, F.col("v.feature").alias("feature"), bin_of(e, x).alias("bin")).agg(F.count("*").alias("n"))
    every = edges.select("feature", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins").cast("long") - 1)).alias("bin"))
    if by:  # every group has every bin of the packed row
        each = every.agg(F.collect_list(F.struct("feature", "bin")).alias("__all")).scalar()
        every = df.select(*by).distinct().withColumn("__all", each).select(*by, F.inline("__all"))
    return every.join(counts, [*by, "feature", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def shares(hist: DataFrame, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """Smoothed bin shares: density + epsilon, scaled to sum 1 per group and feature.

    A histogram without any value counts as density 0, that is, equal shares.
    """
    keys = [*by, "feature"]
    totals = hist.groupBy(*keys).agg(F.sum("n").alias("all"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    density = hist.join(totals, keys).join(edges, "feature").withColumn(
        "d", F.when(F.col("all") > 0, F.col("n") / (F.col("all") * width)).otherwise(0.0) + EPS)
    scale = density.groupBy(*keys).agg(F.sum("d").alias("s"))
    return density.join(scale, keys).select(*keys, "bin", (F.col("d") / F.col("s")).alias("p"))


def fit_reference(df: DataFrame, features: list[str], bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Reference edges and shares, written so later batches reuse them."""
    edges = settle(bin_edges(df, features, bins), "edges")
    return edges, settle(shares(histogram(df, features, edges), edges), "reference")


def kl_of_shares(reference: DataFrame, new: DataFrame, threshold: float = 0.1, by: list[str] = ()) -> DataFrame:
    """KL(reference || new) per group and feature of two share tables; drifted when above the threshold."""
    both = reference.join(new.withColumnRenamed("p", "q"), ["feature", "bin"])
    kl = both.groupBy(*by, "feature").agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))
    return kl.withColumn("drifted", F.col("kl") > threshold)


def kl_by_feature(edges: DataFrame, reference: DataFrame, new: DataFrame, features: list[str],
                  threshold: float = 0.1, by: list[str] = ()) -> DataFrame:
    """KL of every group of ``new`` against the reference, over the reference edges."""
    return kl_of_shares(reference, shares(histogram(new, features, edges, by), edges, by), threshold, by)


def drift_summary(per_feature: DataFrame, by: list[str] = ()) -> DataFrame:
    return per_feature.groupBy(*by).agg(F.bool_or("drifted").alias("drifted"), F.avg("kl").alias("mean_kl"), F.max("kl").alias("max_kl"),
                           F.array_join(F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))), ",")
                           .alias("drifted_features"))
