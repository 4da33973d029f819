"""Streams of alerts: rule match with fresh rules, counters, per-second traffic, drift checks, row sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.operators.datasets import sequences
from flowlake.operators.drift import histogram, kl_of_shares, shares
from flowlake.operators.ordered import join_back
from flowlake.operators.scoring import raise_alerts
from flowlake.session import settle


def alert_sink(read_rules: Callable[[SparkSession], DataFrame], scorer_name: str, path: str):
    """Decide each micro-batch with the rules as they are now, and append the alerts."""
    def write(df: DataFrame, batch_id: int) -> None:
        raise_alerts(df, read_rules(df.sparkSession), scorer_name).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def traffic(alerts: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Traffic and attacks per second, updated as rows arrive."""
    counted = alerts.withWatermark("ts", late).groupBy(F.window("ts", "1 second").alias("w")).agg(
        F.count("*").alias("traffic"), F.count_if("is_attack").alias("attacks"))
    return counted.select(F.unix_seconds("w.start").alias("second_s"), "traffic", "attacks")


def running_counters(alerts: DataFrame) -> DataFrame:
    """Running count per attack type and outcome."""
    return alerts.groupBy("is_attack", "attack_type").agg(F.count("*").alias("n"))


def drift_sink(edges: DataFrame, features: list[str], path: str, by: list[str]):
    """Bin counts of each micro-batch under its id; a batch that is run again replaces its own counts.

    ``drift_so_far`` adds them up, so drift is measured over all rows seen, however they were cut into batches.
    """
    def write(df: DataFrame, batch_id: int) -> None:
        if not df.isEmpty():
            histogram(df, features, edges, by).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def drift_so_far(counts: DataFrame, edges: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """Drift per group and feature from the counts of all batches."""
    merged = counts.groupBy(*by, "feature", "bin").agg(F.sum("n").alias("n"))
    return kl_of_shares(reference, shares(merged, edges, by), by=by)


class SequenceSink:
    """Windows over the last ``length`` rows per sensor in the order of ``id_col``, across micro-batches and arrival orders.

    A row waits until its sensor has shown an id more than ``late`` above it; rows that come after that are dropped.  Rows
    that are due meet the newest ``length - 1`` rows before them, which are carried with the waiting ones in a small table
    beside the sink's folder; it outlives a restart, and a batch that is run again replaces itself.  The windows use the
    batch operator, so one busy sensor is spread over many tasks.  ``flush`` ends the stream: no row waits any longer.
    """

    SLOTS = 3  # they take turns: the one that is read is never the one that is written

    def __init__(self, spark: SparkSession, features: list[str], path: str, length: int = 10, by: str = "dataset",
                 id_col: str = "row_id", late: int = 0):
        self.spark, self.features, self.path, self.length, self.by, self.id_col, self.late = spark, features, path, length, by, id_col, late
        self.carry = f"{path.rstrip('/')}-carry"

    def before(self, schema: T.StructType, batch_id: int) -> DataFrame:
        """Carried rows after the last batch before ``batch_id``."""
        kept = T.StructType([*schema.fields, T.StructField("__done", T.BooleanType()), T.StructField("__batch", T.LongType())])
        self.spark.createDataFrame([], kept).write.mode("ignore").parquet(f"{self.carry}/slot=-1")
        last = self.spark.read.schema(kept).parquet(self.carry).where(F.col("__batch") < batch_id).agg(F.max("__batch")).first()[0]
        slot = -1 if last is None else last % self.SLOTS
        return self.spark.read.schema(kept).parquet(f"{self.carry}/slot={slot}").where(F.col("__batch") == last).drop("__batch")

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        earlier = self.before(df.schema, batch_id)
        shown = earlier.groupBy(self.by).agg(F.max(self.id_col).alias("__shown"))
        in_time = F.col("__shown").isNull() | (F.col(self.id_col) > F.col("__shown") - self.late)
        fresh = df.join(shown, df[self.by].eqNullSafe(shown[self.by]), "left").where(in_time).select(*[df[c] for c in df.columns])
        pool = settle(fresh.withColumn("__done", F.lit(False)).unionByName(earlier), "sequence-pool")
        tops = settle(pool.groupBy(self.by).agg(F.max(self.id_col).alias("__top")), "sequence-tops")
        rows = join_back(pool, tops, [self.by]).withColumn("__due", F.col("__done") | (F.col(self.id_col) <= F.col("__top") - self.late)).drop("__top")
        due, waiting = rows.where("__due").drop("__due"), rows.where("not __due").drop("__due")
        self.emit(due, batch_id)
        newest = Window.partitionBy(self.by).orderBy(F.desc(self.id_col))
        kept = due.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") < self.length).drop("rn").withColumn("__done", F.lit(True))
        (kept.unionByName(waiting).withColumn("__batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .parquet(f"{self.carry}/slot={batch_id % self.SLOTS}"))

    def emit(self, due: DataFrame, batch_id: int) -> None:
        done = sequences(due, self.features, self.length, self.by, self.id_col).filter("not __done").drop("__done", "pos")
        done.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def flush(self, schema: T.StructType) -> None:
        self.emit(self.before(schema, 1 << 62), -1)
