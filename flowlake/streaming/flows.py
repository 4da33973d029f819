"""Flow assembly over a stream of packets, in micro-batches with the batch segmentation.

Packets wait until the watermark has passed them, so packets that come out of order are still taken in order.  Each
micro-batch adds the packets that are due to those of the flows still open, segments them with the batch operator
(which spreads hot keys), writes the flows that have closed as records, and carries the packets of the open ones and of
those not due below the state folder.  Packets that come after the watermark has passed them are dropped and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.operators.flow_keys import flow_keys
from flowlake.operators.nfv3_features import nfv3_record
from flowlake.operators.nfv3_segments import US, CloseRules, segment_flows
from flowlake.session import settle

MARKS = "batch long, watermark_us long, n_late long"
SLOTS = 3  # states kept: the one that is written, the one before it, and a spare for a batch that is run again


class FlowState:
    """What is carried from batch to batch, in a few folders that take turns; it survives restarts of the stream."""

    def __init__(self, spark: SparkSession, folder: str, packet_schema: T.StructType):
        self.spark, self.folder = spark, folder
        self.packet_schema = T.StructType([*packet_schema.fields, T.StructField("batch", T.LongType())])
        for name, schema in (("packets", self.packet_schema), ("marks", MARKS)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}/slot=-1")

    def before(self, batch_id: int) -> tuple[DataFrame, int | None, int]:
        """Packets, watermark and number of late packets after the last batch before ``batch_id``."""
        marks = self.spark.read.schema(MARKS).parquet(f"{self.folder}/marks").where(F.col("batch") < batch_id)
        last = marks.orderBy(F.desc("batch")).first()
        slot = last["batch"] % SLOTS if last else -1  # never the slot that batch_id is written to
        held = self.spark.read.schema(self.packet_schema).parquet(f"{self.folder}/packets/slot={slot}")
        held = held.where(F.col("batch") == (last["batch"] if last else -1)).drop("batch")
        return held, last["watermark_us"] if last else None, last["n_late"] if last else 0

    def save(self, batch_id: int, packets: DataFrame, watermark_us: int | None, late: int) -> None:
        slot = f"slot={batch_id % SLOTS}"
        packets.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/packets/{slot}")
        self.spark.createDataFrame([(batch_id, watermark_us, late)], MARKS).write.mode("overwrite").parquet(f"{self.folder}/marks/{slot}")


def closed_and_open(due: DataFrame, watermark_us: int | None, rules: CloseRules) -> tuple[DataFrame, DataFrame]:
    """Packets of flows that no later packet can change, and of those that may go on.

    Of each key all flows but the newest are closed; so is the newest after a silence.  Without watermark all are.  Only keys
    heard of since can have an open flow, so these are segmented first, to find it; all packets are segmented once.
    """
    tagged = segment_flows(due, rules)
    if watermark_us is None:
        return tagged, tagged.where(F.lit(False))
    since = F.col("t1") + rules.inactive_s * US >= watermark_us
    keyed = flow_keys(due)
    live = settle(keyed.groupBy("flow_key").agg(F.max("ts_us").alias("t1")).where(since).select("flow_key"), "live-keys")
    recent = settle(segment_flows(keyed.join(live, "flow_key", "left_semi"), rules), "live-packets")
    ends = recent.groupBy("flow_key", "flow_id").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    newest = F.row_number().over(Window.partitionBy("flow_key").orderBy(F.desc("t0"), F.desc("flow_id"))) == 1
    going = settle(ends.withColumn("newest", newest).where("newest").where(since).select("flow_key", "flow_id"), "open-flows")
    keys = ["flow_key", "flow_id"]
    return tagged.join(going, keys, "left_anti"), recent.join(going, keys, "left_semi")


def flow_sink(state: FlowState, path: str, rules: CloseRules = CloseRules(), late_s: int = 30):
    """Sink that writes each micro-batch's closed flows as NetFlow-v3 records; a batch that is run again gives the same."""
    def write(df: DataFrame, batch_id: int) -> None:
        held, watermark, late = state.before(batch_id)
        fresh = settle(df, "stream-packets")
        stats = fresh.agg(F.max("ts_us").alias("top"), F.count_if(F.col("ts_us") <= F.lit(watermark).cast("long")).alias("late")).first()
        if watermark is not None:
            fresh = fresh.where(F.col("ts_us") > watermark)
        moved = [t for t in (watermark, stats["top"] - late_s * US if stats["top"] is not None else None) if t is not None]
        watermark = max(moved, default=None)
        pool = held.unionByName(fresh)
        if watermark is None:
            state.save(batch_id, pool, None, late)
            return
        closed, going = closed_and_open(pool.where(F.col("ts_us") <= watermark), watermark, rules)
        nfv3_record(closed).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        kept = going.select(*pool.columns).unionByName(pool.where(F.col("ts_us") > watermark))
        state.save(batch_id, kept, watermark, late + (stats["late"] or 0))
    return write


def flush(state: FlowState, path: str, rules: CloseRules = CloseRules()) -> int:
    """Close all open flows at the end of a stream; returns the number of late packets."""
    held, _, late = state.before(1 << 62)
    closed, _ = closed_and_open(held, None, rules)
    nfv3_record(closed).write.mode("overwrite").parquet(f"{path}/batch=-1")
    return late
