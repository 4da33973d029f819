"""Running streams: sources, drained runs, and sinks that are safe to repeat.

Every sink writes a micro-batch under its batch id, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.session import new_path


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files in ``folder`` whose names match ``pattern``, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


@contextmanager
def state_settings(spark: SparkSession, last: bool = True) -> Iterator[None]:
    """Settings a stateful stream fixes at its first start: RocksDB state, one partition per core of the cluster.

    Unless this is the ``last`` run, what a batch without rows would do by the new watermark is left to the next run's first batch.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
              "spark.sql.streaming.noDataMicroBatches.enabled": str(last).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append",
          checkpoint: str | None = None, last: bool = True) -> str:
    """Run the stream over all available input and stop; returns the checkpoint folder, to go on later."""
    checkpoint = checkpoint or new_path(stream.sparkSession, "stream-checkpoint")
    with state_settings(stream.sparkSession, last):
        run = (stream.writeStream.foreachBatch(each).outputMode(mode).trigger(availableNow=True)
               .option("checkpointLocation", checkpoint).start())
        run.awaitTermination()
    return checkpoint


def drain_parts(stream: DataFrame, each: Callable[[DataFrame, int], None], arrivals: Iterable[Callable[[], None]], mode: str = "append") -> None:
    """Drain the stream after each of ``arrivals``, which add files to its folder; every run goes on from the last one's checkpoint.

    So a part may be many files, written and read by many tasks, and its order does not hang on modification times.
    """
    checkpoint, arrivals = None, list(arrivals)
    for i, arrive in enumerate(arrivals, 1):
        arrive()
        checkpoint = drain(stream, each, mode, checkpoint, last=i == len(arrivals))


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Parquet sink with one folder per batch."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def collected(stream: DataFrame, arrivals: Iterable[Callable[[], None]], mode: str = "append") -> DataFrame:
    """Drain the stream after each arrival into a fresh sink; in update mode rows carry ``batch``, the later one is the valid one."""
    path = new_path(stream.sparkSession, "stream-out")
    drain_parts(stream, batch_sink(path), arrivals, mode)
    return stream.sparkSession.read.parquet(path)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of each key from update-mode output."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])
