"""Session settings and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators rely on; sizes (shuffle partitions, memory) belong to the cluster.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",  # larger methods are never compiled by the JVM; run them unfused
    "spark.sql.legacy.javaCharsets": "true",  # CSV sets in windows-1252
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the cluster's ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may do without and gets a temporary folder; on a
    cluster that would leave each executor with files the others can't see, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_flowlake_dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark._flowlake_dir = tempfile.mkdtemp(prefix="flowlake-")
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/flowlake/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def single_row(df: DataFrame) -> Column:
    """The row of a one-row table (a global aggregate) as a struct: a scalar subquery, so no join is planned."""
    return df.select(F.struct("*")).scalar()
