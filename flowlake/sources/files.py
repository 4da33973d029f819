"""File sources and sinks: raw CSV, directories of CSV, processed Parquet, reports."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow.fs as pafs
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.operators.cleaning import trim_names
from flowlake.operators.ordered import row_numbers
from flowlake.session import settle

CSV_OPTIONS = {"header": "true", "positiveInf": "Infinity", "negativeInf": "-Infinity",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def raw_path(spark: SparkSession, folder: str, filename: str) -> str:
    """``filename`` in ``folder``, or its ``.gz`` form."""
    for path in (f"{folder}/{filename}", f"{folder}/{filename}.gz"):
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"{filename} (or {filename}.gz) is not in {folder}")


def scan_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; names are stripped.  A gzip file is read by one task, so it is spread out afterwards."""
    reader = spark.read.options(**CSV_OPTIONS)
    df = trim_names((reader.schema(schema) if schema else reader).csv(path))
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


CSV_FILES = "*.{csv,csv.gz}"
CORRUPT = "__corrupt"
NO_CHARACTER = "\ufffd"  # what decoders put where bytes mean nothing
PIECE = 1 << 20


def csv_lines(spark: SparkSession, folder: str, schema: str, encoding: str) -> DataFrame:
    """Rows of all CSV files under ``folder`` with their file, its size, their block and order; bad lines in ``CORRUPT``."""
    fields = T.StructType([*spark.createDataFrame([], schema).schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.options(**CSV_OPTIONS, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, ignoreCorruptFiles="true",
                                recursiveFileLookup="true", pathGlobFilter=CSV_FILES)
    return reader.schema(fields).csv(folder).select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))


def check_files(spark: SparkSession, folder: str, schema: str, encoding: str = "windows-1252", max_bad_share: float = 0.0) -> DataFrame:
    """(file, bytes, n_rows, n_bad, problem): one row per CSV file, ``problem`` null for those that may be read.

    * ``unreadable``: a gzip file that ends inside a member, or whose checksum disagrees (``gzip_files``);
    * ``empty``: no line but the header;
    * ``encoding``: text fields with bytes that the encoding has no character for;
    * ``records``: more than ``max_bad_share`` of the lines don't fit the schema.
    """
    lines = csv_lines(spark, folder, schema, encoding)
    own = [F.col(f"`{c}`") for c in lines.columns if c not in ("file", "block", "line")]
    texts = [F.contains(F.col(f"`{c}`"), F.lit(NO_CHARACTER)) for c, t in lines.dtypes if t == "string" and c not in ("file", CORRUPT)]
    odd = reduce(or_, [F.coalesce(t, F.lit(False)) for t in texts], F.lit(False))
    found = settle(lines.groupBy("file").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(CORRUPT).isNotNull()).alias("n_bad"), F.count_if(odd).alias("n_odd"),
        F.bit_xor(F.xxhash64(*own)).alias("digest")), "file-counts")  # so all columns are parsed and bad fields of any count
    checked = file_sizes(spark, folder, CSV_FILES).withColumnRenamed("path", "file").withColumnRenamed("length", "bytes").join(
        found, "file", "left").join(gzip_files(spark, folder), "file", "left")
    n, bad = F.coalesce("n_rows", F.lit(0)), F.coalesce("n_bad", F.lit(0))
    problem = (F.when(~F.col("whole"), "unreadable").when(n == 0, "empty").when(F.col("n_odd") > 0, "encoding")
               .when(bad > max_bad_share * n, "records"))
    return checked.select("file", "bytes", n.alias("n_rows"), bad.alias("n_bad"), "digest", problem.alias("problem"))


def gzip_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, whole) of the compressed files: whether every member ends and has the checksum it states.

    Spark's readers stop at the defect without a word, so the bytes go through zlib once more, a megabyte at a time and a
    file per task, over pyarrow's file systems (local paths, ``file:``, ``hdfs:``, ``s3:``, ``gs:``).
    """
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"file": part["path"], "whole": [whole_gzip(p) for p in part["path"]]})

    packed = file_sizes(spark, folder, "*.csv.gz").select("path")
    return packed.repartition(spark.sparkContext.defaultParallelism).mapInPandas(read, "file string, whole boolean")


def whole_gzip(path: str) -> bool:
    store, name = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    member, seen = None, False
    with store.open_input_stream(name, compression=None) as stream:
        while left := stream.read(PIECE):
            while left:
                member = member or zlib.decompressobj(31)
                try:
                    member.decompress(left, PIECE)
                except zlib.error:
                    return False
                seen, left = True, member.unconsumed_tail or member.unused_data
                member = None if member.eof else member
    return seen and member is None


def copy_part(source: str, target: str, n_bytes: int) -> None:
    """The first ``n_bytes`` of a file as a new file, as a broken transfer leaves it."""
    (store, name), (place, copy) = (pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", p) if ":" in p else p) for p in (source, target))
    place.create_dir(copy.rpartition("/")[0])
    with store.open_input_stream(name, compression=None) as stream, place.open_output_stream(copy, compression=None) as out:
        out.write(stream.read(n_bytes))


def scan_csv_dir(spark: SparkSession, folder: str, schema: str, limit: int | None = None, max_files: int | None = None,
                 report: DataFrame | None = None) -> DataFrame:
    """All CSV files under ``folder`` (windows-1252, also gzip) that are sound as a whole.

    A file with a problem gives no row: no part of it is read as if it were the file.  ``report`` is the result of
    ``check_files``, made here when it is not given; what it says of the left-out files is the caller's to keep.
    ``limit`` keeps the first rows of each file.  A row's place is its block in the file, then its order in the block,
    so large files are numbered by many tasks.  ``max_files`` keeps the first files by name.
    """
    report = check_files(spark, folder, schema) if report is None else report
    bad = report.where("problem is not null").select("file")
    df = csv_lines(spark, folder, schema, "windows-1252").drop(CORRUPT).join(settle(bad, "bad-files"), "file", "left_anti")
    df = df.select(*[c for c in df.columns if c != "file"], "file")
    df = trim_names(df)
    if max_files:
        names = df.select("file").distinct().orderBy("file").limit(max_files)
        df = df.join(F.broadcast(names), "file", "left_semi")
    if limit:
        df = row_numbers(df, ["file"], "block", ["line"]).filter(F.col("rn") <= limit).drop("rn")
    return df.drop("block", "line")


def schema_report(df: DataFrame, want: list[str]) -> DataFrame:
    """One row per column name, stripped: present, missing or extra, and how many rows have a value in it."""
    names = {c.strip(): c for c in df.columns}
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(n) for n, c in names.items()])
    known = counts.unpivot([], [f"`{n}`" for n in names], "column_name", "n_values")
    status = F.when(F.col("column_name").isin(want), "present").otherwise("extra")
    missing = F.array(*[F.lit(c) for c in want if c not in names]).cast("array<string>")
    gone = counts.select(F.explode(missing).alias("column_name"), F.lit("missing").alias("status"), F.lit(0).cast("long").alias("n_values"))
    return known.select("column_name", status.alias("status"), "n_values").unionByName(gone)


def file_sizes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files under ``folder``; contents are not read."""
    return (spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(folder)
            .select("path", "length"))


def dataset_report(spark: SparkSession, folder: str, schema: str, want: list[str], label: str) -> DataFrame:
    """Rows, columns, size and checks per dataset for a folder of ``dataset=<name>`` CSV folders."""
    df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(folder)
    have = [c.strip() for c in df.columns if c != "dataset"]
    counts = df.groupBy("dataset").agg(F.count("*").alias("n_rows"))
    sizes = file_sizes(spark, folder).groupBy(F.regexp_extract("path", "dataset=([^/]+)", 1).alias("dataset")).agg(
        (F.sum("length") / F.lit(1048576.0)).alias("size_mb"))
    return counts.join(sizes, "dataset").select(
        "dataset", "n_rows", F.lit(len(have)).alias("n_cols"), "size_mb",
        F.lit(set(want) <= set(have)).alias("columns_match"), F.lit(label in have).alias("label_present"))


def write_processed(df: DataFrame, path: str, features: list[str], labels: list[str], by: str = "dataset") -> None:
    """Features as float and labels, one folder per dataset."""
    keep = [c for c in df.columns if c in labels and c != by]
    df.select(by, *[F.col(c).cast("float").alias(c) for c in features], *keep).write.partitionBy(by).parquet(path)
