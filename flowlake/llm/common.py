"""What the operators of this subpackage share: words, tables, spread-out ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words split at ASCII white space; null counts 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def held_out(doc_id: Column, mod: int, fold: int) -> Column:
    """True for the rows no model may learn from; a row without an id can't be placed and is never learnt from."""
    return F.coalesce(crc_mod(doc_id, mod) == fold, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it new among the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hash_share(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the values of ``cols``."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def first_by_hash(df: DataFrame, by: Sequence[Column], n: int) -> DataFrame:
    """``n`` rows in hash order: a reproducible bounded sample, cut in every partition before anything is moved."""
    return df.orderBy(F.xxhash64(*by), *by).limit(n)
