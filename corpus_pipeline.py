"""Corpus pipeline: quality, near duplicates, secrets, source mix, packing; each stage works on what the last one kept."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.llm import mixing, neardup, packing, quality_model, secrets
from flowlake.llm.common import fresh, word_count
from flowlake.llm.queries import KEPT_SCORE, fitted_quality
from flowlake.session import new_path, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the limit; those without text go, as they score low."""
    done = quality_model.scored(docs, fitted_quality(spark, sf_dir, docs), name="quality_score")
    return done.where(F.col(done.columns[-1]) >= KEPT_SCORE).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the rows of its smallest id; rows without id stay."""
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(settle(gone, "pipeline-gone"), "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets are replaced by a mask, and n_chars follows the text."""
    ledger, name = secrets.create_ledger(spark, new_path(spark, "pipeline-ledger")), fresh(docs, "spans")
    done = secrets.scan(docs, ledger, name=name)
    changed = F.size(name) > 0
    return (done.withColumn("text", secrets.redact(F.col("text"), F.col(name)))
            .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once, or up to three times."""
    size, nth = fresh(docs, "mix_size"), fresh(docs, "mix_nth")
    order = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"), "text")
    numbered = docs.withColumn(size, word_count(F.col("text"))).withColumn(nth, F.row_number().over(order).cast("long"))
    keys = {"doc_id": "doc_id", "source": "source", "size": size, "nth": nth}
    taken = settle(mixing.mix(docs, numbered=True).where("copies > 0").select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("copies").alias("__copies")), "pipeline-mix")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in keys.items()])
    met = numbered.join(taken, same)
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a batch for every copy."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each_group), ("secrets", mask_secrets),
          ("mix", mix_sources), ("pack", pack_lengths)]
ORACLE_SQL = None  # trained dictionaries and random rounding are beyond SQL; tests/llm/test_pipeline.py checks each stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
