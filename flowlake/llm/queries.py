"""Registered queries of this subpackage, over whole tables, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import (
    alignment, fim, html_text, language, mixing, neardup, oracles, packing, quality_model, quality_rules, secrets, topk, toxicity, warc)
from flowlake.llm.common import held_out, table
from flowlake.session import new_path

KEPT_SCORE = 0.7  # documents of at least this score count as good
TOXIC_SCORE = 0.5  # and of at least this one as toxic


def op1_pack_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.create_ledger(spark, new_path(spark, "secret-ledger"))
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ledger))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 5, 0)
    net = language.fit(docs, F.col("doc_id").isNotNull() & ~out)
    done = language.identified(docs.select("doc_id", "text"), net)
    return done.select("doc_id", out.alias("held_out"), "language.lang_pred", "language.score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), spark)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines",
                       "rules.n_repeat_words", "rules.base_failed", "rules.kept", "rules.ratio", "rules.chunk_low",
                       "rules.chunk_high")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def fitted_quality(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality_model.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_model.fit(docs, labels, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = quality_model.scored(docs, fitted_quality(spark, sf_dir, docs))
    return done.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                       (F.col("score") >= KEPT_SCORE).cast("int").alias("predicted"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text, form = F.col("fim.output"), F.col("fim.form")
    return done.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2(text, 256).alias("output_sha256"),
                       F.sha2(fim.restored(text, form), 256).alias("restored_sha256"))


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = held_out(F.col("doc_id"), 5, 0)
    done = toxicity.scored(docs, toxicity.fit(docs, labels, F.col("doc_id").isNotNull() & ~out))
    return done.select("doc_id", out.alias("held_out"), "toxicity.score",
                       (F.col("toxicity.score") >= TOXIC_SCORE).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_pack_lengths, op2_near_duplicates, op3_secret_scan, op4_language, op5_warc, op6_quality_rules, op7_mix_sources,
    op8_quality, op9_html_text, op10_top_k, op11_fill_in_middle, op12_align_tokens, op13_toxicity)}
ORACLES = {"op1_pack_lengths": oracles.pack_lengths(16, 65536), "op2_near_duplicates": oracles.NEAR_DUPLICATES,
           "op3_secret_scan": oracles.SECRET_SCAN, "op5_warc": oracles.WARC, "op10_top_k": oracles.TOP_K,
           "op11_fill_in_middle": oracles.FILL_IN_MIDDLE}
