"""Small awkward tables: nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import DataFrame, SparkSession

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
WORDS = [f"w{i}" for i in range(60)]
BASE = " ".join(WORDS)


def awkward_docs(spark: SparkSession) -> DataFrame:
    near = " ".join([*WORDS[:-1], "changed"])
    rows = [(1, BASE, "en", "a", 1), (2, BASE.upper(), "en", "a", 1), (3, near, "en", None, 1), (4, None, None, None, None),
            (5, "", "de", "b", 0), (6, " \n\t ", "de", "b", 3), (7, "few words", "fr", "b", 9), (8, "Few  words", "fr", "c", 10),
            (9, LONG, "en", "c", len(LONG)), (10, "!!! 123", "es", "c", 7), (None, BASE, "en", "a", 1),
            (11, "tie", "en", "b", 3), (11, "tie", "en", "b", 3), (12, "été \U0001f600 niño", "fr", "é", 12)]
    extra = "batch string, rules string, score string, bucket string, spans string, copies string, size string, h string"
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], f"{DOC_SCHEMA}, {extra}")


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOC_SCHEMA)
