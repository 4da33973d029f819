"""Language net and compression classifier: held-out accuracy, what they may see, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.llm import language, quality_model
from flowlake.llm.common import held_out
from flowlake.llm.queries import QUERIES, fitted_quality
from tests.conftest import MIDDLE
from tests.llm.rows import awkward_docs, no_docs


def test_language_is_right_on_held_out_documents(spark):
    lang = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language"](spark, MIDDLE).join(lang, "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) > 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_is_right_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op8_quality"](spark, MIDDLE).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert len(good) > 50 and len(bad) > 5
    assert sum(r["predicted"] for r in good) > 0.97 * len(good) and sum(r["predicted"] for r in bad) < 0.2 * len(bad)


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    learn = ~held_out(F.col("doc_id"), 4, 2)
    turned = labels.withColumn("quality", F.when(learn, F.col("quality")).otherwise(1 - F.col("quality")))
    assert quality_model.fit(docs, labels, learn) == quality_model.fit(docs, turned, learn)
    learn = ~held_out(F.col("doc_id"), 5, 0)
    other = docs.withColumn("lang", F.when(learn, F.col("lang")).otherwise("xx"))
    a, b = (language.fit(d, learn, per_language=20, steps=5) for d in (docs, other))
    assert a.languages == b.languages and np.array_equal(a.kernel, b.kernel)


def test_net_gradient_learns_and_reads_whole_texts():
    net = language.ByteNet(["a", "b"]).train(np.array([language.windows(t, 160)[0] for t in (b"aaaa bb", b"zzzz yy")] * 8),
                                             np.array([0, 1] * 8), steps=60)
    assert net.predict(["½ ² ①", "Ⅷ", "٣ 12"])[0] == ["und"] * 3  # numerals are no letters
    assert net.predict(["aaaa", "zzzz", None, "", "12 !?", "aaaa " * 20 + "zzzz " * 900]) == (
        ["a", "b", "und", "und", "und", "b"], pytest.approx([1, 1, 0, 0, 0, 1], abs=0.4))
    assert language.windows(b"x" * 161, 160).shape == (2, 160)


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    net = language.fit(docs.withColumn("lang", F.coalesce("lang", F.lit("en"))), F.lit(True), steps=3)
    rows = language.identified(docs, net).collect()
    assert len(rows) == 14 and {r["language"]["lang_pred"] for r in rows if r["doc_id"] in (4, 5, 6, 10)} == {"und"}
    nothing = language.fit(no_docs(spark), F.lit(True))
    assert language.identified(docs, nothing).select("language.lang_pred").distinct().collect() == [("und",)]
    labels = spark.createDataFrame([(1, 1), (9, 0), (9, 0), (4, 1), (None, 0), (7, None), (8, 5)], "doc_id bigint, quality int")
    model = quality_model.fit(docs, labels, F.lit(True))
    rows = quality_model.scored(docs, model).collect()
    assert len(rows) == 14 and "_score" in rows[0] and all(0 <= r["_score"] <= 1 for r in rows)
    flat = quality_model.fit(docs, labels.where("false"), F.lit(True))
    assert {r["_score"] for r in quality_model.scored(docs, flat).collect()} == {0.5}
    assert quality_model.scored(no_docs(spark), flat).count() == 0


def test_whole_text_is_scored(spark):
    model = fitted_quality(spark, MIDDLE, spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    packers = model.packers()
    text = "The thing of the and. " * 50
    assert model.difference(text + "Ж" * 5000, packers) != model.difference(text, packers)
