"""Toxicity: held-out accuracy on the given labels, windows of any text, tables without labels."""

import pytest
from pyspark.sql import functions as F

from flowlake.llm import toxicity
from flowlake.llm.queries import op13_toxicity

SF = "/root/testdata/sf0.1"


def test_windows_cover_every_byte():
    for data in (b"", b"word " * 200, b"x" * 1000, "é".encode() * 300, b"short"):
        places = list(toxicity.windows(data, 62))
        assert b"".join(data[lo:hi] for lo, hi in places) == data
        assert all(0 < hi - lo <= 62 for lo, hi in places)


def test_held_out_accuracy(spark):
    got = op13_toxicity(spark, SF)
    known = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = got.where("held_out").join(known, "doc_id").where("toxic is not null").groupBy("toxic").agg(
        F.count("*").alias("n"), F.avg("predicted").alias("said")).collect()
    said = {r["toxic"]: r["said"] for r in rows}
    assert said[1] >= 0.85 and said[0] <= 0.03, said
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.fixture(scope="module")
def model():
    return toxicity.Model.of(b" the calm words ", b" gronk blarg ", b"", (1.0, 0.0, 0.0, 0.0, -3.0))


def test_strongest_window_and_odd_texts(spark, model):
    long = "the calm words of a long text " * 400
    rows = [(1, None), (2, ""), (3, "hello"), (4, long), (5, long + "gronk blarg gronk blarg " + long), (5, None), (None, "\x00퟿ é" * 500)]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, toxicity string")
    done = toxicity.scored(docs, model)
    assert done.columns == ["doc_id", "text", "toxicity", "_toxicity"]
    got = {(r["doc_id"], r["text"]): r["_toxicity"] for r in done.collect()}
    assert len(got) == len(rows)
    top = got[5, rows[4][1]]
    assert "gronk" in rows[4][1].encode()[top["start"]:top["end"]].decode() and top["score"] > got[4, long]["score"] + 0.1
    assert got[1, None]["score"] == got[2, ""]["score"] == got[5, None]["score"]


def test_tables_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    for known in (labels.limit(0), labels):
        model = toxicity.fit(docs, known, F.col("doc_id").isNotNull())
        assert 0 < toxicity.scored(docs, model).first()["toxicity"]["score"] < 1
    assert toxicity.scored(docs.limit(0), model).count() == 0
