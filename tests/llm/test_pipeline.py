"""Each stage of the pipeline against its operator or a brute-force reading, on its own input."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from flowlake.llm import mixing, neardup, quality_model, secrets
from flowlake.llm.queries import ORACLES, QUERIES, fitted_quality
from flowlake.session import settle
from tests.conftest import MIDDLE, SMALL
from tests.llm.rows import awkward_docs, no_docs
from tests.llm.test_neardup import brute

TABLES = ["documents", "embeddings", "pages", "labels"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(rel.fetchall())


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    stages = dict(pipe.STAGES)

    good = settle(stages["quality"](spark, docs, MIDDLE), "t")
    assert good.columns == docs.columns
    score = quality_model.scored(docs, fitted_quality(spark, MIDDLE, docs))
    assert sorted(good.collect()) == sorted(score.where("score >= 0.7").select(*docs.columns).collect())

    one = settle(stages["near_duplicates"](spark, good, MIDDLE), "t")
    group = brute([(r["doc_id"], r["text"]) for r in good.collect()])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, (_, c) in group.items() if i == c)
    assert one.columns == docs.columns

    clean = settle(stages["secrets"](spark, one, MIDDLE), "t")
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in (one, clean))
    assert before.keys() == after.keys() and clean.columns == docs.columns
    touched = [i for i in before if before[i] != after[i]]
    assert touched and all(after[i]["n_chars"] == len(after[i]["text"]) and "[REDACTED]" in after[i]["text"] for i in touched)
    again = secrets.digest(secrets.scan(clean, secrets.create_ledger(spark, pipe.new_path(spark, "l")))).where("n_access + n_hex > 0")
    assert again.count() == 0

    mixed = settle(stages["mix"](spark, clean, MIDDLE), "t")
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert got == Counter({k: v for k, v in want.items() if v}) and mixed.columns == docs.columns

    packed = stages["pack"](spark, mixed, MIDDLE)
    assert Counter(r["doc_id"] for r in packed.collect()) == got
    assert sorted(map(str, packed.collect())) == sorted(map(str, pipe.run(spark, MIDDLE).collect()))


def test_awkward_rows_pass_every_stage(spark):
    for docs, n in ((awkward_docs(spark), 14), (no_docs(spark), 0)):
        for name, stage in pipe.STAGES:
            out = settle(stage(spark, docs, SMALL), f"t-{name}")
            assert name == "pack" or out.columns == docs.columns
            if name == "near_duplicates":
                assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(
                    [1, 4, 5, 6, 7, 9, 10, None, 11, 11, 12] if n else [], key=str)
            if name == "secrets":
                assert out.count() == n


def test_no_link_between_kept_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = pipe.keep_one_of_each_group(spark, docs, SMALL)
    assert neardup.near_duplicates(kept).where(~F.col("kept")).count() == 0
