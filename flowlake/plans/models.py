"""Queries that fit and apply models on the prediction table's scores and logits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators import datasets, learning, scoring
from flowlake.plans.derived import cte, table
from flowlake.plans.registry import query
from flowlake.plans.training import SHOTS

LG = cte("logits")
FEATURES = ["l1", "m0", "m1", "m2", "m3", "m4"]


def rows(spark, sf):
    return table(spark, sf, "logits").select("row_id", "dataset", "y_true", *FEATURES)


def against_majority(scored, label, hit, margin):
    """Per dataset: rows, share of the larger class, and whether the model is right on more than that share + margin."""
    majority = F.greatest(F.avg(label), 1 - F.avg(label))
    return scored.groupBy("dataset").agg(F.count("*").alias("n"), F.round(majority, 6).alias("majority"),
                                         (F.avg(hit.cast("int")) > majority + margin).alias("beats_majority"))


def majority_sql(rows: str) -> str:
    """What SQL can say of a model that works: its rows, their majority share, and that it does better."""
    return LG + f"""SELECT dataset, count(*) AS n, round(greatest(avg(y_true), 1 - avg(y_true)), 6) AS majority, true AS beats_majority
FROM ({rows}) r GROUP BY dataset"""


SPLIT_SQL = """SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY dataset) AS cnt FROM logits"""
TEST_SQL = f"SELECT * FROM ({SPLIT_SQL}) s WHERE rn > floor(cnt * 0.9::DOUBLE)"


@query("score_random_forest", majority_sql("SELECT * FROM logits"))
def score_random_forest(spark, sf):
    df = rows(spark, sf)
    model = learning.fit_forest(datasets.split_ordered(df).filter("split = 'train'"), FEATURES, "y_true")
    scoring.register_scorer("forest", learning.forest_scorer(model))
    scored = scoring.score(df, "forest")
    return against_majority(scored, "y_true", F.col("is_attack") == (F.col("y_true") == 1), 0.05)


@query("rf_adapt", majority_sql("SELECT * FROM logits"))
def rf_adapt(spark, sf):
    df = rows(spark, sf)
    model = learning.adapt_forest(df, FEATURES, "y_true", base_trees=20)
    scored = learning.forest_scorer(model)(df)
    return against_majority(scored, "y_true", F.col("is_attack") == (F.col("y_true") == 1), 0.05)


@query("train_mlp", majority_sql(TEST_SQL))
def train_mlp(spark, sf):
    split = datasets.split_ordered(rows(spark, sf))
    model = learning.fit_mlp(split.filter("split = 'train'"), FEATURES, "y_true", iterations=15)
    tested = model.transform(split.filter("split = 'test'").repartition("row_id"))  # the last ids lie in few files
    return against_majority(tested, "y_true", F.col("prediction") == F.col("y_true"), 0.05)


@query("linear_probe", majority_sql(f"SELECT * FROM ({TEST_SQL}) t WHERE rn - floor(cnt * 0.9::DOUBLE) <= 5000"))
def linear_probe(spark, sf):
    tested = []
    for name in ("set0", "set1", "set2", "set3"):  # one probe per dataset, each on its own sample
        sample = datasets.probe_sample(rows(spark, sf), name)
        model = learning.fit_probe(sample.filter("split = 'train'"), FEATURES, "y_true")
        tested.append(model.transform(sample.filter("split = 'test'")).select("dataset", "y_true", "prediction"))
    return against_majority(reduce(DataFrame.unionByName, tested), "y_true", F.col("prediction") == F.col("y_true"), 0.05)


@query("fewshot_eval")
def fewshot_eval(spark, sf):
    by = ["holdout", "shots"]
    parts = datasets.split_few_shot(rows(spark, sf), SHOTS, "y_true")
    heads = learning.fit_heads(parts.filter("part = 'adapt'"), by, FEATURES, "y_true")
    scored = parts.filter("part = 'test'").join(heads, by).withColumn(
        "prediction", (learning.linear_score(F.col("weights"), [F.col(c) for c in FEATURES]) > 0).cast("int"))
    return learning.model_metrics(scored, "y_true", by).select(*by, "n", "accuracy", "f1_macro")


@query("anomaly_recon_error")
def anomaly_recon_error(spark, sf):
    df = rows(spark, sf)
    benign = df.filter("y_true = 0")
    model = learning.fit_reconstruction(benign, FEATURES, k=3)
    limit = learning.reconstruction_error(model, benign, len(FEATURES)).agg(
        F.percentile_approx("error", 0.95).alias("limit"))
    scored = learning.reconstruction_error(model, df, len(FEATURES))
    return scored.select("row_id", "error", (F.col("error") > limit.scalar()).alias("flagged"))


@query("federated_rounds")
def federated_rounds(spark, sf):
    _, history = learning.federated_rounds(rows(spark, sf), FEATURES, "y_true", rounds=3)
    return spark.createDataFrame(history, "round int, dataset string, n long, loss double, accuracy double")


@query("permutation_importance")
def permutation_importance(spark, sf):
    df = rows(spark, sf)
    return learning.permutation_importance(learning.fit_probe(df, FEATURES, "y_true"), df, FEATURES, "y_true")
