"""Models on separable data, and hand-computed references for what is computed by formula."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from flowlake.operators import learning, scoring


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(_data(), "row_id long, dataset string, x1 double, x2 double, y int")


def _data():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    return [(i, "a" if i % 5 == 0 else "b", float(a), float(b), int(a + 0.1 * b > 0.2)) for i, (a, b) in enumerate(x)]


def test_forest_and_adaptation(rows):
    model = learning.fit_forest(rows, ["x1", "x2"], "y", trees=5)
    scored = learning.forest_scorer(model)(rows)
    assert set(scoring.OUTPUT) <= set(scored.columns)
    assert scored.filter((F.col("confidence") > 0.4) != F.col("is_attack")).count() == 0
    assert scored.agg(F.avg((F.col("is_attack").cast("int") == F.col("y")).cast("double"))).first()[0] > 0.9
    adapted = learning.adapt_forest(rows, ["x1", "x2"], "y", base_trees=2, more=3, every=4)
    assert adapted.stages[-1].getNumTrees == 5
    assert learning.adapt_forest(rows.withColumn("y", F.lit(1)), ["x1", "x2"], "y", 2) is None


def test_probe_and_importance(rows):
    model = learning.fit_probe(rows, ["x1", "x2"], "y")
    row = learning.model_metrics(model.transform(rows), "y").first()
    assert row.accuracy > 0.95 and row.f1_macro > 0.95
    drop = {r.feature: r.importance for r in learning.permutation_importance(model, rows, ["x1", "x2"], "y").collect()}
    assert drop["x1"] > 0.2 > drop["x2"]


def test_mlp_gradient_equals_differences_and_rows_are_spread(spark):
    rng, layers = np.random.default_rng(3), [2, 4, 3, 2]
    x, y, n = rng.normal(size=(50, 2)), rng.integers(0, 2, 50), rng.integers(1, 5, 50)
    w = rng.normal(size=2 * 4 + 4 + 4 * 3 + 3 + 3 * 2 + 2)
    loss, slope = learning.cross_entropy(w, layers, x, y, n)
    again = learning.cross_entropy(w, layers, x.repeat(n, axis=0), y.repeat(n), np.ones(n.sum()))
    assert np.isclose(loss, again[0]) and np.allclose(slope, again[1])
    off = np.eye(len(w)) * 1e-6
    near = [(learning.cross_entropy(w + e, layers, x, y, n)[0] - learning.cross_entropy(w - e, layers, x, y, n)[0]) / 2e-6 for e in off]
    assert np.allclose(slope, near, atol=1e-5)
    df = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, n)], "x array<float>, y int, n long").repartition(13)
    mean, way = learning.mean_loss(df, layers, block=3, groups=2)(w)  # blocks and groups smaller than tasks
    assert np.isclose(mean, loss / n.sum(), rtol=1e-5) and np.allclose(way, slope / n.sum(), atol=1e-5)


def test_mlp_fits_as_well_as_mllib_in_as_many_steps(spark, rows):
    hidden, steps = [8, 4], 40
    ours = learning.fit_mlp(rows.coalesce(1), ["x1", "x2"], "y", hidden, iterations=steps)
    theirs = learning._pipeline(["x1", "x2"], "y", MultilayerPerceptronClassifier(
        layers=[2, *hidden, 2], maxIter=steps, seed=42, blockSize=512)).fit(rows)
    loss = lambda m: m.transform(rows).agg(F.avg(-F.log(F.when(F.col("y") == 1, learning.p_attack()).otherwise(1 - learning.p_attack())))).first()[0]
    assert loss(ours) < loss(theirs) + 0.02 < 0.2
    assert learning.model_metrics(ours.transform(rows), "y").first().accuracy > 0.95
    with pytest.raises(Exception, match="y must be 0 to 1"):
        learning.fit_mlp(rows.withColumn("y", F.lit(2)), ["x1", "x2"], "y", hidden)


def test_mlp_products_run_in_even_tasks(spark, rows, monkeypatch):
    """One pass of all rows per loss, in many tasks also when the input is one file; equal rows go as one with a count."""
    seen = []
    whole = learning.mean_loss
    monkeypatch.setattr(learning, "mean_loss", lambda r, layers: seen.append(r) or whole(r, layers))
    learning.fit_mlp(rows.union(rows.filter("row_id < 100")).coalesce(1), ["x1", "x2"], "y", [3], iterations=1)
    assert seen[0].count() == rows.count() and seen[0].groupBy("n").count().orderBy("n").collect() == [(1, 500), (2, 100)]
    assert seen[0].select(F.input_file_name()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_federated_rounds_equal_numpy(rows):
    got, history = learning.federated_rounds(rows, ["x1", "x2"], "y", rounds=2, local_steps=2, rate=0.5, mu=0.1)
    data = _data()
    parts = {s: (np.array([[d[2], d[3], 1.0] for d in data if d[1] == s]), np.array([d[4] for d in data if d[1] == s])) for s in "ab"}
    shared = np.zeros(3)
    for _ in range(2):
        local = {}
        for s, (x, y) in parts.items():
            w = shared.copy()
            for _ in range(2):
                w = w - 0.5 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + 0.1 * (w - shared))
            local[s] = w
        shared = sum(local[s] * len(parts[s][1]) for s in parts) / len(data)
    assert np.allclose(got, shared)
    assert [h[:3] for h in sorted(history)] == [(1, "a", 120), (1, "b", 480), (2, "a", 120), (2, "b", 480)]
    assert max(h[3] for h in history if h[0] == 2) < max(h[3] for h in history if h[0] == 1)


def test_reconstruction_error_flags_the_unusual(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=300)
    normal = [(float(a), float(2 * a + e)) for a, e in zip(z, rng.normal(scale=0.01, size=300))]
    train = spark.createDataFrame(normal, "x double, y double")
    model = learning.fit_reconstruction(train, ["x", "y"], k=1)
    errors = learning.reconstruction_error(model, spark.createDataFrame([(1.0, 2.0), (1.0, -2.0)], "x double, y double"), 2)
    near, far = [r.error for r in errors.collect()]
    assert near < 0.01 < 0.5 < far


def test_few_shot_heads(rows):
    heads = learning.fit_heads(rows.filter("row_id < 100").withColumn("shots", F.lit(50)), ["dataset", "shots"], ["x1", "x2"], "y")
    scored = rows.join(heads, "dataset").withColumn("prediction", (learning.linear_score(F.col("weights"), [F.col("x1"), F.col("x2")]) > 0).cast("int"))
    assert learning.model_metrics(scored, "y").first().accuracy > 0.85
