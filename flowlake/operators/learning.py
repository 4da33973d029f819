"""Models: forest, adaptation, MLP, linear probe, few-shot heads, anomaly score, federated rounds, importance.

MLlib does the distributed fits, but for the MLP's loss and gradient, which are numpy products in Spark tasks.  Driver loops
run over rounds only; what they hold is model parameters, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.operators.datasets import every_nth
from flowlake.operators.metrics import averaged_metrics, class_metrics
from flowlake.operators.ordered import hash_bucket, hash_text, previous_row
from flowlake.operators.scoring import FOREST_THRESHOLD, decide
from flowlake.session import settle


def _pipeline(features: list[str], label: str, estimator) -> Pipeline:
    estimator.setFeaturesCol("scaled").setLabelCol(label)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="vec"),
                            StandardScaler(inputCol="vec", outputCol="scaled", withMean=True, withStd=True), estimator])


def p_attack() -> Column:
    return vector_to_array("probability")[1]


def fit_forest(df: DataFrame, features: list[str], label: str, trees: int = 20, seed: int = 42) -> PipelineModel:
    return _pipeline(features, label, RandomForestClassifier(numTrees=trees, maxDepth=6, seed=seed)).fit(df)


def adapt_forest(df: DataFrame, features: list[str], label: str, base_trees: int, more: int = 50, every: int = 20,
                 id_col: str = "row_id") -> PipelineModel | None:
    """Refit with more trees on a systematic sample; None when the sample holds one class only."""
    sample = settle(every_nth(df.select(id_col, label, *features), every, id_col), "adapt-sample")
    if len(sample.select(label).distinct().take(2)) < 2:
        return None
    return fit_forest(sample, features, label, base_trees + more)


def forest_scorer(model: PipelineModel):
    """Scorer for the registry: attack above the fixed threshold."""
    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return out.withColumns(decide(p_attack(), FOREST_THRESHOLD)).drop(
            "vec", "scaled", "rawPrediction", "probability", "prediction")
    return score


# ---- MLP ------------------------------------------------------------------------------------------------------

def _unrolled(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of MLlib's flat weights: each layer's matrix (inputs x outputs) and intercepts."""
    views, at = [], 0
    for n, m in pairwise(layers):
        views.append((weights[at:at + n * m].reshape(n, m), weights[at + n * m:at + n * m + m]))
        at += n * m + m
    return views


def cross_entropy(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of some rows, each ``n`` times, summed, and its gradient: sigmoid layers below a softmax, as in MLlib."""
    slope = np.empty_like(weights)
    steps = [*zip(_unrolled(weights, layers), _unrolled(slope, layers), strict=True)]
    outs = [x]
    for (w, b), _ in steps:
        outs.append(outs[-1] @ w + b)
        if len(outs) < len(layers):
            outs[-1] = 1 / (1 + np.exp(-np.clip(outs[-1], -80, 80)))
    z = outs.pop()
    z -= z.max(axis=1, keepdims=True)
    delta, at = np.exp(z), np.arange(len(y))
    total = delta.sum(axis=1, keepdims=True)
    loss = float(((np.log(total[:, 0]) - z[at, y]) * n).sum(dtype=float))
    delta /= total
    delta[at, y] -= 1
    delta *= n[:, None].astype(x.dtype)
    for ((w, _), (dw, db)), h in zip(reversed(steps), reversed(outs), strict=True):
        np.matmul(h.T, delta, out=dw)
        db[:] = delta.sum(axis=0)
        if h is not x:
            delta = (delta @ w.T) * (h * (1 - h))
    return loss, slope


def mean_loss(rows: DataFrame, layers: list[int], block: int = 512, groups: int = 8) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss and gradient over rows (x array<float>, y int, n long: how often) as a function of the weights; each call is one pass.

    A task adds up its rows in blocks, products in single precision and sums in double; tasks' sums meet in ``groups``, so the
    driver gets no more than these.
    """
    fields = "part int, n long, loss double, slope binary"

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        single = weights.astype(np.float32)

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_n, loss, slope = 0, 0.0, np.zeros(len(single))
            for batch in batches:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, layers[0])
                y, n = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "n"))
                all_n += int(n.sum())
                for i in range(0, len(y), block):
                    more, step = cross_entropy(single, layers, x[i:i + block], y[i:i + block], n[i:i + block])
                    loss += more
                    slope += step
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % groups], pa.int32()), "n": [all_n],
                                              "loss": [loss], "slope": [slope.tobytes()]})

        def together(parts: pa.Table) -> pa.Table:
            slope = np.sum([np.frombuffer(s) for s in parts["slope"].to_pylist()], axis=0)
            return pa.table({"part": parts["part"][:1], "n": [sum(parts["n"].to_pylist())], "loss": [sum(parts["loss"].to_pylist())],
                             "slope": [slope.tobytes()]})

        sums = rows.mapInArrow(of_task, fields).groupBy("part").applyInArrow(together, fields).collect()
        n = sum(r.n for r in sums)
        if not n:
            raise ValueError("no rows to learn from")
        return sum(r.loss for r in sums) / n, sum(np.frombuffer(r.slope) for r in sums) / n
    return at


def lbfgs(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, iterations: int, memory: int = 10,
          tolerance: float = 1e-6) -> np.ndarray:
    """Weights after at most ``iterations`` steps of L-BFGS; each step's length meets the Wolfe conditions."""
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        if not np.abs(slope).max() > 0:
            break
        way, shares = -slope, []
        for s, g in reversed(past):
            shares.append(s @ way / (s @ g))
            way = way - shares[-1] * g
        if past:
            way = way * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]))
        for (s, g), share in zip(past, reversed(shares), strict=True):
            way = way + (share - g @ way / (s @ g)) * s
        fall, low, high = slope @ way, 0.0, np.inf
        step = 1.0 if past else 1 / np.linalg.norm(slope)
        for _ in range(20):
            there, rise = loss(w + step * way)
            if not there <= value + 1e-4 * step * fall:
                high = step
            elif rise @ way < 0.9 * fall:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * step
        if not there < value:
            break
        if (rise - slope) @ way > 0:
            past = [*past, (step * way, rise - slope)][-memory:]
        gain = value - there
        w, value, slope = w + step * way, there, rise
        if gain <= tolerance * max(abs(value), tolerance):
            break
    return w


def fit_mlp(df: DataFrame, features: list[str], label: str, hidden: list[int] = (256, 128, 64), classes: int = 2,
            iterations: int = 50, seed: int = 42) -> PipelineModel:
    """MLlib's network, from its first weights, over all rows.

    Its own fit multiplies in the JVM, far below the speed of a core, and in as many tasks as the input has files; here each
    pass over the rows is numpy in even Spark tasks, and the weights go back into MLlib's model.  Rows equal in all features
    and the label are one row with a count, so the loss is that of all rows.
    """
    layers = [len(features), *hidden, classes]
    scaler = Pipeline(stages=_pipeline(features, label, MultilayerPerceptronClassifier()).getStages()[:-1]).fit(df)
    y = F.col(label).cast("double")
    known = F.when((y >= 0) & (y < classes) & (y == F.floor(y)), y.cast("int")).otherwise(F.raise_error(F.lit(f"{label} must be 0 to {classes - 1}")))
    rows = scaler.transform(df).select(vector_to_array("scaled", "float32").alias("x"), known.alias("y"))
    rows = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    rows = settle(rows.repartition(4 * df.sparkSession.sparkContext.defaultParallelism), "mlp-rows")

    def network(weights: list[float] | None = None):
        """MLlib's model with these weights, or its seeded first ones: a fit of no step."""
        mlp = MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=seed, featuresCol="scaled", labelCol=label)
        if weights is not None:
            mlp.setInitialWeights(Vectors.dense(weights))
        any_row = df.sparkSession.createDataFrame([(Vectors.dense([0.0] * len(features)), 0.0)], ["scaled", label])
        return mlp.fit(any_row)

    found = lbfgs(mean_loss(rows, layers), network().weights.toArray(), iterations)
    return PipelineModel([*scaler.stages, network(found.tolist())])


def fit_probe(df: DataFrame, features: list[str], label: str) -> PipelineModel:
    return _pipeline(features, label, LogisticRegression(maxIter=200)).fit(df)


def model_metrics(scored: DataFrame, label: str, by: list[str] = ()) -> DataFrame:
    """Accuracy and F1 averages of a model's ``prediction``."""
    typed = scored.withColumns({"__t": F.col(label).cast("int"), "__p": F.col("prediction").cast("int")})
    return averaged_metrics(class_metrics(typed, "__t", "__p", by), by)


# ---- few-shot heads -------------------------------------------------------------------------------------------

def _descend(x: np.ndarray, y: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Logistic regression by gradient descent; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w -= rate * x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y)
    return w


def fit_heads(adapt: DataFrame, by: list[str], features: list[str], label: str, steps: int = 300,
              rate: float = 0.5) -> DataFrame:
    """One logistic head per group: (by..., weights).  Groups are few-shot samples, at most shots x classes rows."""
    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w = _descend(pdf[features].to_numpy(float), pdf[label].to_numpy(float), steps, rate)
        return pd.DataFrame([[*key, w.tolist()]], columns=[*by, "weights"])

    keys = adapt.select(*by).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", weights array<double>"
    return adapt.groupBy(*by).applyInPandas(fit, schema)


def linear_score(weights: Column, features: list[Column]) -> Column:
    """w . x + intercept, the intercept being the last weight."""
    terms = [weights[i] * x for i, x in enumerate(features)]
    return sum(terms[1:], terms[0]) + weights[len(features)]


# ---- anomaly --------------------------------------------------------------------------------------------------

def fit_reconstruction(benign: DataFrame, features: list[str], k: int) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="vec"),
                            StandardScaler(inputCol="vec", outputCol="scaled", withMean=True, withStd=True),
                            PCA(k=k, inputCol="scaled", outputCol="part")]).fit(benign)


def reconstruction_error(model: PipelineModel, df: DataFrame, width: int) -> DataFrame:
    """Mean squared distance to the principal subspace: (|x|^2 - |Vx|^2) / width, since V is orthonormal."""
    norm = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, v: a + v * v)
    return model.transform(df).withColumn("error", F.greatest(
        (norm("scaled") - norm("part")) / width, F.lit(0.0))).drop("vec", "scaled", "part")


# ---- federated rounds -----------------------------------------------------------------------------------------

def _weights_by_silo(weights: dict[str, list[float]], silo: str) -> Column:
    """Parameters of the row's silo as a map literal; one short array per silo."""
    pairs = [x for name, w in weights.items() for x in (F.lit(name), F.array(*[F.lit(float(v)) for v in w]))]
    return F.create_map(*pairs)[F.col(silo)]


def federated_rounds(df: DataFrame, features: list[str], label: str, rounds: int, local_steps: int = 2,
                     rate: float = 0.5, mu: float = 0.01, silo: str = "dataset") -> tuple[list[float], list[tuple]]:
    """Logistic model trained by silos in rounds: (global weights, history).

    Each local step is one aggregation that yields the mean gradient per silo, so a silo's rows stay spread over the
    cluster.  A pull of ``mu`` keeps silo weights near the global ones; after ``local_steps`` they are averaged with
    row counts as weights.  History rows: (round, silo, n, loss, accuracy) of the global model.
    """
    n = len(features)
    rows = settle(df.select(silo, F.col(label).cast("double").alias("y"), *[F.col(c).cast("double") for c in features]),
                  "silos")
    sizes = {r[silo]: r["n"] for r in rows.groupBy(silo).agg(F.count("*").alias("n")).collect()}
    xs = [F.col(c) for c in features]
    total = sum(sizes.values())
    shared = [0.0] * (n + 1)
    history = []
    for number in range(1, rounds + 1):
        local = {s: list(shared) for s in sizes}
        for _ in range(local_steps):
            p = 1 / (1 + F.exp(-linear_score(F.col("w"), xs)))
            slope = rows.withColumn("w", _weights_by_silo(local, silo)).withColumn("r", p - F.col("y"))
            grads = slope.groupBy(silo).agg(*[F.avg(F.col("r") * x).alias(f"g{i}") for i, x in enumerate([*xs, F.lit(1.0)])])
            for g in grads.collect():
                w = local[g[silo]]
                local[g[silo]] = [v - rate * (g[f"g{i}"] + mu * (v - s)) for i, (v, s) in enumerate(zip(w, shared))]
        shared = [sum(local[s][i] * sizes[s] for s in sizes) / total for i in range(n + 1)]
        z = linear_score(F.array(*[F.lit(v) for v in shared]), xs)
        loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * F.col("y")
        right = ((z > 0).cast("double") == F.col("y")).cast("double")
        for r in rows.groupBy(silo).agg(F.count("*").alias("n"), F.avg(loss).alias("loss"), F.avg(right).alias("acc")).collect():
            history.append((number, r[silo], r["n"], r["loss"], r["acc"]))
    return shared, history


# ---- importance -----------------------------------------------------------------------------------------------

def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], label: str,
                           seed: str = "42", id_col: str = "row_id") -> DataFrame:
    """Accuracy drop per feature when its values are exchanged between rows.

    Rows are put in a seeded random order once, and every row takes the feature from the row before it; each feature
    is then one more scored copy of the rows.
    """
    keyed = df.select(id_col, label, *features).withColumn("__h", hash_text(seed, id_col)).withColumn(
        "__b", hash_bucket(F.col("__h")))
    near = previous_row(keyed, [], ["__h", id_col], features, "donor", "__b")
    copies = near.withColumn("feature", F.explode(F.array(F.lit("none"), *[F.lit(c) for c in features])))
    mixed = copies.withColumns({c: F.when((F.col("feature") == c) & F.col("donor").isNotNull(), F.col(f"donor.{c}"))
                               .otherwise(F.col(c)) for c in features})
    acc = model.transform(mixed).groupBy("feature").agg(
        F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))
    acc = settle(acc, "importance")
    base = acc.filter("feature = 'none'").select(F.col("accuracy").alias("base"))
    return acc.filter("feature <> 'none'").select("feature", (base.scalar() - F.col("accuracy")).alias("importance"))

