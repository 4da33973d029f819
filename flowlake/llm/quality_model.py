"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled text.  A text is compressed with both, chunk by
chunk; the difference of the sizes per byte tells which of them it resembles, and a logistic curve fitted on other
labelled documents turns it into a score.  How much a difference says depends on the length, so the curve knows that too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import first_by_hash, fresh

PIECE = 2048  # characters of a dictionary sample


@dataclass(frozen=True)
class Model:
    """Dictionaries (empty without labels of both classes) and the weights of the logistic curve (see ``features``)."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    chunk: int = 1024
    level: int = 3

    def packers(self) -> list[zstandard.ZstdCompressor]:
        return [zstandard.ZstdCompressor(level=self.level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(d))
                if d else zstandard.ZstdCompressor(level=self.level) for d in (self.good, self.bad)]

    def difference(self, text: str | None, packers: list[zstandard.ZstdCompressor]) -> float:
        """Bytes that the good dictionary saves against the bad one, per byte of the whole text; 0 for no text."""
        data = (text or "").encode()
        if not data:
            return 0.0
        good, bad = (sum(len(p.compress(data[a:a + self.chunk])) for a in range(0, len(data), self.chunk)) for p in packers)
        return (bad - good) / len(data)


def features(difference, log_bytes) -> list:
    """Inputs of the curve besides the constant: the difference, the log of the length, and their product."""
    return [difference, log_bytes, difference * log_bytes]


def trained_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of ``size`` bytes; from few samples their plain content."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weights of the columns of ``x`` and the constant by Newton steps, with a small ridge on the scaled columns."""
    if y.min() == y.max():
        return (*[0.0] * x.shape[1], math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    middle, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    a = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.diag([*[ridge * len(x)] * x.shape[1], 1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[:-1] / scale
    return (*map(float, slopes), float(w[-1] - slopes @ middle))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = 1600, dictionary_bytes: int = 112 * 1024,
        doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on a bounded sample: at most ``per_class`` labelled documents of each class, the first in hash order.

    Of half of them one piece of 2,048 characters each goes into the dictionaries, without the lines that pieces of both
    classes have; the whole texts of the other half
    calibrate, so at most 2 x per_class / 2 pieces and as many numbers reach the driver.  Rows that are not
    ``learnable``, have no text, or a label other than 0 and 1 are left out.  Without both labels the curve is flat.
    """
    known = labels.where(learnable & F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.min(label).alias(label))
    picked = None
    for value in (0, 1):
        part = first_by_hash(known.where(F.col(label) == value), [F.col(doc_id)], per_class)
        picked = part if picked is None else picked.union(part)
    # bounded by 2 x per_class rows of two numbers
    sample = (docs.select(doc_id, text).where(F.length(text) > 0)
              .join(F.broadcast(picked), doc_id).withColumn("half", F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2))))
    n = F.ceil(F.length(text) / PIECE).cast("int")
    at = F.pmod(F.xxhash64(doc_id, F.lit("piece")), n) * PIECE + 1
    pieces = (sample.where("half = 0").select(doc_id, label, F.substring(F.col(text), at.cast("int"), F.lit(PIECE)).alias("piece"))
              .orderBy(F.xxhash64(doc_id), "piece").limit(2 * per_class).collect())
    lines = {v: [r["piece"].split("\n") for r in pieces if r[label] == v] for v in (0, 1)}
    shared = set(chain(*lines[0])) & set(chain(*lines[1]))  # boilerplate of both classes says nothing about either
    of_class = {v: [t.encode() for x in lines[v] if (t := "\n".join(y for y in x if y not in shared))] for v in (0, 1)}
    if not all(of_class.values()):
        return Model(b"", b"", (0.0, 0.0, 0.0, math.log((len(of_class[1]) + 1) / (len(of_class[0]) + 1))))
    model = Model(trained_dictionary(of_class[1], dictionary_bytes), trained_dictionary(of_class[0], dictionary_bytes), (0.0,) * 4)
    rest = (with_difference(sample.where("half = 1"), model, text, "difference").select(
        doc_id, label, "difference", log_bytes(text).alias("n")).orderBy(F.xxhash64(doc_id), "difference").limit(2 * per_class).collect())
    if not rest:
        return Model(model.good, model.bad, (0.0, 0.0, 0.0, math.log((len(of_class[1]) + 1) / (len(of_class[0]) + 1))))
    x = np.column_stack(features(*np.array([(r["difference"], r["n"]) for r in rest]).T))
    return Model(model.good, model.bad, logistic(x, np.array([r[label] for r in rest], dtype=float)))


def log_bytes(text: str) -> Column:
    return F.log1p(F.coalesce(F.octet_length(text), F.lit(0)).cast("double"))


def with_difference(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packers = model.packers()
        for part in parts:
            yield part.map(lambda t: model.difference(t, packers)).astype("float64")

    return docs.withColumn(name, run(F.coalesce(F.col(text), F.lit(""))))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text (0 to 1, higher is better); a null or empty text counts as difference 0.

    All rows and columns stay; ``name`` gets underscores if it is taken.
    """
    name = fresh(docs, name)
    out = with_difference(docs, model, text, name)
    *slopes, offset = model.weights
    sum_ = sum((f * w for f, w in zip(features(F.col(name), log_bytes(text)), slopes, strict=True)), F.lit(offset))
    return out.withColumn(name, 1 / (1 + F.exp(-sum_)))
