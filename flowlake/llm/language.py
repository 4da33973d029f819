"""Language identification by a byte convolutional network.

A text is cut into windows of fixed length.  Bytes are embedded, filters of several widths slide over a window, the
highest answer of each filter is kept, and a softmax names the language.  Trained in numpy; the mean over all windows
of a text decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import fresh

LETTER = regex.compile(r"\p{L}")  # the same letters as in Spark SQL; numerals such as "½" are none
UNKNOWN = "und"
SLICE = 12  # documents of a language and slice of ids in the training sample


@dataclass(frozen=True)
class Shape:
    window: int = 160
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16  # of each width


def windows(data: bytes, length: int) -> np.ndarray:
    """All windows of ``data``, one after the other (n x length); the last one is filled with zeros."""
    n = max(1, -(-len(data) // length))
    return np.frombuffer(data.ljust(n * length, b"\0"), np.uint8).reshape(n, length)


class ByteNet:
    """Weights: embedding (256 x e), one kernel for all filters (widest x e x filters; narrow ones are zero at the end),
    bias, output layer."""

    def __init__(self, languages: list[str], shape: Shape = Shape(), seed: int = 5):
        self.languages, self.shape = languages, shape
        random, wide, n = np.random.default_rng(seed), max(shape.widths), shape.filters * len(shape.widths)
        self.embedding = random.normal(0, 0.5, (256, shape.embedding)).astype(np.float32)
        self.mask = np.repeat(np.array([[i < w for w in shape.widths] for i in range(wide)], np.float32), shape.filters, 1)[:, None, :]
        self.kernel = (random.normal(0, 0.3, (wide, shape.embedding, n)) * self.mask).astype(np.float32)
        self.bias, self.out = np.zeros(n, np.float32), random.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """Embedded bytes of every position and those after it: (batch x positions) rows of widest x e numbers."""
        wide, e = self.kernel.shape[:2]
        flat = self.embedding[x]
        steps = flat.shape[1] - wide + 1
        view = np.lib.stride_tricks.as_strided(flat, (len(x), steps, wide * e), (*flat.strides[:2], flat.strides[2]))
        return np.ascontiguousarray(view).reshape(-1, wide * e)

    def features(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide, e, n = self.kernel.shape
        columns = self.columns(x)
        answers = (columns @ self.kernel.reshape(wide * e, n)).reshape(len(x), -1, n)
        return columns, answers, np.maximum(answers.max(axis=1) + self.bias, 0)

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x)[2] @ self.out + self.out_bias
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 96, rate: float = 0.01, seed: int = 6) -> ByteNet:
        """Adam on the cross entropy of windows ``x`` with language numbers ``y``."""
        random, (wide, e, n) = np.random.default_rng(seed), self.kernel.shape
        names = ("embedding", "kernel", "bias", "out", "out_bias")
        m, v = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        for step in range(1, steps + 1):
            at = random.integers(0, len(x), batch)
            xb, yb = x[at], y[at]
            columns, answers, h = self.features(xb)
            z = h @ self.out + self.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(batch), yb] -= 1
            p /= batch
            dh = (p @ self.out.T) * (h > 0)
            best = answers.argmax(axis=1) + (np.arange(batch) * answers.shape[1])[:, None]  # row of ``columns`` per filter
            picked = columns[best]  # batch x n x (wide * e)
            dk = np.einsum("bn,bnk->kn", dh, picked).reshape(wide, e, n) * self.mask
            dcol = dh[:, :, None] * self.kernel.reshape(wide * e, n).T[None]
            de = np.zeros_like(self.embedding)
            row, pos = best // answers.shape[1], best % answers.shape[1]
            for i in range(wide):
                np.add.at(de, xb[row, pos + i], dcol[:, :, i * e:(i + 1) * e])
            grads = {"embedding": de, "kernel": dk, "bias": dh.sum(axis=0), "out": h.T @ p, "out_bias": p.sum(axis=0)}
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                change = now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(self, k, (getattr(self, k) - change).astype(np.float32))
        return self

    def predict(self, texts: list[str | None], batch: int = 32) -> tuple[list[str], list[float]]:
        """Language and its share of each whole text: softmax of the mean log share over all of its windows."""
        cut = [windows(t.encode(), self.shape.window) if t and LETTER.search(t) else None for t in texts]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        todo = [i for i, c in enumerate(cut) if c is not None]
        if not todo or not self.languages:
            return names, scores
        rows, owner = np.concatenate([cut[i] for i in todo]), np.repeat(np.arange(len(todo)), [len(cut[i]) for i in todo])
        logs = np.concatenate([self.log_shares(rows[a:a + batch]) for a in range(0, len(rows), batch)])
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        means = np.add.reduceat(logs.astype(np.float64), starts, axis=0) / np.bincount(owner)[:, None]
        shares = np.exp(means - means.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        for i, s in zip(todo, shares, strict=True):
            names[i], scores[i] = self.languages[int(s.argmax())], float(s.max())
        return names, scores


def fit(docs: DataFrame, learnable: Column, per_language: int = 600, pieces: int = 4, shape: Shape = Shape(),
        steps: int = 600, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteNet:
    """Train on a bounded sample: of each language at most ``per_language`` documents, the first in hash order of each of
    some slices of the ids (so no task sees a whole language), and of each at most ``pieces`` windows at hashed places.

    Rows without text, without a letter or without language teach nothing; without any there is no language to name.
    """
    key, n, length = F.xxhash64(doc_id), F.length(text), shape.window
    places = F.transform(F.sequence(F.lit(1), F.lit(pieces)), lambda i: F.substring(
        F.col(text), F.pmod(F.xxhash64(F.col(doc_id), i), F.greatest(n - length, F.lit(1))).cast("int") + 1, F.lit(length)))
    usable = (docs.where(learnable & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
              .select(lang, key.alias("key"), F.array_distinct(places).alias("parts")))
    slices = max(1, per_language // SLICE)
    order = Window.partitionBy(lang, F.pmod("key", F.lit(slices))).orderBy("key", "parts")
    first = usable.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language // slices)
    rows = first.orderBy(lang, "key", "parts").collect()
    languages = sorted({r[lang] for r in rows})
    x = [windows(p.encode(), length)[0] for r in rows for p in r["parts"] if LETTER.search(p)]
    y = [languages.index(r[lang]) for r in rows for p in r["parts"] if LETTER.search(p)]
    net = ByteNet(languages, shape)
    return net.train(np.array(x), np.array(y), steps) if x else net


def identified(docs: DataFrame, net: ByteNet, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct (lang_pred, score) for every whole text.

    A text that is null, empty or without a letter is ``und`` with score 0.  All rows and columns stay; ``name`` gets
    underscores if it is taken.
    """
    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = list(part)
            done = [net.predict(texts[a:a + 64]) for a in range(0, len(texts), 64)]
            yield pd.DataFrame({"lang_pred": [x for names, _ in done for x in names],
                                "score": [x for _, scores in done for x in scores]})

    return docs.withColumn(fresh(docs, name), run(F.coalesce(F.col(text), F.lit(""))))
