"""Toxicity by compression distance.

Two zstandard dictionaries are built, from toxic and from ordinary labelled text.  A text is cut into windows and each
window is compressed with both; how many bytes the toxic dictionary saves against the ordinary one tells how toxic the
window is.  The strongest window, the mean, and the savings added up go through a logistic curve fitted on other
labelled documents.

A few toxic words save a few bytes, so all else must cost the same with both dictionaries:

* both begin with the same frequent words of ordinary text, and end with what is typical for their class alone, the
  shorter one padded, so that a match in the common part has one offset in both;
* windows stay below 64 bytes, where this strategy stores literals as they are, so a match saves its length;
* every window is followed by the same ``TAIL``, which both dictionaries hold, so no window is stored uncompressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import first_by_hash, fresh
from flowlake.llm.quality_model import logistic
from flowlake.session import settle

WINDOW = 62  # bytes of a window
TAIL = bytes(range(0x80, 0xB0))  # never in this order in UTF-8
PAD = b"\x01"
COMMON_BYTES, TYPICAL_BYTES = 1 << 15, 1 << 15
MOST_WORDS = 8192  # of one kind in a dictionary
N_FEATURES = 4


@dataclass(frozen=True)
class Model:
    """Dictionary contents and the weights of the curve (see ``Scorer.features``)."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    @classmethod
    def of(cls, common: bytes, toxic: bytes, ordinary: bytes, weights: tuple[float, ...]) -> Model:
        size = max(len(toxic), len(ordinary), 16)
        return cls(*(common + x.rjust(size, PAD) + TAIL for x in (toxic, ordinary)), weights)


def windows(data: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Places of consecutive windows of at most ``size`` bytes, cut at a space in their second half if there is one."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            space = data.rfind(b" ", at + size // 2, end)
            end = space if space > 0 else end
        yield at, min(end, len(data))
        at = end


class Scorer:
    """The compressors of a model.  ASCII letters count as lower case, so places in the text stay what they are."""

    def __init__(self, model: Model):
        settings = zstandard.ZstdCompressionParameters(
            window_log=17, chain_log=16, hash_log=16, search_log=6, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_dict_id=False, write_checksum=False)
        self.packers = []
        for content in (model.ordinary, model.toxic):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=settings)
            self.packers.append(zstandard.ZstdCompressor(dict_data=known, compression_params=settings))

    def saved(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves on a window."""
        ordinary, toxic = (len(p.compress(window + TAIL)) for p in self.packers)
        return ordinary - toxic

    def features(self, text: str | None) -> tuple[float, float, float, float, int, int]:
        """Strongest window, mean of the windows, savings above one byte by the root of the length, log of the length; then
        the place of the strongest window in bytes."""
        data = (text or "").encode().lower()
        if not data:
            return (0.0, 0.0, 0.0, 0.0, 0, 0)
        places = list(windows(data, WINDOW))
        saved = np.array([self.saved(data[lo:hi]) for lo, hi in places])
        top = int(saved.argmax())
        return (float(saved[top]), float(saved.mean()), float(np.maximum(saved - 1, 0).sum() / np.sqrt(len(data))),
                float(np.log1p(len(data))), *places[top])


def word_counts(sample: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """Per word of three letters or more: in how many texts of each class it is (``n1`` toxic, ``n0`` ordinary)."""
    lower = F.translate(F.col(text), ascii_uppercase, ascii_lowercase)
    words = sample.select(doc_id, label, F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(r"\p{L}{3,}"), 0))).alias("word"))
    return words.groupBy("word").agg(F.sum(label).alias("n1"), F.sum(1 - F.col(label)).alias("n0"))


def surprise(mine: Column, others: Column, share: float) -> Column:
    """Log-likelihood ratio of a word's counts against the class's ``share`` of the texts."""
    both = mine + others
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    return 2 * (part(mine, both * share) + part(others, both * (1 - share)))


def content(words: DataFrame, by: str, most: int) -> bytes:
    """The words with the highest ``by``, the highest last (nearest to the text), up to ``most`` bytes."""
    kept, size = [], 1
    for r in words.orderBy(F.desc(by), "word").limit(MOST_WORDS).collect():
        size += len(r["word"].encode()) + 1
        if size > most:
            break
        kept.append(r["word"])
    return (" " + " ".join(reversed(kept)) + " ").encode() if kept else b""


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = 6000, least_surprise: float = 24.0, ratio: float = 8.0,
        doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample: at most ``per_class`` labelled documents of each class, the first in hash order.

    Words of two thirds of them are counted by Spark; at most 3 x 8,192 of them reach the driver for the dictionaries:
    the most frequent of ordinary text, and those that are ``ratio`` times as frequent in one class as in the other with a
    log-likelihood ratio of at least ``least_surprise``.  The whole texts of the other third calibrate the curve, at most
    2 x per_class rows of numbers, of which the toxic ones weigh half-way (in log odds) between equal classes and their
    share of all labels.  Rows that are not ``learnable``, have no text or a label other than 0 and 1 are left out; without both
    classes the score is the same for all texts.
    """
    known = labels.where(learnable & F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.min(label).alias(label))
    shares = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}  # at most two rows
    prior = float(np.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 1)))
    flat = Model.of(b"", b"", b"", (0.0,) * N_FEATURES + (prior,))
    if len(shares) < 2:
        return flat
    picked = [first_by_hash(known.where(F.col(label) == v), [F.col(doc_id)], per_class) for v in (0, 1)]
    third = F.pmod(F.xxhash64(doc_id, F.lit("third")), F.lit(3))
    # bounded by 2 x per_class rows of two numbers
    sample = docs.select(doc_id, text).where(F.length(text) > 0).join(F.broadcast(picked[0].union(picked[1])), doc_id)
    learnt = sample.where(third < 2)
    n = {r[label]: r["count"] for r in learnt.groupBy(label).count().collect()}
    if len(n) < 2:
        return flat
    words = settle(word_counts(learnt, doc_id, text, label), "toxicity-words")
    typical = []
    for mine, others, n_mine, n_others in (("n1", "n0", n[1], n[0]), ("n0", "n1", n[0], n[1])):
        a, b = F.col(mine).cast("double"), F.col(others).cast("double")
        typical.append(content(words.where(((a + 0.5) / (n_mine + 1) >= ratio * (b + 0.5) / (n_others + 1))
                                           & (surprise(a, b, n_mine / (n_mine + n_others)) >= least_surprise)), mine, TYPICAL_BYTES))
    model = Model.of(content(words.where("length(word) > 3"), "n0", COMMON_BYTES), *typical, flat.weights)
    rest = (with_features(sample.where(third == 2), model, text, "f").select(doc_id, label, "f")
            .orderBy(F.xxhash64(doc_id), "f").limit(2 * per_class).collect())
    y = np.array([r[label] for r in rest], dtype=float)
    if not 0 < y.sum() < len(y):
        return model
    *slopes, offset = logistic(np.array([[*r["f"]][:N_FEATURES] for r in rest]), y)
    balance = float(np.log(y.sum() / (len(y) - y.sum())))
    return replace(model, weights=(*slopes, offset - balance + prior / 2))


def with_features(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    @F.pandas_udf("struct<top:double,mean:double,above:double,log_bytes:double,start:long,end:long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for part in parts:
            yield pd.DataFrame([scorer.features(t) for t in part], columns=["top", "mean", "above", "log_bytes", "start", "end"])

    return docs.withColumn(name, run(F.coalesce(F.col(text), F.lit(""))))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``name``: ``score`` of the whole text (0 to 1, higher is more toxic), and the savings and
    place (first and last byte + 1 of its UTF-8) of the strongest window.

    Null and empty texts have no window; their score is that of a text without savings.  All rows and columns stay;
    ``name`` gets underscores if it is taken.
    """
    name = fresh(docs, name)
    out = with_features(docs, model, text, name)
    *slopes, offset = model.weights
    total = sum((F.col(f"{name}.{f}") * w for f, w in zip(("top", "mean", "above", "log_bytes"), slopes, strict=True)), F.lit(offset))
    return out.withColumn(name, F.struct((1 / (1 + F.exp(-total))).alias("score"), F.col(f"{name}.top").alias("saved"),
                                         F.col(f"{name}.start").alias("start"), F.col(f"{name}.end").alias("end")))
