"""Quality rules on compression bands, beside word, symbol and repetition counts.

Zstandard ratios of the whole text and of fixed chunks must lie in a band that depends on the length: text that
shrinks too far repeats itself, text that hardly shrinks is noise.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import fresh

SYMBOLS, WHITE = "#*$%&|<>", " \t\n\v\f\r"
RULE_COLUMNS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                "base_failed boolean, ratio double, chunk_low double, chunk_high double, kept boolean")


@dataclass(frozen=True)
class Bands:
    """Limits of compressed / plain bytes by length: ``limits[i]`` holds below ``lengths[i]``, the last one above all.

    Chunks have ``chunk`` bytes, the rest of a text joins its last chunk; the lowest and the highest chunk ratio must
    lie in ``chunk_limits``.  Short texts carry the overhead of a frame and a cold window, so their bands lie higher;
    their upper limits lie between the ratios of prose in four languages and those of random letters and digits.
    """

    lengths: tuple[int, ...] = (150, 200, 256, 320, 400, 512, 700, 1024, 1500, 2048, 4096, 16384)
    limits: tuple[tuple[float, float], ...] = (
        (0.35, 0.99), (0.35, 0.93), (0.35, 0.90), (0.28, 0.86), (0.28, 0.83), (0.28, 0.80), (0.28, 0.77), (0.28, 0.74),
        (0.24, 0.70), (0.24, 0.66), (0.24, 0.65), (0.20, 0.72), (0.15, 0.70))
    chunk: int = 2048
    chunk_limits: tuple[float, float] = (0.20, 0.75)
    level: int = 3


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which is found twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def judged(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """One row of ``RULE_COLUMNS``."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes.split() knows ASCII white space only
    n, chars = len(words), len(text) - sum(text.count(c) for c in WHITE)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    ratio, chunks = 1.0, [1.0]
    if data:
        ratio = len(packer.compress(data)) / len(data)
        starts = range(0, max(1, len(data) - bands.chunk + 1), bands.chunk)
        ends = [*starts[1:], len(data)]
        chunks = [len(packer.compress(data[a:b])) / (b - a) for a, b in zip(starts, ends, strict=True)] if len(starts) > 1 else [ratio]
    low, high = bands.limits[bisect_right(bands.lengths, len(data))]
    failed = n < 50 or 100 * repeats > 50 * n
    fits = low <= ratio <= high and (len(chunks) == 1 or bands.chunk_limits[0] <= min(chunks) and max(chunks) <= bands.chunk_limits[1])
    return (n, chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeats, failed, ratio,
            min(chunks), max(chunks), not failed and fits)


def apply_rules(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """``docs`` with the counts, ratios and verdict of every whole text in a struct column ``rules``.

    A null or empty text has no words and fails the base rule; all rows and columns stay.
    """
    @F.pandas_udf(RULE_COLUMNS)
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        names = [x.split()[0] for x in RULE_COLUMNS.split(", ")]
        for texts in parts:
            yield pd.DataFrame([judged(t, bands, packer) for t in texts], columns=names)

    return docs.withColumn(fresh(docs, "rules"), judge(F.col(text)))
