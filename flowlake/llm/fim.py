"""Fill-in-the-middle: a text is cut at two unit boundaries and its parts are put in another order around sentinels.

Over blocks of ``BLOCK`` bytes two Fenwick trees hold how many units end and how many code points begin in each.  A
cut after k units descends the unit tree by binary lifting to the block in which the k-th unit ends, finds the boundary
inside that block alone, and reads the code points before it from the other tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import fresh

BLOCK = 1024  # bytes of a block
UNITS = ("line", "char")


class Fenwick:
    """Prefix sums of counts per block, with search for the block that holds the k-th counted thing."""

    def __init__(self, counts: np.ndarray):
        sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        at = np.arange(len(sums))
        self.tree, self.top = (sums - sums[at - (at & -at)]).tolist(), 1 << max(len(counts).bit_length() - 1, 0)

    def before(self, block: int) -> int:
        """Sum over the blocks before ``block``."""
        total = 0
        while block:
            total += self.tree[block]
            block &= block - 1
        return total

    def find(self, k: int) -> tuple[int, int]:
        """The block of the k-th thing (from 1; k within the total), and how many things the blocks before it hold."""
        at, seen, step = 0, 0, self.top
        while step:
            nxt = at + step
            if nxt < len(self.tree) and seen + self.tree[nxt] < k:
                at, seen = nxt, seen + self.tree[nxt]
            step >>= 1
        return at, seen


class Cuts:
    """Unit boundaries of one text.  A line ends after its newline, the last one at the end of the text."""

    def __init__(self, text: str, unit: str = "line", block: int = BLOCK):
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}")
        data = np.frombuffer(text.encode(), np.uint8)
        starts = (data & 0xC0) != 0x80  # first bytes of code points
        if unit == "line":
            ends = data == 0x0A
        else:
            ends = np.append(starts[1:], True)[:len(data)]
        self.block, self.ends, self.starts = block, ends, starts
        edges = np.arange(0, len(data), block)
        per_block = [np.add.reduceat(x, edges, dtype=np.int64) if len(data) else np.zeros(0, np.int64) for x in (ends, starts)]
        self.unit_tree, self.char_tree = (Fenwick(x) for x in per_block)
        self.closed, self.n_chars = (int(x.sum()) for x in per_block)
        self.n = self.closed + int(len(data) > 0 and not ends[-1])

    def chars_before(self, k: int) -> int:
        """Code points of the first k units."""
        if k <= 0:
            return 0
        if k > self.closed:  # the last unit has no end mark of its own
            return self.n_chars
        at, seen = self.unit_tree.find(k)
        lo = at * self.block
        end = int(np.flatnonzero(self.ends[lo:lo + self.block])[k - seen - 1]) + 1
        return self.char_tree.before(at) + int(np.count_nonzero(self.starts[lo:lo + end]))


@dataclass(frozen=True)
class Format:
    """Sentinels and rates: of 100 texts ``rate`` are transformed, of 100 of these ``spm_rate`` put the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 100
    spm_rate: int = 50
    seed: int = 7

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or not all(marks) or any(m[0] in other[1:] for m in marks for other in marks):
            raise ValueError("sentinels must differ, and none may hold another's first character after its own first")

    def found_in(self, text: Column) -> Column:
        return F.contains(text, F.lit(self.prefix)) | F.contains(text, F.lit(self.suffix)) | F.contains(text, F.lit(self.middle))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the id (a null id counts as '')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def part(text: Column, start: Column, n: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), n.cast("int"))


def restored(output: Column, form: Column, fmt: Format = Format()) -> Column:
    """The text back from a transformed one: parts between the sentinels, in their first order."""
    first = F.when(form == "psm", F.lit(fmt.prefix)).otherwise(F.lit(fmt.suffix))
    second = F.when(form == "psm", F.lit(fmt.suffix)).otherwise(F.lit(fmt.prefix))
    at2, at3 = F.position(second, output), F.position(F.lit(fmt.middle), output)
    one = F.substring(output, F.length(first) + 1, at2 - F.length(first) - 1)
    two = F.substring(output, at2 + F.length(second), at3 - at2 - F.length(second))
    three = F.substring(output, at3 + len(fmt.middle), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def transform(docs: DataFrame, fmt: Format = Format(), unit: str = "line", doc_id: str = "doc_id", text: str = "text",
              name: str = "fim") -> DataFrame:
    """``docs`` with a struct ``name``: units ``n``, ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars``
    (code points, null if plain), and the ``output`` text.

    Both cuts are drawn from the id over all n + 1 boundaries, so equal ids cut equal texts alike.  A null text is empty;
    empty texts, texts that hold a sentinel and those outside the rate stay plain.  All rows and columns stay; ``name``
    gets underscores if it is taken.
    """
    name, body = fresh(docs, name), F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(doc_id), fmt.seed)

    @F.pandas_udf("struct<n:long,lo:long,hi:long>")
    def cut(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b in zip(texts, one, two, strict=True):
            cuts = Cuts(t, unit)
            lo, hi = sorted((a % (cuts.n + 1), b % (cuts.n + 1)))
            rows.append((cuts.n, cuts.chars_before(lo), cuts.chars_before(hi)))
        return pd.DataFrame(rows, columns=["n", "lo", "hi"])

    out = docs.withColumn(name, cut(body, h1, h2))
    lo, hi = F.col(f"{name}.lo"), F.col(f"{name}.hi")
    plain = (body == "") | fmt.found_in(body) | (h3 % 100 >= fmt.rate)
    form = F.when(plain, "plain").when(h4 % 100 < fmt.spm_rate, "spm").otherwise("psm")
    prefix, middle, suffix = part(body, F.lit(0), lo), part(body, lo, hi - lo), part(body, hi, F.length(body))
    marks = [F.lit(m) for m in (fmt.prefix, fmt.suffix, fmt.middle)]
    output = (F.when(form == "plain", body).when(form == "psm", F.concat(marks[0], prefix, marks[1], suffix, marks[2], middle))
              .otherwise(F.concat(marks[1], suffix, marks[0], prefix, marks[2], middle)))
    whole = F.when(form != "plain", F.lit(True))
    return out.withColumn(name, F.struct(F.col(f"{name}.n").alias("n"), form.alias("form"), F.when(whole, lo).alias("prefix_chars"),
                                         F.when(whole, hi - lo).alias("middle_chars"), output.alias("output")))
