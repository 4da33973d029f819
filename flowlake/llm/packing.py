"""Packing by optimal length buckets.

A dynamic program over the global histogram of lengths picks the bucket boundaries that give the least padding; inside
a bucket, sequences are dealt into batches whose padded size stays within a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import word_count
from flowlake.session import settle

EXACT_BITS = 11  # lengths below 2^11 keep their own histogram bin; longer ones share a bin within 1/1024 of their length


def length_bin(n: Column) -> Column:
    """Upper end of the histogram bin of length ``n``: ``n`` itself below 2048, else rounded up to 11 leading bits.

    So the histogram has at most 1,024 bins per octave, whatever the data hold.
    """
    drop = F.greatest(F.lit(0), F.length(F.bin(n)) - EXACT_BITS)
    step = F.pow(F.lit(2.0), drop).cast("long")
    return (F.ceil(n / step) * step).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Bucket ends (ascending, the last is the largest length) with the least total padding.

    Exact: ``best[k][j]`` is the least padding of the j shortest lengths in k buckets.  The padding of a bucket meets
    the quadrangle inequality, so the smallest best split grows with j and each layer is filled by halving.  Of equally
    good splits the smallest is taken; fewer buckets are used only when there are fewer lengths.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    d = len(lengths)
    if d == 0:
        return []
    n_buckets = min(n_buckets, d)
    total = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])

    def padding(i: np.ndarray, j: int) -> np.ndarray:
        """Of one bucket with the lengths i .. j-1, padded to the longest."""
        return lengths[j - 1] * (total[j] - total[i]) - (tokens[j] - tokens[i])

    best = np.array([0] + [int(padding(np.array([0]), j)[0]) for j in range(1, d + 1)])
    splits = []
    for k in range(2, n_buckets + 1):
        new, split = np.zeros(d + 1, dtype=np.int64), np.zeros(d + 1, dtype=np.int64)
        todo = [(k, d, k - 1, d - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(first, min(last, mid - 1) + 1)
            cost = best[i] + padding(i, mid)
            at = int(np.argmin(cost))
            new[mid], split[mid] = cost[at], i[at]
            todo += [(lo, mid - 1, first, int(i[at])), (mid + 1, hi, int(i[at]), last)]
        best = new
        splits.append(split)
    ends, j = [], d
    for split in reversed(splits):
        ends.append(int(lengths[j - 1]))
        j = int(split[j])
    return [*reversed([*ends, int(lengths[j - 1])])]


def pack(docs: DataFrame, length: Column | None = None, n_buckets: int = 16, token_budget: int = 65536) -> DataFrame:
    """Assign every row of ``docs`` to a bucket, a batch of that bucket and a slot of that batch.

    Returns doc_id, n_tokens (default: words of ``text``), bucket (from 1), bucket_len (its padded length), batch (from
    0 in each bucket) and slot.  A batch holds ``max(1, token_budget // bucket_len)`` rows, so a document longer than
    the budget is a batch of its own and stays whole.  Rows without text have length 0 and sit in the first bucket; rows
    without id are packed like others; repeated rows take a slot each; an empty table gives an empty result; other
    columns of ``docs`` are left behind.

    Batches follow the md5 order of the ids.  Ranks come from ranges of that order, some sqrt(rows) of them, so no
    task ever holds a whole bucket, even if one length has a third of all rows.
    """
    rows = settle(docs.select("doc_id", (word_count(F.col("text")) if length is None else length).alias("n_tokens")),
                  "pack-lengths")
    bins = rows.groupBy(length_bin(F.col("n_tokens")).alias("bin")).count().orderBy("bin").collect()
    lengths, counts = np.array([r["bin"] for r in bins], dtype=np.int64), np.array([r["count"] for r in bins])
    ends = optimal_boundaries(lengths, counts, n_buckets) or [0]
    sizes = np.bincount(np.searchsorted(ends, lengths), weights=counts, minlength=len(ends)) if len(bins) else [0]
    per_range = max(500, int(sum(sizes) ** 0.5))
    ranges = [max(1, int(-(-s // per_range))) for s in sizes]

    def of_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket"))

    n_bin, hashed = length_bin(F.col("n_tokens")), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = (rows.withColumn("bucket", F.lit(1) + sum([(n_bin > e).cast("int") for e in ends[:-1]], F.lit(0)))
              .withColumn("bucket_len", of_bucket(ends)).withColumn("h", hashed)
              .withColumn("part", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * of_bucket(ranges)
                                          / F.lit(1 << 32)).cast("long")))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("bucket", "part").count()
               .select("bucket", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")))
    rank = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("h", "n_tokens")) - 1
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest("bucket_len", F.lit(1))))
    return (placed.withColumn("rank", rank).join(offsets, ["bucket", "part"])
            .withColumn("rank", F.col("rank") + F.col("before"))
            .select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("rank") / fit).alias("batch"),
                    F.pmod("rank", fit).alias("slot")))
