import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from flowlake.llm.packing import length_bin, optimal_boundaries, pack
from tests.llm.rows import awkward_docs, no_docs


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 5)
        ends = optimal_boundaries(np.array(lengths), np.array(counts), k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
        assert ends == sorted(set(ends)) and ends[-1] == lengths[-1] and len(ends) == min(k, len(lengths))
        assert padding(lengths, counts, ends) == best
    assert optimal_boundaries(np.array([], dtype=int), np.array([], dtype=int), 4) == []


def test_length_bin_is_exact_below_2048_and_bounded_above(spark):
    values = [0, 1, 2047, 2048, 2049, 4096, 100_000, 123_456_789]
    got = dict(spark.createDataFrame([(v,) for v in values], "n bigint").select("n", length_bin(F.col("n"))).collect())
    assert all(got[v] == v for v in values[:3]) and all(v <= got[v] <= v * (1 + 1 / 1024) for v in values[1:])


def test_every_row_gets_one_slot_within_the_budget(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(if(id % 3 = 0, 7, id % 50) as int)) as text", "'x' as batch")
    rows = pack(docs, n_buckets=5, token_budget=200).collect()
    assert len(rows) == 3000 and len({r["bucket_len"] for r in rows}) == 5
    slots = {}
    for r in rows:
        assert r["n_tokens"] <= r["bucket_len"]
        slots.setdefault((r["bucket"], r["batch"]), []).append(r)
    for batch in slots.values():
        assert sorted(r["slot"] for r in batch) == list(range(len(batch)))
        assert len(batch) * batch[0]["bucket_len"] <= 200
    for bucket in {b for b, _ in slots}:  # only the last batch of a bucket is not full
        batches = sorted(k for b, k in slots if b == bucket)
        assert batches == list(range(len(batches)))
        full = max(1, 200 // slots[bucket, 0][0]["bucket_len"])
        assert all(len(slots[bucket, k]) == full for k in batches[:-1])


def test_awkward_rows(spark):
    rows = pack(awkward_docs(spark), token_budget=100).collect()
    assert len(rows) == 14 and sum(r["n_tokens"] == 40_000 for r in rows) == 1
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5, 6)} == {0}
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == 14
    assert pack(no_docs(spark)).count() == 0
