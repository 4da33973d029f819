import math
import random

import numpy as np
import pytest

from flowlake.llm.topk import ImpactIndex, top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, score int, rank int"


def brute(rows, queries, k):
    whole = lambda v: [math.floor(1024 * float(np.float32(x))) for x in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q in queries:
            hits = sorted((-sum(map(int.__mul__, v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


def test_equals_brute_force_with_ties_and_copies(spark):
    rng = random.Random(4)
    hot = [rng.gauss(0, 0.2) for _ in range(16)]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(900)]
    rows += [(1000, None), (1001, [0.1] * 15 + [None]), (1002, [float("nan")] * 16), (1003, [float("inf")] * 16), (1004, []),
             (1100, [0.0] * 16), (None, hot), (1200, [0.5, -0.5])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    got = sorted(map(tuple, top_k(df, df.where("vec_id % 100 = 0"), block_rows=200, query_rows=4).collect()))
    assert got == brute(rows, {i for i, _ in rows if i is not None and i % 100 == 0}, 10)


def test_fewer_rows_than_k_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 0, 0, 0), (1, [2.0], 0, 0, 0)], SCHEMA)
    assert [tuple(r) for r in top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert top_k(df.where("false"), df.where("false")).count() == 0 and top_k(df, df.where("false")).count() == 0


def test_repeated_rows_stand_as_often_as_they_are(spark):
    df = spark.createDataFrame([(0, [1.0], 0, 0, 0), (1, [2.0], 0, 0, 0), (1, [2.0], 0, 0, 0)], SCHEMA)
    assert [r["vec_id"] for r in top_k(df, df.where("vec_id = 0")).collect()] == [1, 1]


def test_index_stops_on_proof_only():
    rng = np.random.default_rng(1)
    for scale, n in ((300, 700), (1, 50), (10 ** 6, 300)):
        vectors = rng.integers(-scale, scale + 1, (n, 12))
        vectors[: n // 3] = vectors[0]
        ids = rng.permutation(n * 2)[:n]
        index = ImpactIndex(ids, vectors)
        for q in (*range(0, n, 37),):
            got, scores = index.search(vectors[q], 7, int(ids[q]))
            want = sorted((-int(s), int(i)) for s, i in zip(vectors @ vectors[q], ids) if i != ids[q])[:7]
            assert [(-int(s), int(i)) for s, i in zip(scores, got)] == want


@pytest.mark.parametrize("size", [1e6, 3e6, 1e9])
def test_large_components_equal_brute_force(size):
    rng = np.random.default_rng(int(size))
    vectors = rng.integers(-int(size), int(size), (2000, 8))
    ids = np.arange(2000)
    index = ImpactIndex(ids, vectors)
    for query in (rng.integers(-2, 3, 8), np.full(8, 1), vectors[7] if size < 1e9 else rng.integers(-100, 100, 8)):
        exact = [sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors]
        want = sorted((-s, int(i)) for i, s in zip(ids, exact, strict=True) if i != 7)[:10]
        got_ids, got = index.search(query, 10, 7)
        assert [(-int(s), int(i)) for i, s in zip(got_ids, got, strict=True)] == want


def test_scores_beyond_a_long_fail_instead_of_wrapping(spark):
    with pytest.raises(OverflowError):
        ImpactIndex(np.arange(3), np.full((3, 8), 1 << 40)).search(np.full(8, 1 << 30), 1, None)
    df = spark.createDataFrame([(0, [1e30]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        top_k(df, df.where("vec_id = 0")).collect()
