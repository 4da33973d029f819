from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowlake.llm.mixing import mix
from tests.llm.rows import awkward_docs, no_docs


def water(sizes, weights, most=3.0):
    """Shares by weight; what is above the limit is shared out again among the others."""
    target, free, left = {}, dict(sizes), float(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return {**target, **{s: left * weights[s] / total for s in free}}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free = {s: n for s, n in free.items() if s not in over}
    return target


def documents(spark, n=6000):
    source = F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 97 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 11))
    return spark.range(n).select(F.col("id").alias("doc_id"), source.alias("source"),
                                 (F.pmod(F.xxhash64("id"), F.lit(400)) * F.when(F.col("id") % 50 == 0, 20).otherwise(1)).alias("size"))


def taken(df):
    return mix(df, size=F.col("size")).collect()


def test_targets_and_copies(spark):
    df = documents(spark)
    rows = taken(df)
    assert len(rows) == 6000
    sizes, got = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        got[r["source"]] += r["taken"]
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        rate = r["target"] / r["source_size"]
        assert r["size"] == 0 or int(rate + 1e-9) <= r["copies"] <= int(rate + 1e-9) + 1
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
    for s in sizes:  # within two documents of the largest size
        assert abs(got[s] - want[s]) <= 2 * 8000, s
    assert abs(sum(got.values()) - sum(sizes.values())) < 0.02 * sum(sizes.values())


def test_reruns_agree_in_any_partitioning(spark):
    df = documents(spark, 2000)
    once = sorted((r["doc_id"], r["taken"]) for r in taken(df))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted((r["doc_id"], r["taken"]) for r in taken(df.repartition(9, "size"))) == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_inclusion_is_unbiased(spark):
    df = spark.range(300).selectExpr("id as doc_id", "if(id < 150, 'a', 'b') as source", "10 as size")
    hits = defaultdict(int)
    for seed in range(12):
        for r in mix(df, weights=(3, 1), size=F.col("size"), seed=seed).collect():
            hits[r["doc_id"] // 50] += r["copies"]
    per = {k: v / (12 * 50) for k, v in hits.items()}
    assert all(abs(per[k] - 1.5) < 0.1 for k in (0, 1, 2)) and all(abs(per[k] - 0.5) < 0.1 for k in (3, 4, 5))


def test_awkward_rows(spark):
    rows = mix(awkward_docs(spark).drop("size")).collect()
    assert len(rows) == 14 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mix(no_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    assert {(r["target"], r["taken"]) for r in mix(blank).collect()} == {(0.0, 0)}
    many = spark.range(1).selectExpr("explode(array_repeat(7, 900)) as doc_id", "'one two' as text", "'a' as source")
    assert sum(r["taken"] for r in mix(many).collect()) == 1800
