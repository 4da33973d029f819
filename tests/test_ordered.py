"""Bucketed order operations against plain windows, with one group holding most rows."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlake.operators import datasets
from flowlake.operators.ordered import cut_values, nearest_mark, previous_row, range_buckets, row_numbers, running_totals


@pytest.fixture(scope="module")
def rows(spark):
    g = F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(99).cast("string")
    return spark.range(997).select("id", g.alias("g"), (F.col("id") * 37 % 101).alias("v")).withColumn(
        "b", F.floor(F.col("id") / 50))


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_running_totals_and_rank(rows):
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    got = running_totals(rows, ["g"], "b", ["id"], {"s": F.col("v")}, {"s": "total"})
    want = rows.select("id", F.sum("v").over(w).alias("s"), F.sum("v").over(Window.partitionBy("g")).alias("total"))
    same(got.select("id", "s", "total"), want)
    ranks = row_numbers(rows, [], "b", ["id"], "rn", "n").select("id", "rn", "n")
    same(ranks, rows.select("id", (F.col("id") + 1).alias("rn"), F.lit(997).alias("n")))


def test_previous_row_skips_empty_buckets(rows):
    sparse = rows.filter("b not in (3, 4, 5)")
    w = Window.partitionBy("g").orderBy("id")
    got = previous_row(sparse, ["g"], ["id"], ["id", "v"], "p", "b").select("id", "p.id", "p.v").toDF("id", "pid", "pv")
    same(got, sparse.select("id", F.lag("id").over(w).alias("pid"), F.lag("v").over(w).alias("pv")))


@pytest.mark.parametrize("strict", [(), ("m",)])
@pytest.mark.parametrize("ahead", [True, False])
def test_nearest_mark(rows, ahead, strict):
    mark = F.when(F.col("v") < 3, F.col("id"))
    got = nearest_mark(rows, ["g"], "b", ["id"], {"m": mark}, ahead, strict).select("id", "m")
    edge = 1 if strict else 0
    w = Window.partitionBy("g").orderBy("id")
    frame = w.rowsBetween(edge, Window.unboundedFollowing) if ahead else w.rowsBetween(Window.unboundedPreceding, -edge)
    same(got, rows.select("id", (F.min if ahead else F.max)(mark).over(frame).alias("m")))


@pytest.mark.parametrize("block", [7, 10, 100_000])
def test_sequences_do_not_depend_on_blocks(spark, rows, block):
    df = rows.select(F.col("id").alias("row_id"), F.col("g").alias("dataset"), "v")
    got = {r.row_id: [x[0] for x in r.seq] for r in datasets.sequences(df, ["v"], length=4, block=block).collect()}
    groups = {}
    for r in df.orderBy("row_id").collect():
        groups.setdefault(r.dataset, []).append((r.row_id, float(r.v)))
    want = {rs[i][0]: [v for _, v in rs[i - 3:i + 1]] for rs in groups.values() for i in range(3, len(rs))}
    assert got == want


def test_splits_are_disjoint_and_complete(rows):
    df = rows.select(F.col("id").alias("row_id"), F.col("g").alias("dataset"), (F.col("v") % 2).alias("label"))
    ordered = datasets.split_ordered(df)
    assert ordered.count() == ordered.select("row_id").distinct().count() == df.count()
    few = datasets.split_few_shot(df, [5, 20])
    per = {(r.shots, r.part): r["count"] for r in few.groupBy("shots", "part").count().collect()}
    assert per[(5, "adapt")] + per[(5, "test")] == df.count() == per[(20, "adapt")] + per[(20, "test")]
    assert few.filter("part = 'adapt'").groupBy("holdout", "shots", "label").count().filter("count > shots").count() == 0


def test_class_balance(rows):
    df = rows.select(F.col("id").alias("row_id"), F.when(F.col("id") < 30, 1).otherwise(0).alias("label"))
    sizes = {r.label: r["count"] for r in datasets.class_balanced(df).groupBy("label").count().collect()}
    assert sizes == {0: 967, 1: 967}
    capped = datasets.class_balanced(df, per_class=100)
    assert capped.groupBy("label").count().select("count").distinct().collect()[0][0] == 100
    assert capped.filter("label = 0").select("row_id").distinct().count() == 100


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "a", None if i % 3 == 0 else 1, float(i)) for i in range(40)],
                               "row_id long, dataset string, label int, v double")
    split = datasets.split_ordered(df)
    assert split.count() == 40 and {r["split"] for r in split.filter("dataset is null").collect()} == {"train", "val", "test"}
    assert datasets.class_balanced(df, per_class=5).groupBy("label").count().count() == 2
    assert datasets.sequences(df, ["v"], length=3).filter("dataset is null").count() == 8
    assert datasets.warm_up(df).count() == 40 and datasets.benign_union(df, cap=3, label="label").count() == 0
    assert previous_row(df.withColumn("b", F.floor(F.col("row_id") / 9)), ["dataset"], ["row_id"], ["v"], "p", "b").count() == 40


def test_sparse_ids_and_a_hot_group_share_bounded_buckets(spark):
    ids = F.col("id") * 10_000_000 + F.when(F.col("id") > 1900, F.lit(1 << 45)).otherwise(0)
    df = spark.range(2000).select(ids.alias("row_id"), F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("g"))
    buckets = range_buckets(df, "row_id", "b", 50).groupBy("b").count().collect()
    assert 40 <= len(buckets) <= 51 and max(r["count"] for r in buckets) <= 80
    w = Window.partitionBy("g").orderBy("row_id")
    same(datasets.numbered(df, ["g"]).select("row_id", "rn"), df.select("row_id", F.row_number().over(w).alias("rn")))
    odd = spark.createDataFrame([(None,), (1.0,), (float("inf"),), (float("nan"),)], "x double")
    assert range_buckets(odd, "x", "b").count() == 4 and range_buckets(odd.filter("false"), "x", "b").count() == 0


@pytest.mark.parametrize("most", [1 << 20, 30])
def test_cuts_are_the_rows_that_sorting_gives(spark, most):
    rng = random.Random(3)
    ids = rng.sample(range(10 ** 12), 4000) + [10 ** 15 + i for i in range(1500)]
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y"]), i) for i in ids] + [("c", "x", 5), ("d", "y", 1), ("d", "y", 2), ("a", "x", None)]
    df = spark.createDataFrame(rows, "k string, g string, id long")
    shares, groups = [0.1, 0.5, 0.8], {"x": F.col("g") == "x", "any": F.lit(True)}
    for by in (["k"], []):
        got = cut_values(df, by, F.col("id"), [F.col("id").alias("id")], shares, groups, most).collect()
        for r in got:
            for name in groups:
                mine = sorted(i for k, g, i in rows if i is not None and (name == "any" or g == "x") and (not by or k == r["k"]))
                assert r[f"{name}_n"] == len(mine)
                for j, s in enumerate(shares):
                    rank = math.floor(len(mine) * s)
                    assert (r[f"{name}_{j}"]["id"] if rank else r[f"{name}_{j}"]) == (mine[rank - 1] if rank else None)
        assert len(got) == (5 if by else 1)
