"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken ``target / source_size`` times.  The whole part is taken as is; the fractional
part is rounded by the pivotal method: two documents meet, mass moves at random from one to the other until one of them
is at 0 or 1, and the other goes on.  Documents meet others of about their size, so the words taken stay near the
target.  Blocks of documents are folded side by side; each leaves one document with a fraction, and these meet again
in the next round of a reduction tree.  Column expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import hash_share, word_count
from flowlake.session import settle

EDGE = 1e-9  # fractions nearer than this to 0 or 1 are rounding noise


def ranked(sources: DataFrame) -> DataFrame:
    """Add ``place``, the rank of ``source`` by code point from 0, null last.

    Sources are dealt by ranges of their names and ranked inside each range, after the counts of the ranges before it,
    so any number of sources can be ranked.
    """
    dealt = settle(sources.repartitionByRange(F.col("source").asc_nulls_last())
                   .withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("off"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("rn", rank).join(offsets, "part").withColumn("place", F.col("rn") + F.col("off")) \
        .drop("part", "rn", "off")


def targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Add ``target`` to (source, source_size, place): shares of the whole size by weight, at most ``most`` x own size.

    What a source can't hold is shared out again by weight among the others, until none is above its limit.  One scalar
    describes a round, the level per unit of weight: a source is full if weight x level passes its limit.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    table = settle(sources.withColumn("weight", weight).withColumn("room", F.col("source_size") * F.lit(float(most))),
                   "mix-weights")
    level, full = 0.0, -1
    while True:
        is_full = F.col("weight") * F.lit(level) > F.col("room")
        row = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(is_full, F.col("room"))).alias("held"),
                        F.sum(F.when(~is_full, F.col("weight"))).alias("free"), F.count(F.when(is_full, 1)).alias("n")).first()
        if row["n"] == full or not row["free"]:
            break
        full, level = row["n"], (row["all"] - (row["held"] or 0.0)) / row["free"]
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("room")))


def fold(items: Column, kind: str) -> Column:
    """Run the pivotal method along ``items``, structs of type ``kind`` with a fraction ``p`` and a uniform draw ``u``.

    The held item (fraction p) meets the next one (q).  If p + q < 1, one of them drops to 0 and the other gets p + q;
    else one rises to 1 and the other keeps p + q - 1.  Each keeps its expected value.
    Returns struct(hold, p, out): the last unresolved item with its fraction, and the resolved items with their bit.
    """
    none = F.lit(None).cast(kind)
    out = F.array().cast(f"array<struct<item:{kind},bit:int>>")
    start = F.struct(none.alias("hold"), F.lit(0.0).alias("p"), out.alias("out"))

    def step(state: Column, x: Column) -> Column:
        held, p, q = state["hold"], state["p"], x["p"]
        total = p + q
        below = total < 1 - EDGE
        stays = F.when(below, x["u"] * total < p).otherwise(x["u"] * (2 - total) >= 1 - q)  # the held item goes on
        keep, done = F.when(stays, held).otherwise(x), F.when(stays, x).otherwise(held)
        bit = F.when(below, F.lit(0)).otherwise(F.lit(1))
        return F.struct(
            F.when(held.isNull(), x).otherwise(keep).alias("hold"),
            F.when(held.isNull(), q).when(below, total).otherwise(F.greatest(total - 1, F.lit(0.0))).alias("p"),
            F.when(held.isNull(), state["out"])
            .otherwise(F.array_append(state["out"], F.struct(done.alias("item"), bit.alias("bit")))).alias("out"))

    return F.aggregate(items, start, step)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 7, block: int = 256,
        size: Column | None = None, numbered: bool = False) -> DataFrame:
    """Copies of each row of ``docs`` so that every source comes near its target.

    Returns doc_id, source, size (default: words of ``text``), source_size, target, copies and taken = copies x size,
    one row per row of ``docs``.  Sources take ``weights`` in turn by code point, null last (null is a source of its
    own); no row is copied more than ``most`` times.  Rows of size 0 and sources without words take nothing.  Repeated
    rows are numbered and rounded one by one; an empty table gives an empty result; other columns are left behind.
    With ``numbered``, nth is returned too, which tells repeated rows of (doc_id, source, size) apart.  The draws are hashes of (seed, doc_id, source, size, number), so reruns agree in any partitioning.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = word_count(F.col("text")) if size is None else size
    counted = docs.select("doc_id", "source", words.cast("long").alias("size")).groupBy("doc_id", "source", "size").count()
    rows = settle(counted.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).drop("count"), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = settle(targets(ranked(sources), weights, most).select("source", "source_size", "target"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + EDGE)
    named = table.withColumnRenamed("source", "__source")
    rated = (rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
             .withColumn("base", whole).withColumn("p", F.greatest(rate - whole, F.lit(0.0))))
    open_ = (F.col("p") > EDGE) & (F.col("size") > 0)

    item = F.struct("size", hash_share(F.lit(seed), F.lit(0), "doc_id", "source", "size", "nth").alias("u"), "doc_id", "nth",
                    "base", "p")
    kind = f"struct<size:bigint,u:double,doc_id:{kind},nth:bigint,base:bigint,p:double>"
    keys = ["source", "source_size", "target"]
    todo, done, level, group = rated.where(open_).select(*keys, item.alias("item")), [], 0, F.floor(
        F.log2(F.col("item.size").cast("double")) * 4)
    closed = rated.where(~open_).select(*keys, "doc_id", "size", "nth", "base")
    while True:
        # blocks of about ``block`` items of one source (at first also of about one size), dealt by hash
        todo = todo.withColumn("group", group)
        counts = todo.groupBy("source", "group").count().select(
            F.col("source").alias("__s"), F.col("group").alias("__g"), F.ceil(F.col("count") / block).alias("blocks"))
        counts = settle(counts, "mix-counts")
        most_blocks = counts.agg(F.max("blocks")).first()[0]
        dealt = todo.join(counts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("group") == F.col("__g")))
        block_id = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "item.doc_id", "item.size", "item.nth"), F.col("blocks"))
        folded = (dealt.withColumn("block", block_id).groupBy(*keys, "group", "block")
                  .agg(F.array_sort(F.collect_list("item")).alias("items"))
                  .select(*keys, fold(F.col("items"), kind).alias("state")))
        folded = settle(folded, "mix-level")
        done.append(folded.select(*keys, F.explode("state.out").alias("x")).select(
            *keys, F.col("x.item.doc_id").alias("doc_id"), F.col("x.item.size").alias("size"), F.col("x.item.nth").alias("nth"),
            (F.col("x.item.base") + F.col("x.bit")).alias("base")))
        level += 1
        held = folded.select(*keys, F.col("state.hold").alias("item"), F.col("state.p").alias("p"))
        fresh = hash_share(F.lit(seed), F.lit(level), "item.doc_id", "source", "item.size", "item.nth")
        todo = held.withColumn("item", F.col("item").withField("p", F.col("p")).withField("u", fresh)).drop("p")
        if level > 1 and (most_blocks or 0) <= 1:
            break
        group = F.lit(0)
    last = todo.select(*keys, F.col("item.doc_id").alias("doc_id"), F.col("item.size").alias("size"), F.col("item.nth").alias("nth"),
                       (F.col("item.base") + (F.col("item.u") < F.col("item.p")).cast("int")).alias("base"))
    parts = [closed, *done, last]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "size", *["nth"] * numbered, "source_size", "target", F.col("base").alias("copies"),
                      (F.col("base") * F.col("size")).alias("taken"))
