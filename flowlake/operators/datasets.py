"""Training sets: ordered, leave-one-out and few-shot splits, samples, unions, sequences.

Every order is explicit: a unique integer id, or md5 of a seed and the id where a shuffle is wanted, so results do not
depend on partitioning or retries.  Ranks over whole datasets use bucketed ``row_numbers``; only ranks with a small
fixed limit use a plain window, which Spark cuts per partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.operators.ordered import cut_values, hash_bucket, hash_text, join_back, range_buckets, row_numbers
from flowlake.session import settle


def numbered(df: DataFrame, by: list[str], id_col: str = "row_id", name: str = "rn",
             total: str | None = None) -> DataFrame:
    """Rank by id within ``by`` (all rows when empty), for groups of any size."""
    return row_numbers(range_buckets(df, id_col, "__b"), by, "__b", [id_col], name, total).drop("__b")


def shuffled(df: DataFrame, by: list[str], seed: str, id_col: str = "row_id", name: str = "rn",
             total: str | None = None) -> DataFrame:
    """Rank in a seeded random order within ``by``, for groups of any size."""
    keyed = df.withColumn("__h", hash_text(seed, id_col)).withColumn("__b", hash_bucket(F.col("__h")))
    return row_numbers(keyed, by, "__b", ["__h", id_col], name, total).drop("__h", "__b")


def split_ordered(df: DataFrame, by: str = "dataset", id_col: str = "row_id") -> DataFrame:
    """80/10/10 by position within each dataset: the ids at both cuts are selected, then one comparison per row decides."""
    id_ = F.col(id_col)
    cuts = cut_values(df, [by], id_, [id_.alias("id")], [0.8, 0.9])
    at = lambda i: id_ <= F.col(f"all_{i}.id")
    done = join_back(df, cuts, [by]).withColumn("split", F.when(at(0), "train").when(at(1), "val").otherwise("test"))
    return done.drop(*[c for c in cuts.columns if c != by])


def split_leave_one_out(df: DataFrame, datasets: list[str], label: str = "label", seed: str = "42",
                        val_share: float = 0.1) -> DataFrame:
    """One copy of the rows per held-out dataset, with ``split``; validation is stratified by label.

    The last validation row of each (held-out dataset, label) in hash order is selected from the rows themselves; only the
    result holds copies.
    """
    hashed = hash_text(seed, "row_id")
    number = F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double")  # 52 bits, so exact
    others = {f"h{i}": F.col("dataset") != F.lit(d) for i, d in enumerate(datasets)}
    cuts = cut_values(df, [label], number, [hashed.alias("h"), F.col("row_id").alias("id")], [val_share], others)
    at = F.struct(hashed.alias("h"), F.col("row_id").alias("id"))
    copies = F.array(*[F.struct(F.lit(d).alias("holdout"), F.when(F.col("dataset") == d, "test").when(at <= F.col(f"h{i}_0"), "val")
                                .otherwise("train").alias("split")) for i, d in enumerate(datasets)])
    return join_back(df, cuts, [label]).select(*df.columns, F.inline(copies))


def few_shot_rows(df: DataFrame, shots: list[int], label: str = "label", seed: str = "42", keep: list[str] = ()) -> DataFrame:
    """(holdout, shots, row_id, and ``keep``): the adaptation rows, at most max(shots) per dataset and class."""
    w = Window.partitionBy("dataset", label).orderBy(hash_text(seed, "row_id"), "row_id")
    top = df.select("dataset", "row_id", *dict.fromkeys([label, *keep])).withColumn("rn", F.row_number().over(w)).filter(
        F.col("rn") <= max(shots))
    each = top.withColumn("shots", F.explode(F.array(*[F.lit(n) for n in shots]))).filter("rn <= shots")
    return each.select(F.col("dataset").alias("holdout"), "shots", "row_id", *keep)


def split_few_shot(df: DataFrame, shots: list[int], label: str = "label", seed: str = "42") -> DataFrame:
    """Adaptation rows and the remainder of each held-out dataset, per shot count."""
    adapt = settle(few_shot_rows(df, shots, label, seed), "adapt")
    copies = df.withColumnRenamed("dataset", "holdout").withColumn(
        "shots", F.explode(F.array(*[F.lit(n) for n in shots])))
    keys = ["holdout", "shots", "row_id"]
    picked = copies.join(adapt, keys, "left_semi").withColumn("part", F.lit("adapt"))
    return picked.unionByName(copies.join(adapt, keys, "left_anti").withColumn("part", F.lit("test")))


def class_balanced(df: DataFrame, label: str = "label", per_class: int = 100_000, seed: str = "42") -> DataFrame:
    """One epoch with equal classes: the first ``n`` rows of each shuffled class, smaller classes repeated in turn.

    ``n`` is the largest class size, at most ``per_class``.  Adds ``epoch_pos`` within the class.
    """
    size = df.groupBy(label).count().agg(F.least(F.max("count"), F.lit(per_class)).alias("size"))
    ranked = shuffled(df, [label], seed, total="n").withColumn("size", size.scalar()).filter("rn <= size")
    repeats = F.floor((F.col("size") - F.col("rn")) / F.col("n")).cast("int")
    copies = ranked.withColumn("turn", F.explode(F.sequence(F.lit(0), repeats)))
    return copies.withColumn("epoch_pos", F.col("rn") + F.col("turn") * F.col("n")).drop("rn", "n", "size", "turn")


def every_nth(df: DataFrame, n: int = 20, id_col: str = "row_id") -> DataFrame:
    """Rows n, 2n, 3n, ... of the whole table."""
    return numbered(df, [], id_col).filter(F.col("rn") % n == 0)


def head_per_group(df: DataFrame, by: str, rows: int, id_col: str = "row_id") -> DataFrame:
    """First rows of each group."""
    return numbered(df, [by], id_col).filter(F.col("rn") <= rows)


def probe_sample(df: DataFrame, dataset: str, share: float = 0.01, at_least: int = 100,
                 test_rows: int = 5000) -> DataFrame:
    """First training rows (a share, at least ``at_least``) and first test rows of one dataset's ordered split."""
    ranked = numbered(df.filter(F.col("dataset") == dataset), ["dataset"], total="n")
    train_end, val_end = F.floor(F.col("n") * F.lit(0.8)), F.floor(F.col("n") * F.lit(0.9))
    split = ranked.withColumn("split", F.when(F.col("rn") <= train_end, "train").when(F.col("rn") <= val_end, "val").otherwise("test"))
    train = (F.col("split") == "train") & (F.col("rn") <= F.greatest(F.floor(train_end * F.lit(share)), F.lit(at_least)))
    test = (F.col("split") == "test") & (F.col("rn") - val_end <= test_rows)
    return split.filter(train | test).drop("rn", "n")


def benign_union(df: DataFrame, cap: int | None = None, seed: str = "42", label: str = "label",
                 drop: tuple[str, ...] = ("label", "attack", "cic_label")) -> DataFrame:
    """Benign rows of all datasets without labels, in a seeded order (``shuffle_pos``); ``cap`` rows per dataset."""
    benign = df.filter(F.col(label) == 0).drop(*drop)
    if cap:
        benign = shuffled(benign, ["dataset"], seed).filter(F.col("rn") <= cap).drop("rn")
    return shuffled(benign, [], seed, name="shuffle_pos")


def sequences(df: DataFrame, features: list[str], length: int = 10, by: str = "dataset", id_col: str = "row_id",
              block: int = 100_000) -> DataFrame:
    """Sliding windows of ``length`` rows per dataset: ``seq`` holds the vectors, other columns are the last row's.

    Positions are cut into blocks; each block also gets the ``length - 1`` rows before it, so windows of one dataset
    run in many tasks.  Datasets with fewer rows than ``length`` give nothing.
    """
    ranked = numbered(df, [by], id_col, "pos")
    here = F.floor((F.col("pos") - 1) / block)
    spill = F.floor((F.col("pos") + length - 2) / block)
    blocks = ranked.withColumn("own", here).withColumn(
        "block", F.explode(F.array_distinct(F.array(here, spill))))
    w = Window.partitionBy(by, "block").orderBy("pos").rowsBetween(1 - length, 0)
    vector = F.array(*[F.col(c).cast("double") for c in features])
    out = blocks.withColumn("seq", F.collect_list(vector).over(w))
    return out.filter(f"own = block and pos >= {length}").drop("own", "block")


def warm_up(df: DataFrame, length: int = 10, by: str = "dataset", id_col: str = "row_id") -> DataFrame:
    """``state`` of each row: "Warmup (k/length)" until a full window exists, then "Ready"."""
    ranked = numbered(df, [by], id_col, "pos")
    note = F.concat(F.lit("Warmup ("), F.col("pos").cast("string"), F.lit(f"/{length})"))
    return ranked.withColumn("state", F.when(F.col("pos") < length, note).otherwise("Ready"))


def uniform(seed: str, *cols: str) -> Column:
    """Reproducible uniform in [0, 1) per row: 32 bits of md5."""
    return F.conv(F.substring(hash_text(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mask_features(df: DataFrame, features: list[str], seed: str, share: float = 0.2, key: str = "row_id") -> DataFrame:
    """Each cell becomes 0 with probability ``share``."""
    return df.withColumns({c: F.when(uniform(f"{seed}|mask|{c}", key) > share, F.col(c)).otherwise(0.0)
                           for c in features})


def add_noise(df: DataFrame, features: list[str], seed: str, std: float = 0.05, key: str = "row_id") -> DataFrame:
    """Gaussian noise on every cell, from two uniforms."""
    def noise(c: str) -> Column:
        u = F.lit(1.0) - uniform(f"{seed}|noise1|{c}", key)
        return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * uniform(f"{seed}|noise2|{c}", key))
    return df.withColumns({c: F.col(c) + noise(c) * std for c in features})


def swap_directions(df: DataFrame, pairs: list[tuple[str, str]], seed: str, share: float = 0.1,
                    key: str = "row_id") -> DataFrame:
    """With probability ``share`` per row, exchange forward and backward features."""
    swap = uniform(f"{seed}|swap", key) < share
    return df.withColumns({x: F.when(swap, F.col(y)).otherwise(F.col(x)) for a, b in pairs for x, y in ((a, b), (b, a))})


def jitter(df: DataFrame, features: list[str], seed: str, ratio: float = 0.05, key: str = "row_id") -> DataFrame:
    """Scale timing features by up to plus or minus ``ratio``."""
    return df.withColumns({c: F.col(c) * (1 + (2 * uniform(f"{seed}|jitter|{c}", key) - 1) * ratio) for c in features})


def two_views(df: DataFrame, features: list[str], pairs: list[tuple[str, str]], timing: list[str], seed: str,
              ops: tuple[str, ...] = ("mask", "noise", "swap", "jitter")) -> DataFrame:
    """Two independently augmented copies of every row, operations in the order mask, noise, swap, jitter."""
    views = []
    for view in (1, 2):
        out, salt = df, f"{seed}|{view}"
        if "mask" in ops:
            out = mask_features(out, features, salt)
        if "noise" in ops:
            out = add_noise(out, features, salt)
        if "swap" in ops:
            out = swap_directions(out, pairs, salt)
        if "jitter" in ops:
            out = jitter(out, timing, salt)
        views.append(out.withColumn("view", F.lit(view)))
    return views[0].unionByName(views[1])
