"""Ordered operations over groups of any size.

``Window.partitionBy(g)`` sends a whole group to one task, which fails when one group holds a large share of the
rows.  These helpers take a ``bucket`` column that grows with the sort order and cuts a group into bounded ranges:
the window runs inside (group, bucket), and one small row per bucket carries totals or the last row across.
The summary has one row per (group, bucket); with about 10^3-10^5 buckets it stays small for any table size.
Null is a group, and a bucket, of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.session import settle, single_row

INF = float("inf")


def hash_text(seed: str, *cols: str) -> Column:
    """Reproducible shuffle order: md5 of a seed and the key columns, as hex text."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def hash_bucket(hashed: Column, digits: int = 4) -> Column:
    """Bucket for a hash order: leading hex digits, 16^digits equal shares."""
    return F.substring(hashed, 1, digits)


def range_buckets(df: DataFrame, col: str, name: str, buckets: int = 1024) -> DataFrame:
    """Add bucket ``name`` that grows with the number in ``col``: about equal shares of the rows, whatever the values.

    One pass takes approximate quantiles as boundaries.  A value that holds more than a share has a bucket of its own;
    null and NaN come last.
    """
    cuts = df.agg(F.percentile_approx(F.col(col).cast("double"), [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    edges = [-float("inf"), *sorted({c for c in cuts or [] if abs(c) < float("inf")}), float("inf")]
    if len(edges) < 3:
        edges.insert(1, 0.0)
    number = f"__{name}"
    cut = Bucketizer(splits=edges, inputCol=number, outputCol=name, handleInvalid="keep")
    return cut.transform(df.withColumn(number, F.col(col).cast("double"))).drop(number)


def cut_values(df: DataFrame, by: list[str], number: Column, order: list[Column], shares: list[float],
               groups: dict[str, Column] | None = None, most: int = 1 << 20) -> DataFrame:
    """The exact row at rank floor(share x n) of each group, without sorting or ranking the rows.

    One row per ``by``: ``<group>_n`` and ``<group>_<i>``, the struct of ``order`` of that row for the i-th share (null for
    rank 0).  ``number`` must not fall along ``order``.  ``groups`` are overlapping sets of rows by condition, so rows need no
    copies; without it there is one, called ``all``.

    Rows with the same number are few: those of a cut's number are sorted together.  A first pass takes approximate quantiles a little below and above each cut, a second one counts the rows below and
    sorts only those between.  While more than ``most`` lie between, the bracket is narrowed by another pass.
    """
    groups = groups or {"all": F.lit(True)}
    keyed = df.select(*by, number.cast("double").alias("__x"), F.struct(*order).alias("__at"),
                      *[cond.alias(f"__in_{g}") for g, cond in groups.items()])
    member = {g: F.coalesce(F.col(f"__in_{g}"), F.lit(False)) & F.col("__x").isNotNull() for g in groups}
    margin, names = 0.004, [(g, i) for g in groups for i in range(len(shares))]
    quantiles = lambda x, ps: F.percentile_approx(x, [min(max(p, 0.0), 1.0) for p in ps], 1000)
    first = [F.count_if(member[g]).alias(f"{g}_n") for g in groups]
    for g in groups:
        around = quantiles(F.when(member[g], F.col("__x")), [p for s in shares for p in (s - margin, s + margin)])
        first.append(around.alias(f"{g}_q"))
    known = keyed.groupBy(*by).agg(*first)
    rank = {(g, i): F.floor(F.col(f"{g}_n") * F.lit(shares[i])) for g, i in names}
    known = settle(known.select(*by, *[f"{g}_n" for g in groups], *[
        c for g, i in names for c in (
            F.when(F.col(f"{g}_n") < 1000, -INF).otherwise(F.get(f"{g}_q", F.lit(2 * i))).alias(f"{g}_lo{i}"),
            F.when(F.col(f"{g}_n") < 1000, INF).otherwise(F.get(f"{g}_q", F.lit(2 * i + 1))).alias(f"{g}_hi{i}"))]), "cut-brackets")
    largest = known.agg(F.max(F.greatest(F.lit(0), *[F.col(f"{g}_n") for g in groups]))).first()[0] or 0
    width = largest * 2 * margin * len(names)
    while True:
        if by:
            rows = join_back(keyed, known, by)
        else:
            rows = keyed.withColumn("__k", single_row(known)).select(*keyed.columns, "__k.*")
        between = {(g, i): member[g] & F.col("__x").between(F.col(f"{g}_lo{i}"), F.col(f"{g}_hi{i}")) for g, i in names}
        below = {(g, i): F.count_if(member[g] & (F.col("__x") < F.col(f"{g}_lo{i}"))).alias(f"{g}_below{i}") for g, i in names}
        kept = [*[f"{g}_n" for g in groups], *[f"{g}_{e}{i}" for g, i in names for e in ("lo", "hi")]]
        if width <= most:
            found = rows.groupBy(*by, *kept).agg(*below.values(), *[
                F.array_sort(F.collect_list(F.when(between[n], F.col("__at")))).alias(f"{n[0]}_rows{n[1]}") for n in names])
            picked = {(g, i): F.get(f"{g}_rows{i}", (rank[g, i] - F.col(f"{g}_below{i}") - 1).cast("int")) for g, i in names}
            return settle(found.select(*by, *[f"{g}_n" for g in groups], *[
                F.when(rank[g, i] > 0, picked[g, i]).alias(f"{g}_{i}") for g, i in names]), "cuts")
        narrowed = rows.groupBy(*by, *kept).agg(*below.values(), *[
            c for (g, i) in names for c in (F.count_if(between[g, i]).alias(f"{g}_size{i}"),
                                            F.percentile_approx(F.when(between[g, i], F.col("__x")), [j / 256 for j in range(257)], 10_000).alias(f"{g}_q{i}"))])
        place = {(g, i): (rank[g, i] - F.col(f"{g}_below{i}")) / F.nullif(F.col(f"{g}_size{i}"), F.lit(0)) * 256 for g, i in names}
        step = lambda g, i, off: F.get(f"{g}_q{i}", F.least(F.greatest(F.floor(place[g, i]) + off, F.lit(0)), F.lit(256)).cast("int"))
        known = settle(narrowed.select(*by, *[f"{g}_n" for g in groups], *[
            c for g, i in names for c in (F.greatest(F.col(f"{g}_lo{i}"), step(g, i, -2)).alias(f"{g}_lo{i}"),
                                          F.least(F.col(f"{g}_hi{i}"), step(g, i, 3)).alias(f"{g}_hi{i}"))]), "cut-brackets")
        width = width * 5 / 256


def join_back(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where null equals null; each key stays once."""
    renamed = summary.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return df.join(renamed, same).drop(*[f"__k_{k}" for k in keys])


def running_totals(df: DataFrame, by: list[str], bucket: str, order: list, totals: dict[str, Column],
                   group_totals: dict[str, str] | None = None) -> DataFrame:
    """Add running sums over (bucket, order) within each group, the current row included.

    ``group_totals`` maps a name in ``totals`` to a new column with its sum over the whole group.
    """
    keys = [*by, bucket]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.groupBy(*keys).agg(*[F.sum(expr).alias(f"__{name}") for name, expr in totals.items()])
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sums.select(
        *keys,
        *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in totals],
        *[F.sum(f"__{n}").over(whole).alias(out) for n, out in (group_totals or {}).items()])
    local = df.withColumns({name: F.sum(expr).over(inner) for name, expr in totals.items()})
    joined = join_back(local, offsets, keys)
    return joined.withColumns({n: F.col(n) + F.col(f"__{n}") for n in totals}).drop(*[f"__{n}" for n in totals])


def row_numbers(df: DataFrame, by: list[str], bucket: str, order: list, name: str = "rn",
                total: str | None = None) -> DataFrame:
    """``row_number()`` (and, if asked, the group size) for groups of any size."""
    return running_totals(df, by, bucket, order, {name: F.lit(1).cast("long")}, {name: total} if total else None)


def previous_row(df: DataFrame, by: list[str], order: list[str], values: list[str], name: str,
                 bucket: str | None = None) -> DataFrame:
    """Add struct ``name`` with ``values`` of the previous row of the group, null on the first row.

    Without ``bucket`` this is ``lag``; with it, the last row of the nearest earlier bucket is carried over.
    """
    value = F.struct(*values)
    if bucket is None:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))
    keys = [*by, bucket]
    tails = df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("__tail"))
    carried = tails.select(*keys, F.lag("__tail").over(Window.partitionBy(*by).orderBy(bucket)).alias("__carry"))
    local = df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    return join_back(local, carried, keys).withColumn(name, F.coalesce(name, "__carry")).drop("__carry")


def nearest_mark(df: DataFrame, by: list[str], bucket: str, order: list[str], marks: dict[str, Column],
                 ahead: bool, strict: tuple[str, ...] = ()) -> DataFrame:
    """For each row, the nearest mark at or after it (``ahead``), or at or before it.

    ``marks`` maps a new column to an expression that is null where the mark is absent and whose value grows along
    ``order``.  Columns named in ``strict`` leave the row itself out.
    """
    keys = [*by, bucket]
    pick = F.min if ahead else F.max
    sort = F.desc if ahead else F.asc
    inner = Window.partitionBy(*keys).orderBy(*[sort(c) for c in order])
    outer = Window.partitionBy(*by).orderBy(sort(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    edges = df.groupBy(*keys).agg(*[pick(e).alias(f"__{n}") for n, e in marks.items()])
    carried = edges.select(*keys, *[pick(f"__{n}").over(outer).alias(f"__{n}") for n in marks])
    seen = {n: pick(e).over(inner.rowsBetween(Window.unboundedPreceding, -1 if n in strict else 0))
            for n, e in marks.items()}
    out = join_back(df.withColumns(seen), carried, keys)
    return out.withColumns({n: F.coalesce(n, f"__{n}") for n in marks}).drop(*[f"__{n}" for n in marks])
