"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks.  A block's index has, for each dimension, its vectors in the order of their component,
cut into segments of about equal impact.  A query takes segments of all dimensions by descending impact and adds their
contributions to one accumulator per vector.  It stops when bounds prove which vectors can still be among the k best,
and scores just those exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.session import settle

HIT = "query_id bigint, variant bigint, vec_id bigint, score bigint"


class ImpactIndex:
    """Index of one block: integer vectors (n x d), with their ids ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, segments: int = 24):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.int64)
        n, d = self.vectors.shape
        self.center = np.rint(self.vectors.mean(axis=0)).astype(np.int64)
        offset = self.vectors - self.center
        # a segment: rows of one dimension whose components lie in one range; its impact is the largest offset in it
        self.rows, self.values, dims, edges = [], [], [], []
        cuts = np.unique((np.arange(segments + 1) * n) // segments)
        for j in range(d):
            by = np.argsort(offset[:, j], kind="stable")
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self.rows.append(by[a:b])
                self.values.append(offset[by[a:b], j])
                dims.append(j)
                edges.append(max(abs(offset[by[a], j]), abs(offset[by[b - 1], j])))
        self.dims, self.impact = np.array(dims), np.array(edges)
        self.energy = (offset.astype(np.float64) ** 2).sum(axis=1)  # squares of large components don't fit in 64 bits
        self.reach = float(np.abs(self.vectors.astype(np.float64)).max(axis=0).sum()) if n else 0.0

    def check_fit(self, query: np.ndarray) -> None:
        """Raise where a sum of products could leave 64 bits: no exact score exists there."""
        limit = float(np.abs(query.astype(np.float64)).max(initial=0.0)) * self.reach
        if limit < float(1 << 62):
            return
        exact = self.vectors.astype(object) @ query.astype(object)
        parts = np.abs(self.vectors.astype(np.float64)) @ np.abs(query.astype(np.float64))
        if max(map(abs, exact), default=0) >= 1 << 63 or parts.max(initial=0.0) >= 2.0 ** 63 * (1 - 1e-9):
            raise OverflowError("inner products of these vectors do not fit in 64 bits")

    def search(self, query: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but ``skip``: by score descending, then by id.

        After some segments a vector's score is its accumulator plus a rest.  The rest is at most |query| times the
        root of the energy (squared offsets) of its components not yet taken (Cauchy-Schwarz).  Vectors whose upper
        bound is below the k-th best lower bound are out.  When few are left they are scored exactly.
        """
        query = query.astype(np.int64)
        self.check_fit(query)
        n = len(self.ids)
        alive = np.ones(n, dtype=bool)
        if skip is not None:
            alive[self.ids == skip] = False
        k = min(k, int(alive.sum()))
        if not k:
            return self.ids[:0], self.ids[:0]
        wide = query.astype(np.float64)
        score, energy = np.full(n, float(wide @ self.center), dtype=np.float64), self.energy.copy()
        norm = float(np.sqrt(wide @ wide))
        # rounding of the sums, of the centre's share too
        slack = 1 + 1e-9 * norm * (float(np.sqrt(energy.max())) + float(np.linalg.norm(self.center.astype(np.float64))))
        rounding = 1e-9 * float(energy.max())
        weight = np.abs(wide)[self.dims] * self.impact
        order = np.argsort(-weight, kind="stable")
        order = order[weight[order] > 0]
        few, at, step = max(4 * k, n // 32), 0, max(1, len(order) // 4)
        while at < len(order) and alive.sum() > few:
            taken = order[at:at + step]
            at += step
            step = max(1, len(order) // 12)
            rows = np.concatenate([self.rows[i] for i in taken])
            values = np.concatenate([self.values[i] for i in taken]).astype(np.float64)
            by = np.repeat(wide[self.dims[taken]], [len(self.rows[i]) for i in taken])
            score += np.bincount(rows, weights=values * by, minlength=n)
            energy -= np.bincount(rows, weights=values * values, minlength=n)
            rest = norm * np.sqrt(np.maximum(energy, 0) + rounding) + slack
            proven = np.partition((score - rest)[alive], -k)[-k]
            alive &= score + rest >= proven
        left = np.flatnonzero(alive)
        exact = self.vectors[left] @ query
        best = np.lexsort((self.ids[left], -exact))[:k]
        return self.ids[left][best], exact[best]


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale x component) of every component; null for a vector that is null or has one that isn't finite."""
    scaled = lambda x: F.floor(F.lit(scale) * x.cast("double"))
    fits = lambda x: F.abs(F.lit(scale) * x.cast("double")) < F.lit(float(1 << 62))
    whole = F.transform(vector, lambda x: F.when(fits(x), scaled(x).cast("long")).otherwise(F.raise_error("a component is too large")))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & good, whole)


def packed(rows: DataFrame, blocks: int, block: str) -> DataFrame:
    """Deal rows (id, vector) into ``blocks`` by the hash of the id; a block is one row of packed bytes."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({block: pdf[block].iloc[:1], "ids": [pdf["id"].to_numpy(np.int64).tobytes()],
                             "nths": [pdf["nth"].to_numpy(np.int64).tobytes()], "vectors": [np.array(pdf["vector"].tolist(), dtype=np.int64).tobytes()],
                             "d": [len(pdf["vector"].iloc[0])]})

    dealt = rows.withColumn(block, F.pmod(F.xxhash64("id", "nth"), F.lit(blocks)).cast("int"))
    return dealt.groupBy(block, F.size("vector").alias("d")).applyInPandas(
        pack, f"{block} int, ids binary, nths binary, vectors binary, d int")


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
          scale: int = 1024, block_rows: int = 1 << 15, query_rows: int = 1 << 12) -> DataFrame:
    """The k rows of ``base`` of highest integer inner product for every row of ``queries``, its own id left out.

    Scores are longs: a search whose products or sums leave 64 bits fails instead of wrapping, and so do components whose
    scaled value does not fit.  Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id, and with fewer rows all are returned.
    Vectors that are null, or hold null or non-finite components, and rows without id take no part; vectors of another
    number of dimensions only meet their like.  Repeated rows of ``base`` stand as often as they are there, and a
    repeated query id is answered once for each of its distinct vectors.  Empty tables give an empty result.

    Each block of vectors meets each block of queries in one task: blocks have a bounded number of rows (packed to some
    MB), hits are cut to k per query and block before they are shuffled.  All rows are indexed and no bound is a guess.
    """
    spark = base.sparkSession
    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("vector")).where(
            F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))

    rows = settle(clean(base).groupBy("id", "vector").count().withColumn(
        "nth", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).drop("count"), "topk-rows")
    asked = settle(clean(queries).distinct().withColumn("nth", F.xxhash64("vector")), "topk-queries")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, m = rows.count(), asked.count()
    blocks = max(1, -(-n // block_rows), min(tasks, -(-n // 1024)))
    sides = max(1, -(-m // query_rows))
    data, ask = packed(rows, blocks, "block"), packed(asked, sides, "side")
    pairs = (data.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
             .join(ask.select("side", "d", F.col("ids").alias("q_ids"), F.col("nths").alias("q_nths"),
                              F.col("vectors").alias("q_vectors")), ["side", "d"])
             .select("ids", "vectors", "q_ids", "q_nths", "q_vectors", "d"))

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                index = ImpactIndex(np.frombuffer(row.ids, np.int64), np.frombuffer(row.vectors, np.int64).reshape(-1, row.d))
                q_ids, q_nths = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_nths, np.int64)
                for a in range(0, len(q_ids), 256):
                    part = slice(a, a + 256)
                    hits = [index.search(v, k, q) for q, v in
                            zip(q_ids[part], np.frombuffer(row.q_vectors, np.int64).reshape(-1, row.d)[part], strict=True)]
                    found = [len(ids) for ids, _ in hits]
                    yield pd.DataFrame({"query_id": np.repeat(q_ids[part], found), "variant": np.repeat(q_nths[part], found),
                                        "vec_id": np.concatenate([ids for ids, _ in hits]),
                                        "score": np.concatenate([scores for _, scores in hits])})

    best = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")
    return (pairs.mapInPandas(search, HIT).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
