"""Near duplicates by an LSH forest over MinHash signatures.

Every document text becomes a set of 5-word shingles.  Texts with equal sets form a class, which is represented by its
smallest id.  The forest holds several orders of the classes, each sorted by another sequence of signature values, so
that classes with a long common prefix lie side by side.  Neighbours that share a prefix are candidates: in a sparse
region a short prefix is enough, in a dense one the sort itself deepens it, since only the nearest in the order meet.
Candidates are confirmed on the full sets, and links are joined to components.  Where a dense region still holds several
components, an exact join on the rarest shingles of its sets finds the links that the nearest did not show.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.session import settle

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORDS = 5  # of a shingle
VALUES = 128  # of a signature
TREES, SHORTEST, DEPTH = 20, 4, 24  # orders; least common prefix; length of a sort key
BLOCK = 512  # rows of a dense region that go on together
NEAR, PIVOTS = 2, 3  # neighbours on one side; middles of a dense region that all its rows meet
BITS = 20  # of a shingle, by which its frequency is counted
SALTED = 500  # rows of one shingle that go together in the exact join
_random = np.random.default_rng(20240501)
FACTORS = _random.integers(1, 2 ** 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 2 ** 63, VALUES, dtype=np.uint64)


def tree_positions() -> np.ndarray:
    """Signature positions that make up the key of each order: disjoint beginnings, then all others at random."""
    rest, keys = np.random.default_rng(7), []
    for t in range(TREES):
        first = np.arange(t * SHORTEST, (t + 1) * SHORTEST)
        keys.append(np.concatenate([first, rest.permutation(np.setdiff1d(np.arange(VALUES), first))[:DEPTH - SHORTEST]]))
    return np.array(keys)


POSITIONS = tree_positions()


def shingles(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words make one shingle, none make none."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    for w in set(words).difference(memo):
        memo[w] = xxhash.xxh3_64_intdigest(w)
    hashed = np.array([memo[w] for w in words], dtype=np.uint64)
    n = len(hashed) - WORDS + 1
    out = hashed[:n].copy()
    for k in range(1, WORDS):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += hashed[k:n + k]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the least of each of ``VALUES`` hashes of the set."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(hashes), 256):
        np.minimum(least, (hashes[a:a + 256, None] * FACTORS + TERMS).min(axis=0), out=least)
    return (least ^ (least >> np.uint64(23))).astype(np.uint16).view(np.int16)


def trimmed(memo: dict) -> None:
    if len(memo) > 50_000:
        memo.clear()


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, set_id (128-bit digest of the set, null if empty) and signature of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            trimmed(memo)
            sets = [shingles(t.as_py(), memo) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int16()))],
                ["doc_id", "n_shingles", "set_id", "signature"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_id binary, signature array<smallint>")


def prefix_sizes(changed: np.ndarray) -> np.ndarray:
    """For each row of one sorted order, the sum over all depths of the other rows that share its prefix of that depth.

    ``changed[i]``: the depth at which row i leaves the prefix of the row before it.  The sum is largest on the path
    that most rows of a region follow, hence for the texts in the middle of a family of variants.
    """
    total = np.zeros(len(changed), np.int64)
    for depth in range(SHORTEST, DEPTH + 1):
        group = np.cumsum(changed < depth)
        total += np.bincount(group)[group] - 1
    return total


def neighbours(order: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Pairs of nodes (m x 2) that are near in the sorted rows ``order`` (tree and key) and share the shortest prefix."""
    found = []
    for j in range(1, NEAR + 1):
        near = (order[:-j, :SHORTEST + 1] == order[j:, :SHORTEST + 1]).all(axis=1)
        found.append(np.column_stack([nodes[:-j][near], nodes[j:][near]]))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def sorted_orders(classes: DataFrame) -> DataFrame:
    """tree, key, node: each class once in every order, cut into ranges of (tree, key, node) and sorted in each range.

    Ranges follow the data, so a region of any density, or even equal signatures in any number, spreads over tasks.
    """
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().view(np.uint16).reshape(-1, VALUES)
            for t, at in enumerate(POSITIONS):
                keys = np.ascontiguousarray(values[:, at].astype(">u2"))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(keys), t, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()),
                    batch.column(0)], ["tree", "key", "node"])

    rows = classes.select("rep", "signature").mapInArrow(grow, "tree int, key binary, node bigint")
    return rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")


MET = "kind string, tree int, key binary, a bigint, b bigint, block bigint"


def met_rows(kind: str, tree, key, a, b, block=None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([
        pa.array([kind] * n, pa.string()), pa.nulls(n, pa.int32()) if tree is None else pa.array(tree, pa.int32()),
        pa.nulls(n, pa.binary()) if key is None else pa.array(key, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
        pa.nulls(n, pa.int64()) if block is None else pa.array(block, pa.int64())], ["kind", "tree", "key", "a", "b", "block"])


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one range of the orders shows: ``pair`` rows (a, b), ``member`` rows (region, node a, prefix sizes b) of the
    regions with more rows than their neighbours cover, in blocks of at most ``BLOCK`` rows, and ``edge`` rows (key, node a), the first and last of the range.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    trees, nodes = rows.column(0).to_numpy(), rows.column(2).to_numpy()
    keys = rows.column(1).to_pylist()
    order = np.column_stack([trees.astype(">u2"), np.frombuffer(b"".join(keys), ">u2").reshape(-1, DEPTH)])
    pairs = neighbours(order, nodes)
    yield met_rows("pair", None, None, pairs[:, 0], pairs[:, 1])
    differs = order[1:] != order[:-1]
    changed = np.concatenate([[-1], np.where(differs.any(axis=1), differs.argmax(axis=1) - 1, DEPTH)])
    region = np.cumsum(changed < SHORTEST) - 1
    size = np.bincount(region)[region]
    dense = np.flatnonzero((size > NEAR + 1) | (region == 0) | (region == region[-1]))
    score = prefix_sizes(changed)
    block = (TaskContext.get().partitionId() << 32) + dense // BLOCK
    yield met_rows("member", trees[dense], [keys[i][:2 * SHORTEST] for i in dense], nodes[dense], score[dense], block)
    ends = sorted({*range(min(NEAR, len(nodes))), *range(max(0, len(nodes) - NEAR), len(nodes))})
    yield met_rows("edge", trees[ends], [keys[i] for i in ends], nodes[ends], nodes[ends])


def stitched(edges: DataFrame) -> DataFrame:
    """Pairs across the cuts of the orders, from the few rows at the ends of the ranges (tree, key, a)."""
    w, prefix = Window.partitionBy("tree").orderBy("key", "a"), F.substring("key", 1, 2 * SHORTEST)
    near = F.array(*[F.when(F.lead(prefix, j).over(w) == prefix, F.lead("a", j).over(w)) for j in range(1, NEAR + 1)])
    pairs = edges.select("tree", "key", "a").distinct().withColumn("near", near).select("a", F.explode("near").alias("b"))
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def forest(classes: DataFrame) -> DataFrame:
    """What all ranges of the sorted orders show (see ``walk``)."""
    return settle(sorted_orders(classes).mapInArrow(walk, MET), "forest-walk")


def candidates(classes: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """Distinct pairs a < b of classes (rep, signature) that the forest brings together.

    Each class meets its ``NEAR`` neighbours on both sides in every order if they share the shortest prefix.  In dense
    regions these are only the nearest; there each class also meets the ``PIVOTS`` classes in the middle of the region,
    those of the largest prefix sizes over all orders; a region goes to that join in blocks, so a large one is spread.  So the number of candidates stays in proportion to the classes.
    """
    met = forest(classes) if met is None else met
    across = stitched(met.where("kind = 'edge'"))
    members = met.where("kind = 'member'").select("tree", "key", "block", F.col("a").alias("node"), F.col("b").alias("score"))
    density = members.groupBy("node").agg(F.sum("score").alias("density"))
    place = F.row_number().over(Window.partitionBy("tree", "key").orderBy(F.desc("density"), "node"))
    middle = settle(members.join(density, "node").withColumn("place", place).where(F.col("place") <= PIVOTS)
                    .select("tree", "key", F.col("node").alias("pivot")), "forest-pivots")
    blocks = members.select("tree", "key", "block").distinct().join(middle, ["tree", "key"])
    to_pivots = (members.join(blocks, ["tree", "key", "block"]).where("node <> pivot")
                 .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")))
    return met.where("kind = 'pair'").select("a", "b").union(across).union(to_pivots).distinct()


def shingle_sets(docs: DataFrame, doc_id: str, text: str, asked: DataFrame) -> DataFrame:
    """node, shingles: the sets, taken from the texts again, of the ids in ``asked`` (a)."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            trimmed(memo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [shingles(t.as_py(), memo).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], ["node", "shingles"])

    source = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("body"))
    return (source.join(asked, source["node"] == asked["a"], "left_semi")
            .mapInArrow(sets, "node bigint, shingles array<bigint>").where(F.size("shingles") > 0))


def unsettled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """a: the classes in dense regions that hold more than one component of ``roots`` (node, root)."""
    members = met.where("kind = 'member'").select("tree", "key", "block", F.col("a").alias("node"))
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = (placed.groupBy("tree", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
             .where((F.col("lo") < F.col("hi")) & (F.col("n") > NEAR + 1)).select("tree", "key"))
    blocks = members.select("tree", "key", "block").distinct().join(mixed, ["tree", "key"], "left_semi")
    return members.join(blocks, ["tree", "key", "block"], "left_semi").select(F.col("node").alias("a")).distinct()


def counted_shingles(sets: DataFrame) -> np.ndarray:
    """How many shingles of all ``sets`` fall into each of 2 ** ``BITS`` buckets of their leading bits."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            at = batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
            total += np.bincount(at.astype(np.int64), minlength=1 << BITS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["bucket", "n"])

    rows = sets.select("shingles").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BITS, np.int64)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return counts


def rarest(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """token, node, n, at, short: the first shingles of each set in one order of all shingles, rare ones first.

    Two sets of the given similarity, the larger of n shingles, share one of the first n - least + 1 of the larger,
    where least = percent x n / 100, and it is among those of the smaller that are marked ``short``, as both share
    2 x percent / (100 + percent) of the smaller.  ``at`` is the place of the shingle in its set.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for node, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = values.values.to_numpy().view(np.uint64)
                n = len(values)
                ranked = values[np.lexsort((values, counts[(values >> np.uint64(64 - BITS)).astype(np.int64)]))]
                ranked = ranked[:n - -(-percent * n // 100) + 1].view(np.int64)
                shorter = n - -(-2 * percent * n // (100 + percent)) + 1
                parts.append(np.column_stack([ranked, np.full(len(ranked), node), np.full(len(ranked), n), np.arange(len(ranked)),
                                              np.arange(len(ranked)) < shorter]))
            if parts:
                token, nodes, n, at, short = np.concatenate(parts).T
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(nodes), pa.array(n), pa.array(at), pa.array(short == 1)],
                                                 ["token", "node", "n", "at", "short"])

    return sets.select("node", "shingles").mapInArrow(first, "token bigint, node bigint, n bigint, at bigint, short boolean")


def prefix_pairs(asked: DataFrame, roots: DataFrame, docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """Pairs a < b of ``asked`` (a) in different components that can have the given similarity: all that have it are there.

    An equi join on the rarest shingles.  Rows of the component that most rows of a shingle belong to do not meet each
    other, so a large family costs no more than the rows outside it; a frequent shingle is spread over squares of salts.
    """
    sets = settle(shingle_sets(docs, doc_id, text, asked), "forest-dense-sets")
    rows = settle(rarest(sets, counted_shingles(sets), percent).join(roots, "node", "left")
                  .withColumn("root", F.coalesce("root", "node")).distinct(), "forest-rarest")
    per_root = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"), F.count_if("short").alias("shorts"))
    tokens = settle(per_root.groupBy("token").agg(
        F.max_by("root", F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.sum("k").alias("k"),
        F.sum("shorts").alias("shorts")).where("roots > 1 and shorts > 0")
        .select("token", "top", F.ceil(F.col("shorts") / SALTED).alias("rows_of"), F.ceil(F.col("k") / SALTED).alias("columns_of")), "forest-tokens")
    known = settle(rows.join(tokens, "token"), "forest-shared")
    own = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    small = (known.where("short").withColumn("p", own("rows_of")).withColumn("q", each("columns_of"))
             .select("token", "p", "q", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("at").alias("j"), F.col("root").alias("ry"),
                     (F.col("root") == F.col("top")).alias("most")))
    large = (known.withColumn("q", own("columns_of")).withColumn("p", each("rows_of"))
             .select("token", "p", "q", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("at").alias("i"), F.col("root").alias("rx"),
                     (F.col("root") == F.col("top")).alias("main")))
    rest = F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j"))  # at most so many are shared, if this is the first
    fits = ((F.col("rx") != F.col("ry")) & (F.struct("ny", "y") < F.struct("nx", "x")) & (100 * F.col("ny") >= percent * F.col("nx"))
            & ((100 + percent) * rest >= percent * (F.col("nx") + F.col("ny"))))
    found = [s.join(g, ["token", "p", "q"]).where(fits) for s, g in ((small.where("not most"), large),
                                                                   (small.where("most"), large.where("not main")))]
    return found[0].union(found[1]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 x intersection >= percent x union.

    Pairs whose signatures agree in far fewer values than such a similarity makes likely (five standard deviations) go
    first; the sets of the rest are taken from their texts again, as keeping all sets would take more than the texts.
    """
    share = percent / 100
    least = int(VALUES * share - 5 * (VALUES * share * (1 - share)) ** 0.5)

    agreement = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)

    mark = classes.select("rep", "signature", "n_shingles")
    both = (pairs.join(mark.toDF("a", "sa", "na"), "a").join(mark.toDF("b", "sb", "nb"), "b")
            .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    likely = settle(both.where(agreement >= least).select("a", "b"), "forest-likely")
    asked = settle(likely.select("a").union(likely.select("b")).distinct(), "forest-asked")

    known = settle(shingle_sets(docs, doc_id, text, asked), "forest-sets")
    shared = F.size(F.array_intersect("sa", "sb"))
    return (likely.join(known.toDF("a", "sa"), "a").join(known.toDF("b", "sb"), "b")
            .where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct())


def components(links: DataFrame) -> DataFrame:
    """node, root: every node of ``links`` (a, b) with the smallest node it can reach.

    Large and small stars in turn: each node's neighbours are tied to its smallest neighbour, first those above it,
    then those below, until the edges are stars.  Each step is an aggregate of minima and one equi join, which Spark
    splits where a node has many edges; the number of steps grows with the logarithm of the links.
    """
    edges, before = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
                           .distinct(), "star-edges"), None
    while True:
        sides = edges.union(edges.select(F.col("v"), F.col("u")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = settle(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
                       .where("u <> v").distinct(), "star-edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Texts are linked if 100 x shared shingles >= percent x all shingles of both; a component is what links reach, its
    id the smallest doc_id in it, and the document of that id is kept.  A null, empty or blank text has no shingles and
    links with nothing; so does a row without id, which has no component and is kept.  Rows of one id count as one
    document and share its component.  An empty table gives an empty result; other columns are left behind.
    """
    marks = settle(signatures(docs, doc_id, text), "forest-signatures")
    linked = marks.where(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull())
    classes = settle(linked.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"),
                                                  F.first("n_shingles").alias("n_shingles")), "forest-classes")
    met = forest(classes)
    links = settle(confirmed(candidates(classes, met), classes, docs, doc_id, text, percent), "forest-links")
    # a document with several texts joins their classes
    several = linked.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y")
    tied = (linked.join(several, "doc_id", "left_semi").join(classes.select("set_id", "rep"), "set_id")
            .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = components(links.union(tied))
    asked = settle(unsettled(met, roots), "forest-unsettled")
    if not asked.isEmpty():
        more = prefix_pairs(asked, roots, docs, doc_id, text, percent)
        more = settle(confirmed(more, classes, docs, doc_id, text, percent), "forest-more-links")
        if not more.isEmpty():
            roots = components(roots.toDF("a", "b").union(more))
    placed = (marks.join(classes.select("set_id", "rep"), "set_id", "left")
              .join(roots, F.col("rep") == F.col("node"), "left"))
    component = F.coalesce("root", "rep", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return placed.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
