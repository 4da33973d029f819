import random

import numpy as np
from pyspark.sql import functions as F

from flowlake.llm import neardup
from tests.llm.rows import awkward_docs, no_docs

WHITE = "".join(map(chr, [32, *range(9, 14)]))


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in WHITE else c for c in low).split(" ")
    words = [w for w in words if w]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(words, rng, share):
    return [f"n{rng.randint(0, 10**6)}" if rng.random() < share else w for w in words]


def family_rows():
    """Families of variants around a base, texts that only share a long passage, copies, and texts of their own."""
    rng, rows = random.Random(11), []
    passage = [f"p{i}" for i in range(60)]
    for f in range(4):
        base = [f"f{f}w{i}" for i in range(rng.randint(80, 200))]
        rows += [edited(base, rng, rng.choice([0, 0.005, 0.01, 0.02, 0.04])) for _ in range(60)]
    rows += [passage + [f"o{k}w{i}" for i in range(30)] for k in range(80)]
    rows += [[f"u{k}w{i}" for i in range(rng.randint(1, 40))] for k in range(60)]
    rows += [rows[5]] * 30 + [[], ["one"], ["one"], ["ONE"], ["one", "two"]]
    rng.shuffle(rows)
    return [(i + 100, " ".join(w) if i % 2 else "\n".join(w).upper()) for i, w in enumerate(rows)]


def test_components_equal_brute_force(spark):
    rows = family_rows()
    want = brute(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_candidates_stay_in_proportion(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(base, rng, 0.01))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = neardup.signatures(docs, "doc_id", "text").where("set_id is not null")
    classes = marks.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    n = classes.count()
    assert neardup.candidates(classes).count() <= n * (neardup.TREES * (neardup.NEAR + neardup.PIVOTS))


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    rows = neardup.components(links.union(links.select("b", "a"))).collect()
    assert {r["node"]: r["root"] for r in rows} == {i: 0 for i in range(1, 200)}


def test_awkward_rows(spark):
    rows = neardup.near_duplicates(awkward_docs(spark)).collect()
    assert len(rows) == 14
    of = {r["doc_id"]: r for r in rows}
    assert of[1]["component_id"] == of[2]["component_id"] == of[3]["component_id"] == 1 and not of[3]["kept"]
    assert of[7]["component_id"] == of[8]["component_id"] == 7
    assert all(of[i]["kept"] and of[i]["n_shingles"] == 0 for i in (4, 5, 6))
    assert of[None]["component_id"] is None and of[None]["kept"] and of[11]["kept"]
    assert neardup.near_duplicates(no_docs(spark)).count() == 0


def test_texts_of_one_id_join_their_components(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(5, " ".join(words)), (5, "something else that is long enough"), (3, " ".join(words)),
            (9, "something else that is long enough")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in got} == {3}


def template_rows(n_pairs=1500):
    """Pairs of similarity 0.86 to 0.90 whose texts share 0.82 to 0.84 with all others: one form, filled in."""
    rng, rows = random.Random(3), []
    form = [f"t{i}" for i in range(400)]
    for k in range(n_pairs):
        cut = rng.randint(36, 41)  # words of a text's own end; ``both`` of them are those of its pair
        both = rng.randint(8, 13)
        start = [f"b{k}w{i}" for i in range(both)]
        rows += [form + start + [f"o{k}s{side}w{i}" for i in range(cut - both)] for side in (0, 1)]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def similar_pairs(rows, percent):
    """Pairs found by comparing all pairs by matrix products of their word sets."""
    sets = [shingle_set(t) for _, t in rows]
    number = {s: i for i, s in enumerate({s for x in sets for s in x})}
    owners = {}
    for i, x in enumerate(sets):
        for s in x:
            owners.setdefault(number[s], []).append(i)
    shared = np.zeros((len(rows), len(rows)), np.int32)
    everyone = sum(len(o) == len(rows) for o in owners.values())
    for o in owners.values():
        if 1 < len(o) < len(rows):
            shared[np.ix_(o, o)] += 1
    shared += everyone
    sizes = np.array([len(x) for x in sets])
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(linked, 1)), strict=True)}


def test_pairs_inside_a_shared_template_are_whole(spark):
    rows = template_rows()
    pairs = similar_pairs(rows, 85)
    assert len(pairs) == len(rows) // 2 and len({x for p in pairs for x in p}) == len(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {(r["component_id"], r["doc_id"]) for r in got if r["component_id"] != r["doc_id"]} == pairs


def test_exact_join_finds_every_pair_between_components(spark):
    rng, base = random.Random(8), [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(edited(base[:rng.randint(70, 90)], rng, rng.choice([0.01, 0.02, 0.03])))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = spark.createDataFrame([(i, i % 7) for i, _ in rows], "node bigint, root bigint")
    pairs = neardup.prefix_pairs(docs.select(F.col("doc_id").alias("a")), one, docs, "doc_id", "text", 85)
    want = {(a, b) for a, b in similar_pairs(rows, 85) if a % 7 != b % 7}
    assert want and want <= {(r["a"], r["b"]) for r in pairs.collect()}
