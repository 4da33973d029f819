"""Token alignment against plain loops over all token pairs."""

import hashlib
import random
from collections import Counter

import pytest

from flowlake.llm import alignment
from flowlake.llm.alignment import Pair, link_statistics

TEXTS = ["", None, "Plain words, twice. Plain words, twice.", "naïve café 😀😀 ﬁn", "  spaced   out \t\n\n lines\r\n", "a<|endoftext|>b </s><s> <0x41>",
         "x", " ", "▁ marked ▁▁ text", "1234567890 3.14", "Grüße aus Köln — «ça va» — niño", "\x00\x01", "word " * 300, "日本語のテキスト。한국어"]


@pytest.fixture(scope="module")
def tool():
    return Pair().load()


def spans(tool_side, ids):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + len(tool_side.tokens[i])))
        at = out[-1][2]
    return out


def brute_force(tool, texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    docs = []
    for text in texts:
        if not text:
            docs.append(([], [], [], []))
            continue
        a, b = spans(tool.a, tool.a.encode([text])[0]), spans(tool.b, tool.b.encode([text])[0])
        want = (" " + text).encode()
        if any(b"".join(s.tokens[i] for i, _, _ in side) != want for s, side in ((tool.a, a), (tool.b, b))):
            docs.append(([], [], [], []))
            continue
        pairs = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        groups, lo = [], 0
        for hi in sorted({x[2] for x in a} & {y[2] for y in b}):
            groups.append([[i for i, s, e in side if lo <= s and e <= hi] for side in (a, b)])
            lo = hi
        docs.append((a, b, pairs, groups))
    count = Counter(p for _, _, pairs, _ in docs for p in pairs)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    out = []
    for a, b, pairs, groups in docs:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(a), len(b), len(groups), len(pairs), sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


@pytest.mark.parametrize("block_chars", [40, 1 << 20])
def test_equals_all_pairs(spark, tool, block_chars):
    texts = TEXTS + ["Plain words, twice. Plain words, twice."]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, block int").repartition(3)
    got = sorted(tuple(r) for r in link_statistics(docs, run_chars=30, block_chars=block_chars).collect())
    assert got == [(i, *row) for i, row in enumerate(brute_force(tool, texts))]


def test_null_ids_repeated_rows_and_no_rows(spark, tool):
    rows = [(None, "some text"), (None, "some text"), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in link_statistics(docs).collect()), key=str)
    want = brute_force(tool, [t for _, t in rows])
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)
    assert link_statistics(docs.limit(0)).collect() == []


def test_ids_and_groups_of_the_operator(spark, tool):
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)], "doc_id long, text string, alignment string")
    done = alignment.align(docs, run_chars=25)
    assert done.columns[-1] == "_alignment"
    for r in done.collect():
        x = r["_alignment"]
        groups = [[[i for i, g in zip(ids, gs) if g == k] for ids, gs in ((x["a_ids"], x["a_groups"]), (x["b_ids"], x["b_groups"]))]
                  for k in range(max(x["a_groups"], default=-1) + 1)]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        want = brute_force(tool, [r["text"]])[0]
        assert (len(x["a_ids"]), len(x["b_ids"]), len(groups)) == want[:3]
        assert (hashlib.sha256(text.encode()).hexdigest() if text else "") == want[6]


def test_both_engines_give_the_same_ids(tool):
    from tokenizers import Tokenizer
    slow = Tokenizer.from_file(Pair().a)
    slow.encode_special_tokens = True
    rng = random.Random(8)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    bits = [" the", "ing", "'s", "'LL", "12", "\n\n", "  ", "\r", "\t", "aei", "<|endoftext|>", "!?"]
    texts = [f"a{c}1{c} {c}{c}! {c}b\n{c} " for c in map(chr, range(0x3000))]
    texts += ["".join(rng.choice([chr(rng.choice(points)), rng.choice(bits)]) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    assert tool.a.encode(texts) == [e.ids for e in slow.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_byte_table_spells_all_bytes(tool):
    assert sorted(alignment.byte_of_char().values()) == list(range(256))
    assert len(tool.a.tokens) == 50257 and len(tool.b.tokens) == 32000
