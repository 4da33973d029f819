"""Fill-in-the-middle against a plain splitter, for both units and odd texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowlake.llm import fim

TEXTS = ["", None, "one line", "a\nb\nc", "a\nb\n", "\n\n\n", "é\n😀x\nß", "with <P> inside\nand more", "<S>", "x<\ny<\nz", "\r\nq\x0b\n v\n"]


def lines(text):
    out = text.split("\n")
    return [x + "\n" for x in out[:-1]] + ([out[-1]] if out[-1] else [])


def plain_form(doc_id, text, unit):
    text = text or ""
    units = lines(text) if unit == "line" else list(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", ["line", "char"])
def test_equals_plain_splitter(spark, unit):
    rng = random.Random(5)
    long = ["".join(rng.choice("ab é\n😀") for _ in range(n)) for n in (1023, 1024, 1025, 5000, 40000)]
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS + long + ["\n" * 3000, "é" * 3000])] + [(None, "a\nb\n", "kept"), (3, "a\nb\nc", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim string").repartition(4)
    done = fim.transform(docs, unit=unit)
    assert done.columns == ["doc_id", "text", "fim", "_fim"]
    got = done.select("doc_id", "text", "_fim.*", fim.restored(F.col("_fim.output"), F.col("_fim.form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:7] == plain_form(r["doc_id"], r["text"], unit)
        assert r["back"] == (r["text"] or "")


def test_every_cut_of_small_blocks():
    text = "é\n\nab😀c\n" * 9 + "end"
    units = lines(text)
    for block in (1, 2, 3, 7, 64):
        cuts = fim.Cuts(text, block=block)
        assert cuts.n == len(units)
        assert [cuts.chars_before(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_rate_and_sentinels(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc") for i in range(400)], "doc_id long, text string")
    forms = {r["form"]: r["count"] for r in fim.transform(docs, fim.Format(rate=50, spm_rate=0)).groupBy("fim.form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 120 < forms["plain"] < 280
    with pytest.raises(ValueError):
        fim.Format(prefix="<A<", suffix="<B>", middle="<C>")
    empty = fim.transform(docs.limit(0))
    assert empty.count() == 0
