import base64
import random
import string
from collections import Counter

import zstandard

from flowlake.llm.quality_rules import Bands, apply_rules, judged, repeated_words
from tests.llm.rows import LONG, awkward_docs, no_docs

WHITE = " \t\n\v\f\r"


def brute(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if any(c not in WHITE for c in line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_counts_equal_brute_force():
    rng, packer = random.Random(1), zstandard.ZstdCompressor(level=3)
    texts = [None, "", " \v\x1c\x85  ", "a b c a b c", "a a a a", "x\ny\nx \nx\n\n \n \n", LONG]
    texts += ["".join(rng.choice("ab é#&\n\t\x1d 😀") for _ in range(rng.randint(0, 400))) for _ in range(300)]
    for t in texts:
        assert judged(t, Bands(), packer)[:6] == brute(t), t
    assert repeated_words([]) == 0


def test_bands_reject_repetition_and_noise():
    rng, packer = random.Random(2), zstandard.ZstdCompressor(level=3)
    prose = " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4)))
                     for _ in range(800))
    block = " ".join(prose.split()[:120])
    noise = " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(300))
    assert judged(prose, Bands(), packer)[-1]
    assert not judged(" ".join([f"{block} {i}" for i in range(60)]), Bands(), packer)[-1]
    assert not judged(noise, Bands(), packer)[-1]
    mixed = prose * 1 + " " + "same " * 3000  # only some chunks repeat
    assert not judged(mixed, Bands(), packer)[-1]


def test_noise_is_rejected_in_every_band():
    rng, packer = random.Random(4), zstandard.ZstdCompressor(level=3)
    printable = "".join(map(chr, range(33, 127)))
    for size in (260, 300, 350, 450, 600, 900, 1200, 1800, 3000, 4000, 6000, 20000):
        for letters in (string.ascii_letters + string.digits, printable):
            if size < 700 and letters is not printable:
                continue  # 50 words of so few bytes are too short for that
            word = min(12, size // 52 - 1)
            text = " ".join("".join(rng.choice(letters) for _ in range(word)) for _ in range(size // (word + 1)))
            rules = judged(text, Bands(), packer)
            assert not rules[5] and not rules[-1], (size, rules)


def test_awkward_rows(spark):
    rows = apply_rules(awkward_docs(spark)).collect()
    assert len(rows) == 14 and "_rules" in rows[0] and rows[0]["rules"] == "x"
    assert {r["_rules"]["n_words"] for r in rows if r["doc_id"] in (4, 5, 6)} == {0}
    assert apply_rules(no_docs(spark)).count() == 0
