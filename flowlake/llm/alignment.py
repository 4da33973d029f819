"""Alignment of two tokenizers' tokens over the same texts.

Both tokenizers encode the same bytes.  Per batch of documents, ``pandas.merge_asof`` keyed by document finds for each
token start the other side's token that covers it; both directions together are all overlapping pairs (links), and byte
offsets where tokens of both sides end cut the text into groups.

Corpus-wide counts of linked id pairs go through blocks: a task numbers the distinct pairs of up to ``block_bytes`` of
text, so a pair, however frequent, moves once per block and not once per link.  The counts come back to the blocks by
a join, and each block turns them into its documents' sums.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import fresh
from flowlake.session import settle

TOKENIZERS = "/opt/tokenizers"


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


# Fixed value: how byte-level vocabularies split a text before they merge bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level tokenizer file (json) of the ``tokenizers`` library; it encodes space + text.

    Where the file's merges are in the order of their ids and it splits by ``WORDS``, the same merges run in ``tiktoken``,
    which takes a fifth of the time; the ids are the same (``tests/llm/test_alignment.py``).  Other files run in
    ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            known, chars = json.load(file), byte_of_char()
        vocab, special = known["model"]["vocab"], {t["id"]: t["content"] for t in known["added_tokens"]}
        self.tokens = [b""] * (max([*vocab.values(), *special]) + 1)
        for token, at in [*vocab.items(), *((t, i) for i, t in special.items())]:
            self.tokens[at] = token.encode() if at in special else bytes(chars[c] for c in token)
        if self.plain(known):
            import tiktoken
            ranks = {t: i for i, t in enumerate(self.tokens) if i not in special}
            fast = tiktoken.Encoding("from-file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.encode_all = lambda texts: [fast.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer
            tool = Tokenizer.from_file(path)
            tool.encode_special_tokens = True
            self.encode_all = lambda texts: [e.ids for e in tool.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def plain(known: dict) -> bool:
        model, split = known["model"], known["pre_tokenizer"] or {}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [model["vocab"].get(m, -1) for m in merged]
        return (model["type"] == "BPE" and not known["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex", False)
                and not split.get("add_prefix_space", True) and not model.get("dropout") and not model.get("ignore_merges")
                and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
                and ids == sorted(ids) and ids[:1] == [256])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.encode_all([" " + t for t in texts])


class Pieces:
    """A model file of the ``sentencepiece`` library, which puts the space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.tool = SentencePieceProcessor(model_file=path)
        ids = range(self.tool.get_piece_size())
        pieces = self.tool.id_to_piece(list(ids))
        self.tokens = [bytes([int(p[3:5], 16)]) if self.tool.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in zip(ids, pieces, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tool.encode(texts, num_threads=1)


@dataclass(frozen=True)
class Pair:
    """The two tokenizer files: a byte-level one (A) and a piece model (B).  Every executor needs them at these paths."""

    a: str = f"{TOKENIZERS}/byte_bpe_50k.json"
    b: str = f"{TOKENIZERS}/piece_bpe_32k.model"

    def load(self) -> Aligner:
        return loaded(self)


@lru_cache(maxsize=1)
def loaded(pair: Pair) -> Aligner:
    """The tokenizers are loaded once per Python worker, which serves many tasks."""
    return Aligner(ByteLevel(pair.a), Pieces(pair.b))


@dataclass
class Side:
    """Tokens of a run of documents: id, document, and start and end as byte offsets that run on over the documents."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, ids: list[list[int]], widths: np.ndarray) -> Side:
        flat = np.fromiter(chain.from_iterable(ids), np.int64)
        end = np.cumsum(widths[flat])
        return cls(flat, np.repeat(np.arange(len(ids)), list(map(len, ids))), end - widths[flat], end)


@dataclass
class Run:
    """Alignment of a run of documents; ``link_a`` and ``link_b`` are the token numbers of each link, by document."""

    a: Side
    b: Side
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    n_docs: int

    def counts(self, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=self.n_docs)

    def groups_of(self) -> np.ndarray:
        last = np.flatnonzero(np.diff(self.group_a, append=-1))
        return self.counts(self.a.doc[last])


def links(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs, in order of the documents.

    Going from B to A, tokens that start together are left out: that pair was already found from A to B.
    """
    left, right = (pd.DataFrame({"doc": s.doc, "at": s.start, n: np.arange(len(s.ids))}) for s, n in ((a, "i"), (b, "j")))
    to_b, to_a = pd.merge_asof(left, right, on="at", by="doc"), pd.merge_asof(right, left, on="at", by="doc")
    to_a = to_a[a.start[to_a["i"].to_numpy(np.int64)] != to_a["at"].to_numpy()]
    i, j = (np.concatenate([to_b[c].to_numpy(np.int64), to_a[c].to_numpy(np.int64)]) for c in "ij")
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


class Aligner:
    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.widths_a, self.widths_b = (np.array([len(t) for t in s.tokens], np.int64) for s in (a, b))
        self.inner, self.last_a, self.last_b = (np.array([f"{i}{mark}" for i in range(max(len(a.tokens), len(b.tokens)))], object) for mark in ",|;")

    def run(self, texts: list[str | None]) -> Run:
        """Documents without text, and those whose tokens don't spell space + text on both sides, get no tokens."""
        at = [k for k, t in enumerate(texts) if t]
        ids_a, ids_b = [[[] for _ in texts] for _ in "ab"]
        if at:
            for k, x, y in zip(at, self.a.encode([texts[k] for k in at]), self.b.encode([texts[k] for k in at]), strict=True):
                want = (" " + texts[k]).encode()
                if b"".join([self.a.tokens[i] for i in x]) == want == b"".join([self.b.tokens[i] for i in y]):
                    ids_a[k], ids_b[k] = x, y
        a, b = Side.of(ids_a, self.widths_a), Side.of(ids_b, self.widths_b)
        common = np.intersect1d(a.end, b.end, assume_unique=True)
        return Run(a, b, np.searchsorted(common, a.end), np.searchsorted(common, b.end), *links(a, b), len(texts))

    def groups(self, run: Run) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` per document: the ids of both sides, group by group."""
        a, b = run.a, run.b
        n = int(run.group_a[-1]) + 1 if len(run.group_a) else 0
        before_b, before_a = np.searchsorted(run.group_b, np.arange(n + 1)), np.searchsorted(run.group_a, np.arange(n + 1))
        words = np.empty(len(a.ids) + len(b.ids), object)  # each id with what follows it
        for ids, group, at, last in ((a.ids, run.group_a, np.arange(len(a.ids)) + before_b[run.group_a], self.last_a),
                                     (b.ids, run.group_b, np.arange(len(b.ids)) + before_a[run.group_b + 1], self.last_b)):
            ends = np.flatnonzero(np.diff(group, append=-1))
            words[at] = self.inner[ids]
            words[at[ends]] = last[ids[ends]]
        ends = np.cumsum(run.counts(a.doc) + run.counts(b.doc))
        return ["".join(words[lo:hi].tolist())[:-1] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


def slices(texts: list[str | None], run_chars: int) -> Iterator[tuple[int, int]]:
    """Consecutive documents of about ``run_chars`` characters together; a longer document stands alone."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > start and size + n > run_chars:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def align(docs: DataFrame, pair: Pair = Pair(), text: str = "text", name: str = "alignment", run_chars: int = 1 << 17) -> DataFrame:
    """``docs`` with a struct ``name``: the ids of both sides, and per id the number of its group (from 0).

    Null and empty texts, and texts that a tokenizer does not spell back exactly, get empty lists.  All rows and columns
    stay; ``name`` gets underscores if it is taken.  Memory follows the run of documents in hand, at least one whole text.
    """
    name, kind = fresh(docs, name), "struct<a_ids:array<int>,b_ids:array<int>,a_groups:array<int>,b_groups:array<int>>"

    @F.pandas_udf(kind)
    def aligned(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = pair.load()
        for part in parts:
            texts, rows = part.tolist(), []
            for lo, hi in slices(texts, run_chars):
                run = tool.run(texts[lo:hi])
                sides = [np.split(x, np.cumsum(run.counts(s.doc))[:-1]) for s, x in (
                    (run.a, run.a.ids), (run.b, run.b.ids), (run.a, run.group_a), (run.b, run.group_b))]
                rows += [(x, y, g - g[:1], h - h[:1]) for x, y, g, h in zip(*sides, strict=True)]
            yield pd.DataFrame(rows, columns=["a_ids", "b_ids", "a_groups", "b_groups"])

    return docs.withColumn(name, aligned(F.coalesce(F.col(text), F.lit(""))))


PACKED = [("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
          ("groups_sha256", pa.string()), ("links", pa.binary()), ("slot", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())]


def packed(numbers: np.ndarray) -> bytes:
    """Pair numbers of a document: the bytes of equal weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


class Block:
    """Documents of one task until they make a block: their figures and the codes of their linked pairs."""

    def __init__(self, kind: pa.DataType, n_b: int):
        self.kind, self.n_b = kind, n_b
        self.ids, self.rows, self.codes, self.size = [], [], [], 0

    def add(self, ids: pa.Array, run: Run, groups: list[str], size: int) -> None:
        doc = run.a.doc[run.link_a]
        code = run.a.ids[run.link_a] * self.n_b + run.b.ids[run.link_b]
        self.ids.append(ids)
        self.codes.append(code)
        self.size += size
        self.rows += [(*figures, hashlib.sha256(g.encode()).hexdigest() if figures[0] else "") for *figures, g in zip(
            run.counts(run.a.doc).tolist(), run.counts(run.b.doc).tolist(), run.groups_of().tolist(), run.counts(doc).tolist(), groups,
            strict=True)]

    def batches(self, block: int, schema: pa.Schema, rows_each: int = 4096) -> Iterator[pa.RecordBatch]:
        """Rows of the documents, then rows of the pairs; frequent pairs have small numbers."""
        codes, slot, n = np.unique(np.concatenate(self.codes), return_inverse=True, return_counts=True)
        by_count = np.argsort(-n, kind="stable")
        rank = np.empty(len(codes), np.int64)
        rank[by_count] = np.arange(len(codes))
        slots, ids = rank[slot], pa.concat_arrays(self.ids)
        ends = np.cumsum([r[3] for r in self.rows])
        n_a, n_b, n_groups, n_links, digest = zip(*self.rows, strict=True)
        links = [packed(slots[hi - r[3]:hi]) if r[3] else None for r, hi in zip(self.rows, ends, strict=True)]
        yield from self.cut(schema, len(ids), rows_each, doc_id=ids, block=pa.repeat(pa.scalar(block, pa.int64()), len(ids)), n_a=n_a, n_b=n_b,
                            n_groups=n_groups, n_links=n_links, groups_sha256=digest, links=links)
        yield from self.cut(schema, len(codes), 16 * rows_each, block=pa.repeat(pa.scalar(block, pa.int64()), len(codes)),
                            slot=np.arange(len(codes), dtype=np.int32), pair=codes[by_count], n=n[by_count])

    @staticmethod
    def cut(schema: pa.Schema, rows: int, rows_each: int, **known) -> Iterator[pa.RecordBatch]:
        columns = [pa.nulls(rows, f.type) if f.name not in known else known[f.name] if isinstance(known[f.name], pa.Array)
                   else pa.array(known[f.name], f.type) for f in schema]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=rows_each)


def link_statistics(docs: DataFrame, pair: Pair = Pair(), doc_id: str = "doc_id", text: str = "text", run_chars: int = 1 << 17,
                    block_chars: int = 4 << 20) -> DataFrame:
    """Per row of ``docs``: its id, numbers of tokens, groups and links, the digest of its groups, and how its links rank.

    ``n_best`` counts links whose id pair has the highest corpus-wide count of all pairs of its B id (ties included),
    ``count_sum`` adds the counts up over the links.  Null, empty and not exactly spelled texts have zeros and ''; repeated
    rows and null ids are rows like others.  Other columns are not read.  A task holds ``block_chars`` of text at most, or
    one longer document.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = {"int64": T.LongType(), "int32": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType()}
    out = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType),
                        *[T.StructField(n, fields[str(t)]) for n, t in PACKED]])

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, made, block, schema = pair.load(), 0, None, None
        first = TaskContext.get().partitionId() << 32  # block numbers of a task, the same in a repeated one
        for part in parts:
            schema = schema or pa.schema([pa.field("doc_id", part.schema.field("doc_id").type), *[pa.field(n, t) for n, t in PACKED]])
            texts = part.column("text").to_pylist()
            for lo, hi in slices(texts, run_chars):
                size = sum(len(t or "") for t in texts[lo:hi])
                if block and block.size + size > block_chars:
                    yield from block.batches(first + made, schema)
                    made, block = made + 1, None
                block = block or Block(part.schema.field("doc_id").type, len(tool.b.tokens))
                run = tool.run(texts[lo:hi])
                block.add(part.column("doc_id").slice(lo, hi - lo), run, tool.groups(run), size)
        if block:
            yield from block.batches(first + made, schema)

    stored = settle(source.mapInArrow(blocks, out), "alignment-blocks")
    n_b = F.lit(len(Pieces(pair.b).tokens))
    pairs = stored.where("pair is not null").select("block", "slot", "pair", "n")
    counts = settle(pairs.groupBy("pair").agg(F.sum("n").alias("total")), "alignment-counts")
    best = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("total").alias("top"))
    # at most one row per id of B's vocabulary
    ranked = counts.join(F.broadcast(best), F.col("pair") % n_b == F.col("b")).select(
        "pair", "total", (F.col("total") == F.col("top")).alias("best"))
    known = pairs.join(ranked, "pair").select("block", "slot", "total", "best")
    figures = stored.where("pair is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    done = T.StructType([*[f for f in figures.schema if f.name not in ("block", "links")],
                         T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    # a block's pairs come before its documents, so a task holds the counts of one block and passes documents on
    both = known.unionByName(figures, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("slot").isNull())
    return both.mapInArrow(with_sums, done).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def with_sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with ``n_best`` and ``count_sum``, from rows in the order: pairs of a block, documents of that block."""
    block, counts, values = None, [], None
    for part in parts:
        numbers, is_pair = part.column("block").to_numpy(zero_copy_only=False), part.column("slot").is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(is_pair.astype(np.int8)) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, part.num_rows], strict=True):
            if lo == hi:
                continue
            rows = part.slice(lo, hi - lo)
            if numbers[lo] != block:
                block, counts, values = numbers[lo], [], None
            if is_pair[lo]:
                counts.append([rows.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "total", "best")])
                continue
            if values is None:
                slot, total, best = (np.concatenate(x) for x in zip(*counts, strict=True)) if counts else (np.zeros(0, np.int64),) * 3
                values = np.zeros((2, len(slot)), np.int64)
                values[:, slot.astype(np.int64)] = best.astype(np.int64), total.astype(np.int64)
            links = (unpacked(x) if x else None for x in rows.column("links").to_pylist())
            sums = [(0, 0) if x is None else values[:, x].sum(axis=1).tolist() for x in links]
            kept = [rows.column(c) for c in rows.schema.names if c not in ("block", "slot", "total", "best", "links")]
            names = [c for c in rows.schema.names if c not in ("block", "slot", "total", "best", "links")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(list(x), pa.int64()) for x in zip(*sums, strict=True)]], [*names, "n_best", "count_sum"])
