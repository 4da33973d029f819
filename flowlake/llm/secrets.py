"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content.  A ledger says which rule versions have seen
which blob; a scan reads only blob and rule-version pairs that are not in it, appends what it found, and joins the
findings back to all paths and versions that hold the blob.  Column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.common import fresh

SPAN = "struct<rule:string,start:bigint,end:bigint>"
LEDGER_COLUMNS = {"blob": "binary", "scanned": "array<string>", "found": f"array<{SPAN}>"}
LEDGER_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in LEDGER_COLUMNS.items())


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose group 1 has fewer than ``least`` characters drop."""

    kind: str
    pattern: str
    least: int = 1
    words: tuple[str, ...] = ()  # any match holds one of these, in either case if ``folded``; none: look for the pattern
    folded: bool = False

    @property
    def version(self) -> str:
        return sha256(f"{self.kind}\n{self.pattern}\n{self.least}".encode()).hexdigest()[:16]


# Kinds, in the order in which spans of one start are listed, and their patterns.
BASE_RULES = (
    Rule("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                   r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6,
         ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    Rule("access", r"(AKIA[A-Z0-9]{16,})", 1, ("AKIA",)),
    Rule("hex", r"([0-9a-f]{24,})"),
)
EXTRA_RULES = (
    Rule("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, ("PRIVATE KEY-----",)),
    Rule("forge", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE_RULES + EXTRA_RULES


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of one rule in code points, end exclusive, named by the version of the rule.

    Each element of ``steps`` runs from the end of the last match to the end of the next, so the sums of their lengths
    are the ends.  ``\\G`` holds the search to that chain; without it a text without match would be read once per
    character.  The chain is slow beside a plain search, so it only runs on texts that have a match somewhere.
    """
    body = F.lower(text) if rule.folded else text
    hint = reduce(or_, [F.contains(body, F.lit(w)) for w in rule.words]) if rule.words else F.lit(True)
    likely = F.when(hint, F.regexp_like(text, F.lit(rule.pattern))).otherwise(F.lit(False))
    chain = rf"\G[\s\S]*?{rule.pattern}"
    steps = F.regexp_extract_all(text, F.lit(f"({chain})"), F.lit(1))
    empty = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, s: Column) -> Column:
        match = F.regexp_extract(s, rf"\G[\s\S]*?({rule.pattern})$", 1)
        held = F.length(F.regexp_extract(s, f"{chain}$", 1)) >= rule.least
        end = state["at"] + F.length(s)
        span = F.struct(F.lit(rule.version).alias("rule"), (end - F.length(match)).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(held, F.array_append(state["out"], span.cast(SPAN)))
                        .otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    return F.when(likely, F.aggregate(steps, start, step, lambda state: state["out"])).otherwise(empty)


def ordered(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans by start, then in the order of ``rules``."""
    place = F.array(*[F.lit(r.kind) for r in rules])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["rule"]).alias("at"),
                                                  s["end"].alias("end"), s["rule"].alias("rule")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(
        s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end")))


def as_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])))


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def create_ledger(spark: SparkSession, ledger: str) -> str:
    """An empty ledger at the path ``ledger``."""
    spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in LEDGER_COLUMNS.items()]).write.parquet(ledger)
    return ledger


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)


def extend_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Scan what the ledger has not seen of the texts in ``versions`` and append it as one increment.

    A blob is scanned by a rule version once, whatever the number of its copies; copies meet in a partial aggregate
    before the shuffle, so a blob held by a third of all versions is no hot key.  A null text is the empty blob.
    """
    seen = (read_ledger(versions.sparkSession, ledger).groupBy("blob")
            .agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen")))
    blobs = (versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("__body"))
             .groupBy("blob").agg(F.first("__body").alias("__body")).join(seen, "blob", "left"))
    due = {r: ~F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), r.version) for r in rules}
    none = F.array().cast(f"array<{SPAN}>")
    scanned = F.filter(F.array(*[F.when(due[r], F.lit(r.version)) for r in rules]), lambda v: v.isNotNull())
    found = F.concat(*[F.when(due[r], spans_of(F.col("__body"), r)).otherwise(none) for r in rules])
    (blobs.select("blob", scanned.alias("scanned"), found.alias("found")).where(F.size("scanned") > 0)
     .write.mode("append").parquet(ledger))


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans: what ``rules``, in their present versions, have found in every blob, over all increments."""
    kind_of = F.create_map(*[F.lit(x) for r in rules for x in (r.version, r.kind)])
    spans = F.transform(F.filter("spans", lambda s: F.map_contains_key(kind_of, s["rule"])), lambda s: F.struct(
        kind_of[s["rule"]].alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
    return (read_ledger(spark, ledger).where(F.size("found") > 0).groupBy("blob")
            .agg(F.flatten(F.collect_list("found")).alias("spans"))
            .select("blob", ordered(F.array_distinct(spans), rules).alias("spans")).where(F.size("spans") > 0))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text",
         name: str = "spans") -> DataFrame:
    """``versions`` with the spans found in each text, after bringing the ledger up to date.

    All rows stay, in any number of copies, with all their columns; without finding, or without text, the list is
    empty.  ``name`` gets underscores if it is taken.  An empty table only leaves an empty increment.
    """
    name = fresh(versions, name)
    extend_ledger(versions, ledger, rules, text)
    found = findings(versions.sparkSession, ledger, rules).select(F.col("blob").alias("__blob"), F.col("spans").alias(name))
    keyed = versions.withColumn("__blob", blob_id(F.col(text)))
    none = F.array().cast(f"array<{SPAN}>")
    return (keyed.join(found, "__blob", "left").drop("__blob").withColumn(name, F.coalesce(F.col(name), none)))


def redact(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """``text`` with every span (ordered by start, overlaps allowed) replaced by ``mask``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def cut(frm: Column, to: Column) -> Column:
        return F.substring(text, (frm + 1).cast("int"), (to - frm).cast("int"))

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(state["out"], cut(state["at"], s["start"]), F.lit(mask))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        spans, start, step, lambda st: F.concat(st["out"], cut(st["at"], F.length(text).cast("long")))))


def digest(scanned: DataFrame, doc_id: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Counts per base kind, SHA-256 of the base spans and all spans as text."""
    base = F.filter(spans, lambda s: s["rule"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["rule"] == kind)).cast("long")
    return scanned.select(doc_id, *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
                          F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col(spans)).alias("spans"))
