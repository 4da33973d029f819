"""Application ids of flows on a stream, from a cache of classifier entries that is kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pyspark.sql.types as T
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlake.operators.flow_keys import flow_keys
from flowlake.operators.l7 import known_apps

US_PER_MS = 1000
HELD = ("entry_lo array<boolean>, entry_us array<bigint>, entry_no array<bigint>, entry_app array<int>, "
        "ask_us array<bigint>, ask_id array<bigint>, ask_lo array<boolean>, wake bigint")


class AppCache(StatefulProcessor):
    """Entries and open questions of one flow key.

    A question waits until the watermark has passed it, so that all entries up to its time are there whatever the order
    of arrival; then it takes the newest entry not later than itself and at most ``max_age_us`` old, of its own direction
    before the other.  Of entries behind the watermark only the newest of each direction can still answer anything, until
    it is too old; the rest goes.  Timers follow event time, since Spark's own time to live counts processing time.
    """

    def __init__(self, max_age_us: int):
        self.max_age_us = max_age_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def load(self) -> tuple[dict, dict, int | None]:
        """Entries, questions and the next timer: all that is held of a key is one value, read and written once per call."""
        held = self.held.get()
        if held is None:
            return {}, {}, None
        entry_lo, entry_us, entry_no, entry_app, ask_us, ask_id, ask_lo, wake = held
        return (dict(zip(zip(entry_lo, entry_us, entry_no), entry_app)), dict(zip(zip(ask_us, ask_id), ask_lo)), wake)

    def save(self, entries: dict, questions: dict, wake: int | None) -> None:
        """Hold what is left, and wake for the first question, or else when the first entry is too old."""
        if not entries and not questions:
            self.held.clear()
            return
        first = min(k[0] for k in questions) if questions else min(k[1] for k in entries) + self.max_age_us
        due = first // US_PER_MS + 1
        if wake is None or due < wake:
            self.handle.registerTimer(due)
            wake = due
        self.held.update((*([k[i] for k in entries] for i in range(3)), list(entries.values()),
                          *([k[i] for k in questions] for i in range(2)), list(questions.values()), wake))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        entries, questions, wake = self.load()
        for r in rows:
            if r.ask:
                questions[r.ts_us, r.id] = r.from_lo
            else:
                entries[r.from_lo, r.ts_us, r.id] = r.app_id
        self.save(entries, questions, wake)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed_us = timerValues.getCurrentWatermarkInMs() * US_PER_MS
        entries, questions, wake = self.load()
        known = sorted((k[1], k[2], k[0], v) for k, v in entries.items())
        due = sorted((k[0], k[1], v) for k, v in questions.items() if k[0] < passed_us)
        out, newest, at = [], {}, 0  # newest entry of each direction up to the question in hand
        for ts_us, ask_id, from_lo in due:
            while at < len(known) and known[at][0] <= ts_us:
                newest[known[at][2]] = known[at]
                at += 1
            fresh = [newest[side][3] for side in (from_lo, not from_lo) if side in newest and ts_us - newest[side][0] <= self.max_age_us]
            out.append(Row(id=ask_id, cached_app=fresh[0] if fresh else None))
            del questions[ts_us, ask_id]
        seen = set()
        for ts_us, flow_no, from_lo, _ in reversed(known):
            if ts_us < passed_us and (from_lo in seen or ts_us + self.max_age_us < passed_us):
                del entries[from_lo, ts_us, flow_no]
            elif ts_us < passed_us:
                seen.add(from_lo)
        left = wake if wake is not None and wake > expiredTimerInfo.getExpiryTimeInMs() else None
        self.save(entries, questions, left)
        return iter(out)

    def close(self) -> None:
        pass


def resolve_apps_stream(flows: DataFrame, app_flows: DataFrame, id_col: str, max_age_s: int = 600, late: str = "30 seconds") -> DataFrame:
    """``id_col`` and ``cached_app`` of each flow on the stream ``flows`` (``src_ip, src_port, dst_ip, dst_port, proto,
    end_us``): the answer of ``l7.resolve_apps``, given as soon as the watermarks of both streams have passed ``end_us``.

    Rows may come up to ``late`` out of order on each stream; a flow or entry without time never gets an answer.
    """
    shape = ["flow_key", "from_lo", "ts_us", "id", "ask", "app_id", "ts"]
    timed = lambda df: df.withColumn("ts", F.timestamp_micros("ts_us")).select(*shape).withWatermark("ts", late)
    asked = timed(flow_keys(flows).select("flow_key", "from_lo", F.col("end_us").alias("ts_us"), F.col(id_col).cast("long").alias("id"),
                                          F.lit(True).alias("ask"), F.lit(None).cast("int").alias("app_id")))
    entries = timed(flow_keys(known_apps(app_flows)).select("flow_key", "from_lo", "ts_us", F.col("flow_no").cast("long").alias("id"),
                                                            F.lit(False).alias("ask"), F.col("app_id").cast("int")))
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("cached_app", T.IntegerType())])
    found = asked.unionByName(entries).groupBy("flow_key").transformWithState(
        AppCache(max_age_s * 1_000_000), out, outputMode="Append", timeMode="EventTime")
    return found.select(F.col("id").alias(id_col), "cached_app")
