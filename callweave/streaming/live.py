"""Structured Streaming: the time rules of the batch operators, with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callweave.functions.staging import staged
from callweave.operators.procedures import OPENERS, QUIET_GAP, Segmenter
from callweave.streaming.ordered import marked_late


def unanswered(requests: DataFrame, answers: DataFrame, key: str, within: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Requests (key, at) without an answer (key, answered_at) inside the bound: an outer stream-stream join."""
    r = requests.withWatermark("at", late).alias("r")
    a = answers.withWatermark("answered_at", late).alias("a")
    on = F.expr(f"r.{key} = a.{key} and answered_at >= at and answered_at <= at + interval {within}")
    return r.join(a, on, "left_outer").where(f"a.{key} is null").select(f"r.{key}", "at")


def retransmissions(messages: DataFrame, by: list[str], gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Runs of two or more alike messages, chained by gaps of at most `gap`."""
    runs = messages.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return runs.where("n > 1").select(*by, F.col("w.start").alias("start"), "n")


def failure_rate(messages: DataFrame, window: str, slide: str | None = None, late: str = "1 minute", dimension: Column | None = None) -> DataFrame:
    """Messages, failures and (with a dimension) blast radius per tumbling or sliding window."""
    keys = [F.window("event_time", window, slide or window).alias("w")] + ([dimension.alias("value")] if dimension is not None else [])
    made = messages.withWatermark("event_time", late).groupBy(*keys).agg(F.count("*").alias("messages"), F.count_if("is_failure").alias("failures"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(["value"] if dimension is not None else []), "messages", "failures")


SEGMENTS = "capture_id string, flow_id string, frame long, segment long, kind string"


class _Segments(StatefulProcessor):
    """Per flow: the Segmenter's state, and rows that the watermark hasn't passed yet.

    Rows wait until no earlier one can come, and are then stepped in their order in
    time, as in a batch. A flow's state goes when nothing came for the time to live.
    """

    ROW = "frame long, seq int, ts double, at long, label string, is_failure boolean"

    def __init__(self, quiet: float, openers, keep_ms: int):
        self.quiet, self.openers, self.keep_ms = quiet, openers, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("segmenter", "number long, kind string, success array<string>, last double, failed boolean, outcome boolean")
        self.waiting = handle.getListState("waiting", self.ROW)

    def _alarm(self, at_ms: int) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = [(int(r.frame), int(r.seq), float(r.ts), int(r.event_time.value // 1_000_000), r.label, bool(r.is_failure)) for part in rows for r in part.itertuples()]
        self.waiting.appendList(new)
        self._alarm(min(r[3] for r in self.waiting.get()) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows, passed = list(self.waiting.get()), timerValues.getCurrentWatermarkInMs()
        due = sorted(((r[2], r[0], r[1], r[4], r[5]) for r in rows if r[3] < passed))
        if not due:
            if not rows:
                self.held.clear()
            return
        had = self.held.get() if self.held.exists() else None
        machine = Segmenter(self.quiet, self.openers, (had[0], had[1], tuple(had[2]), had[3], had[4], had[5]) if had else None)
        got = [machine.step(ts, label, failed) for ts, _, _, label, failed in due]
        n, kind, success, last, failed, outcome = machine.state()
        self.held.update((n, kind, list(success), last, failed, outcome))
        left = [tuple(r) for r in rows if r[3] >= passed]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        self._alarm(min(r[3] for r in left) + 1 if left else passed + self.keep_ms)
        yield pd.DataFrame({"capture_id": key[0], "flow_id": key[1], "frame": [r[1] for r in due], "segment": pd.array([x[0] if x else None for x in got], "Int64"), "kind": [x[1] if x else None for x in got]})

    def close(self) -> None:
        pass


def segment_stream(messages: DataFrame, quiet: float = QUIET_GAP, openers=OPENERS, late: str = "1 minute", keep_ms: int = 3_600_000) -> DataFrame:
    """Procedure segments as messages arrive: the batch rules in the order of time, a row once the watermark has passed it."""
    held = messages.where("flow_id is not null and protocol <> 'sip'").withWatermark("event_time", late).select("capture_id", "flow_id", "frame", "seq", "ts", "event_time", "label", "is_failure")
    return held.groupBy("capture_id", "flow_id").transformWithStateInPandas(_Segments(quiet, openers, keep_ms), SEGMENTS, "append", "eventTime")


def write_with_late_rows(messages: DataFrame, path: str, late_path: str, checkpoint: str, behind: str = "1 minute"):
    """Starts a query that appends rows in time to path and rows behind the query's own watermark to late_path, where they count.

    Whether a row is late is settled once, before the batch is written; a batch that
    is run again after a failure replaces what it had written.
    """

    def split(batch: DataFrame, number: int) -> None:
        held = staged(batch, "late-rows")
        for late, where in ((False, path), (True, late_path)):
            held.where(F.col("late") == late).drop("late").write.mode("overwrite").parquet(f"{where}/batch={number}")

    return marked_late(messages, behind).writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
