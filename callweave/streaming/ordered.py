"""Rules that need the order of time, on streams: rows wait until the watermark has passed them.

All of them take event time from the stream's own watermark. Frames of a capture are
taken to be numbered in the order of time, as a capture device does. A group's state
goes when nothing came for it for the time to live. Spark wants the RocksDB state
store for these (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callweave.operators.correlate import Episodes
from callweave.operators.pairing import FORWARD_LEAD, QUOTE_AGE
from callweave.operators.sequences import TIMERS, TOLERANCE, detail

KEEP_MS = 3_600_000


def _plain(value):
    """A pandas cell as a plain value; missing ones as None."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return None if pd.isna(value) else value


def _millis(event_time: str = "event_time"):
    """Event time as a plain number: without the column's watermark mark, Spark hands on rows behind it instead of dropping them."""
    return F.unix_millis(event_time).alias("at")


def timed(stream: DataFrame, late: str) -> DataFrame:
    """The stream with its watermark; rows without an event time count as the oldest there are."""
    held = stream.withColumn("event_time", F.coalesce("event_time", F.timestamp_seconds(F.lit(0))))
    return held.withWatermark("event_time", late)


class InOrder(StatefulProcessor):
    """Per key: rows wait until the watermark has passed them (`hold` ms longer, where a rule looks ahead), then are stepped in order.

    Subclasses name ROW (its first field is `at`), and have `open`, `step` and `idle`.
    """

    ROW: str
    hold = 0

    def __init__(self, keep_ms: int = KEEP_MS):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)
        self.names = [f.split()[0] for f in self.ROW.split(", ")]
        self.open()

    def open(self) -> None:
        """Further state."""

    def step(self, key: tuple, due: list[tuple], passed: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def idle(self, key: tuple, passed: int) -> Iterator[pd.DataFrame]:
        """Nothing came for the time to live: state goes."""
        yield from ()

    def alarm_at(self, left: list[tuple], passed: int) -> int:
        return min(r[0] for r in left) + self.hold + 1 if left else passed + self.keep_ms

    def _alarm(self, at_ms: int) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = [tuple(map(_plain, r)) for part in rows for r in part[self.names].itertuples(index=False, name=None)]
        self.waiting.appendList(new)
        self._alarm(self.alarm_at(list(self.waiting.get()), timers.getCurrentWatermarkInMs()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        if not rows:
            yield from self.idle(key, passed)
            return
        due = sorted((r for r in rows if r[0] + self.hold < passed), key=lambda r: r[1:4])
        left = [r for r in rows if r[0] + self.hold >= passed]
        yield from self.step(key, due, passed)
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        self._alarm(self.alarm_at(left, passed))

    def close(self) -> None:
        pass


class _EpisodeState(InOrder):
    """Keyed map state: per identity key its episode, what it met, what it carried, and when it was last seen."""

    ROW = "at long, frame long, ts double, seq int, keys array<string>, releases array<string>, payload string"

    def open(self) -> None:
        self.held = self.handle.getMapState("episodes", "key string", "episode long, met array<string>, carried array<string>, last long")

    def _loaded(self, names: set[str]) -> tuple[Episodes, dict[str, tuple]]:
        """The rules' state for these keys and all that they have met, however indirectly; a release reaches no others."""
        had, queue = {}, list(names)
        while queue:
            k = queue.pop()
            if k not in had:
                had[k] = tuple(self.held.getValue((k,))) if self.held.containsKey((k,)) else None
                queue += [*had[k][1], *had[k][2]] if had[k] else []
        state = Episodes()
        for k, v in had.items():
            if v:
                name = tuple(k.split("=", 1))
                if v[0]:
                    state.episode[name] = v[0]
                for where, others in ((state.met, v[1]), (state.carried, v[2])):
                    if others:
                        where[name] = {tuple(o.split("=", 1)) for o in others}
        return state, had

    def step(self, key, due, passed):
        if not due:
            return
        touched = {k for r in due for k in (*r[4], *r[5])}
        state, had = self._loaded(touched)
        split = lambda ks: [tuple(k.split("=", 1)) for k in ks]
        out = [["=".join(k) for k in state.step(split(r[4]), split(r[5]))] for r in due]
        newest = max(r[0] for r in due)
        for k in had:
            name = tuple(k.split("=", 1))
            now = (state.episode.get(name, 0), sorted("=".join(o) for o in state.met.get(name, ())), sorted("=".join(o) for o in state.carried.get(name, ())))
            if any(now):
                self.held.updateValue((k,), (*now, newest))
            elif had[k]:
                self.held.removeKey((k,))
        for k, v in list(self.held.iterator()):
            if v[3] + self.keep_ms < passed:
                self.held.removeKey(tuple(k))
        yield pd.DataFrame({"keys": out, "payload": [r[6] for r in due]})

    def idle(self, key, passed):
        self.held.clear()
        yield from ()


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def episodes_stream(messages: DataFrame, by: tuple[str, ...] = ("capture_id",), late: str = "1 minute", keep_ms: int = KEEP_MS) -> DataFrame:
    """messages with reusable keys rewritten per episode, as `assign_episodes` does, each once the watermark has passed it.

    Keys that meet must be in one group of `by`: the capture, or something finer
    that keys don't cross. Solitary kinds count their own releases. A key that
    isn't seen for the time to live starts again at its first episode.
    """
    held = timed(messages, late)
    texts = lambda c: F.coalesce(F.transform(c, lambda k: F.concat_ws("=", k["kind"], k["value"])), F.array().cast("array<string>"))
    rows = held.select(*by, _millis(), "frame", "ts", "seq", texts("keys").alias("keys"), texts("releases").alias("releases"), F.to_json(F.struct(*[c for c in messages.columns if c != "keys"]), _JSON).alias("payload"))
    got = rows.groupBy(*by).transformWithStateInPandas(_EpisodeState(keep_ms), "keys array<string>, payload string", "append", "eventTime")
    kind = messages.schema["keys"].dataType
    rest = messages.drop("keys").schema
    # `event_time` comes back as it was; a watermark on it would have to be set anew.
    out = got.withColumn("m", F.from_json("payload", rest, {"timestampFormat": _JSON["timestampFormat"]}))
    pair = F.transform("keys", lambda k: F.struct(F.substring_index(k, "=", 1).alias("kind"), F.regexp_replace(k, "^[^=]*=", "").alias("value")))
    return out.select(*(F.col(f"m.{c}") if c != "keys" else pair.cast(kind).alias("keys") for c in messages.columns))


class _Quotes(InOrder):
    """Quotes wait until nothing within the lead can come any more; of the sightings only those that a quote may still mean stay."""

    ROW = "at long, frame long, ts double, looks string, releases boolean, quote boolean"

    def __init__(self, max_age: float, max_lead: float, keep_ms: int):
        super().__init__(keep_ms)
        self.max_age, self.max_lead = max_age, max_lead
        self.hold = int(max_lead * 1000) + 1

    def open(self) -> None:
        self.seen = self.handle.getListState("seen", "frame long, ts double, releases boolean, at long")

    def alarm_at(self, left, passed):
        quotes = [r for r in left if r[5]]
        return min(r[0] for r in quotes) + self.hold + 1 if quotes else max([passed, *(r[0] for r in left)]) + self.keep_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        quotes = [r for r in rows if r[5]]
        sightings = sorted({tuple(r) for r in self.seen.get()} | {(r[1], r[2], bool(r[4]), r[0]) for r in rows if not r[5]})
        due = sorted((r for r in quotes if r[0] + self.hold < passed), key=lambda r: r[1:4])
        out = []
        for _, frame, ts, looks, _, _ in due:
            before = max((s[:3] for s in sightings if s[0] < frame), default=None)
            after = min((s[:3] for s in sightings if s[0] > frame), default=None)
            forwarded, bound = looks == "forwarded", None
            if before and not before[2] and (forwarded or ts - before[1] <= self.max_age):
                bound = before[0]
            elif forwarded and after and after[1] - ts <= self.max_lead:
                bound = after[0]
            out.append((*key, frame, looks, bound))
        left = [r for r in quotes if r[0] + self.hold >= passed]
        first = min((r[1] for r in left), default=None)
        old = [s for s in sightings if s[3] < passed and (first is None or s[0] < first)]
        keep = [s for s in sightings if s[3] >= passed or (first is not None and s[0] >= first)] + old[-1:]
        self.waiting.clear()
        self.seen.clear()
        if left:
            self.waiting.put(left)
        if keep and (left or max(s[3] for s in keep) + self.keep_ms > passed):
            self.seen.put(keep)
            self._alarm(self.alarm_at(left + [(s[3], s[0], s[1], None, s[2], False) for s in keep], passed) if left else max(s[3] for s in keep) + self.keep_ms)
        elif left:
            self._alarm(self.alarm_at(left, passed))
        if out:
            made = pd.DataFrame(out, columns=["capture_id", "kind", "value", "frame", "looks", "bound_frame"])
            yield made.astype({"bound_frame": "Int64"})


def quotes_stream(rows: DataFrame, max_age: float = QUOTE_AGE, max_lead: float = FORWARD_LEAD, late: str = "1 minute", keep_ms: int = KEEP_MS) -> DataFrame:
    """bound_frame per quote, as `bind_quotes` finds it: a two-sided as-of match on a stream.

    rows: capture_id, kind, value, frame, ts, event_time, looks, releases, quote
    (false: a sighting). A sighting is kept for a forwarded quote, however late
    that is, until the time to live has gone since.
    """
    held = timed(rows, late).select("capture_id", "kind", "value", _millis(), "frame", "ts", "looks", F.coalesce("releases", F.lit(False)).alias("releases"), "quote")
    return held.groupBy("capture_id", "kind", "value").transformWithStateInPandas(_Quotes(max_age, max_lead, keep_ms), "capture_id string, kind string, value string, frame long, looks string, bound_frame long", "append", "eventTime")


def quote_rows(messages: DataFrame) -> DataFrame:
    """What `quotes_stream` takes, from messages: their quotes, and their keys as sightings."""
    base = ["capture_id", "frame", "ts", "event_time"]
    quotes = messages.select(*base, F.explode("quotes").alias("q")).select("capture_id", "q.kind", "q.value", "frame", "ts", "event_time", "q.looks", F.lit(None).cast("boolean").alias("releases"), F.lit(True).alias("quote"))
    seen = messages.select(*base, "releases", F.explode("keys").alias("k"))
    freed = F.exists("releases", lambda r: (r["kind"] == F.col("k.kind")) & (r["value"] == F.col("k.value")))
    return quotes.unionByName(seen.select("capture_id", "k.kind", "k.value", "frame", "ts", "event_time", F.lit(None).cast("string").alias("looks"), freed.alias("releases"), F.lit(False).alias("quote")))


class _Timers(InOrder):
    """The message before, and the alarm of the timer that it started."""

    ROW = "at long, ts double, frame long, seq int, protocol string, label string, ended boolean"
    SEEN = "at long, ts double, frame long, seq int, protocol string, label string, told boolean"

    def __init__(self, timers, tolerance: float, keep_ms: int):
        super().__init__(keep_ms)
        self.timers, self.tolerance = timers, tolerance

    def open(self) -> None:
        self.before = self.handle.getValueState("before", self.SEEN)

    def _started(self, before: tuple) -> list[tuple[str, float]]:
        return [(name, seconds) for name, seconds, protocol, labels in self.timers if before[4] == protocol and any(x in (before[5] or "") for x in labels)]

    def _due(self, before: tuple | None, left: list[tuple], passed: int) -> int:
        """When the next thing can be said: about a waiting row, the timer that runs, or the end of the time to live."""
        times = [r[0] + 1 for r in left]
        if before and not before[6]:
            times += [before[0] + int(s * (1 + self.tolerance) * 1000) + 1 for _, s in self._started(before)]
        return min(times, default=passed + self.keep_ms)

    def alarm_at(self, left, passed):
        return self._due(tuple(self.before.get()) if self.before.exists() else None, left, passed)

    def _expired(self, key: tuple, before: tuple | None, passed: int) -> tuple | None:
        """The first timer of a message that nothing has followed though the watermark is past its longest wait."""
        if before and not before[6]:
            for name, s in self._started(before):
                if before[0] + int(s * (1 + self.tolerance) * 1000) < passed:
                    return (*key, before[2], None, None, name, "expired")
        return None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        before = tuple(self.before.get()) if self.before.exists() else None
        if not rows and before and passed >= before[0] + self.keep_ms:
            self.before.clear()
            return
        out = []
        for at, ts, frame, seq, protocol, label, ended in sorted((r for r in rows if r[0] < passed), key=lambda r: r[1:4]):
            if before and ended:
                gap = round(ts - before[1], 6)
                name = next((n for n, s in self._started(before) if s * (1 - self.tolerance) <= gap <= s * (1 + self.tolerance)), None)
                if name:
                    out.append((*key, before[2], frame, gap, name, "ended"))
            before = (at, ts, frame, seq, protocol, label, False)
        left = [r for r in rows if r[0] >= passed]
        # A row that waits follows already: the timer that ran is cancelled.
        if not left and (gone := self._expired(key, before, passed)):
            out.append(gone)
            before = (*before[:6], True)
        if before:
            self.before.update(before)
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        self._alarm(max(self._due(before, left, passed), passed + 1))
        if out:
            made = pd.DataFrame(out, columns=["capture_id", "flow_id", "prev_frame", "frame", "gap", "timer", "state"])
            yield made.astype({"frame": "Int64", "gap": "Float64"})


def timers_stream(messages: DataFrame, timers=TIMERS, tolerance: float = TOLERANCE, late: str = "1 minute", keep_ms: int = KEEP_MS) -> DataFrame:
    """capture_id, flow_id, prev_frame, frame, gap, timer, state: timers that ran as flows came in.

    "ended": a failure or release came after the timer's time, the rows of
    `timer_hints`. "expired": the watermark has passed the timer's time and nothing
    came for the flow at all; the flow's next message cancels the timer.
    """
    ended = F.col("is_failure") | F.coalesce(detail("release-initiator").isNotNull(), F.lit(False))
    held = timed(messages.where("flow_id is not null"), late).select("capture_id", "flow_id", _millis(), "ts", "frame", "seq", "protocol", "label", ended.alias("ended"))
    return held.groupBy("capture_id", "flow_id").transformWithStateInPandas(_Timers(timers, tolerance, keep_ms), "capture_id string, flow_id string, prev_frame long, frame long, gap double, timer string, state string", "append", "eventTime")


class _Late(StatefulProcessor):
    """Rows with whether they are behind the watermark that held when they came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs()
        for part in rows:
            yield pd.DataFrame({"payload": part["payload"], "late": part["at"].lt(passed) & part["clocked"]})

    def close(self) -> None:
        pass


def marked_late(stream: DataFrame, behind: str = "1 minute", parts: int = 64) -> DataFrame:
    """The stream with `late`: whether a row was behind the query's own watermark when it came. Rows without an event time are in time.

    Rows are dealt by their content, so a hot capture is many groups; nothing is kept.
    """
    held = timed(stream.withColumn("__clocked", F.col("event_time").isNotNull()).withColumn("__payload", F.to_json(F.struct(*stream.columns), _JSON)), behind)
    rows = held.select(_millis(), F.col("__clocked").alias("clocked"), F.col("__payload").alias("payload"), F.pmod(F.xxhash64("__payload"), F.lit(parts)).alias("part"))
    got = rows.groupBy("part").transformWithStateInPandas(_Late(), "payload string, late boolean", "append", "eventTime")
    return got.withColumn("m", F.from_json("payload", stream.schema, {"timestampFormat": _JSON["timestampFormat"]})).select("m.*", "late")


def late_counts(rows: DataFrame) -> DataFrame:
    """Rows behind the watermark as a kind of blind spot: capture_id, kind, n."""
    return rows.where("late").groupBy("capture_id").agg(F.count("*").alias("n")).select("capture_id", F.lit("late").alias("kind"), "n")
