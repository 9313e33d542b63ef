"""Window and sequence analytics over messages of a flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.scalars import is_nas
from callweave.operators.rollups import dimension
from callweave.schema import IN_TIME

SLOW_GAP, TAIL_SLACK, NAS_WINDOW, TOLERANCE = 1.0, 2.0, 30.0, 0.15
FLOW = ("capture_id", "flow_id")

# Network-side timers that wait for an answer: name, seconds, generation, labels that start it.
TIMERS = (
    ("T3550", 6.0, "nas-5gs", ("Registration accept",)),
    ("T3560", 6.0, "nas-5gs", ("Authentication request", "Security mode command")),
    ("T3570", 6.0, "nas-5gs", ("Identity request",)),
    ("T3555", 6.0, "nas-5gs", ("Configuration update command",)),
    ("T3522", 6.0, "nas-5gs", ("Deregistration request (UE terminated)",)),
    ("T3450", 6.0, "nas-eps", ("Attach accept", "Tracking area update accept")),
    ("T3460", 6.0, "nas-eps", ("Authentication request", "Security mode command")),
    ("T3470", 6.0, "nas-eps", ("Identity request",)),
    ("T3422", 6.0, "nas-eps", ("Detach request",)),
)


def alone() -> Column:
    """Rows without a flow are dealt by themselves: the null flow is never one partition, and nothing is next to its rows."""
    return F.when(F.col("flow_id").isNull(), F.struct("frame", "seq"))


def in_flow(*more: str):
    return Window.partitionBy(*FLOW, alone(), *more).orderBy(*IN_TIME)


def detail(name: str) -> Column:
    return F.try_element_at("detail", F.lit(name))


def deltas(messages: DataFrame, slow: float = SLOW_GAP) -> DataFrame:
    """delta to the previous message of the flow, and slow; the absolute clock where both have one."""
    epoch = F.unix_micros("event_time") / 1e6
    gap = F.coalesce(epoch - F.lag(epoch).over(in_flow()), F.col("ts") - F.lag("ts").over(in_flow()))
    return messages.withColumn("delta", F.round(gap, 6)).withColumn("slow", F.coalesce(F.col("delta") > slow, F.lit(False)))


def distinct_observed(messages: DataFrame) -> DataFrame:
    """Relay copies once: the first of (end-to-end id, label, cause) in a flow; rows without the id all stay."""
    id_ = detail("end-to-end-id")
    # Rows without an id get a group each, so they never meet in one task.
    own = F.when(id_.isNull(), F.concat_ws("-", "frame", "seq"))
    nth = F.row_number().over(Window.partitionBy(*FLOW, id_, "label", "cause", own).orderBy("frame", "ts", "seq"))
    return messages.withColumn("__n", nth).where("__n = 1").drop("__n")


def timer_hints(messages: DataFrame, timers=TIMERS, tolerance: float = TOLERANCE) -> DataFrame:
    """Gaps between adjacent messages that are as long as a timer the earlier one starts, ended by a failure or release."""
    w = in_flow()
    rows = messages.select(*FLOW, *IN_TIME, "protocol", "label", "is_failure", F.coalesce(detail("release-initiator").isNotNull(), F.lit(False)).alias("released"))
    rows = rows.withColumns({"prev_label": F.lag("label").over(w), "prev_protocol": F.lag("protocol").over(w), "prev_frame": F.lag("frame").over(w), "gap": F.round(F.col("ts") - F.lag("ts").over(w), 6)})
    matched = F.coalesce(*(F.when((F.col("prev_protocol") == g) & F.col("gap").between(s * (1 - tolerance), s * (1 + tolerance)) & F.exists(F.array(*map(F.lit, labels)), lambda x: F.col("prev_label").contains(x)), F.lit(n)) for n, s, g, labels in timers))
    return rows.where("is_failure or released").withColumn("timer", matched).where("timer is not null").select(*FLOW, "prev_frame", "frame", "gap", "timer")


def runs(rows: DataFrame, by: list[str], gap: float, least: int = 2) -> DataFrame:
    """Islands: rows alike in `by` whose gap to the one before is at most `gap` seconds; runs of at least `least`."""
    w = Window.partitionBy(*by, *([alone()] if "flow_id" in by else [])).orderBy(*IN_TIME)
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= gap, 0).otherwise(1)
    held = rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return held.groupBy(*by, "run").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.round(F.max("ts") - F.min("ts"), 6).alias("span")).where(F.col("n") >= least)


def nas_retransmissions(messages: DataFrame, window: float = NAS_WINDOW) -> DataFrame:
    """Suspected: NAS messages of one direction, label and key set, chained by gaps of at most 30 s."""
    rows = messages.where(is_nas(F.col("protocol"), F.col("detail"))).withColumns({"src_ip": F.col("src.ip"), "dst_ip": F.col("dst.ip"), "key_set": F.to_json(F.array_sort(F.array_distinct("keys")))})
    return runs(rows, [*FLOW, "src_ip", "dst_ip", "label", "key_set"], window)


def confirmed_retransmissions(messages: DataFrame, protocol: str, id_: str) -> DataFrame:
    """Same direction, label and identifier twice or more (PFCP: seqno; Diameter: end-to-end-id)."""
    rows = messages.where(F.col("protocol") == protocol).withColumns({"src_ip": F.col("src.ip"), "dst_ip": F.col("dst.ip"), "id": detail(id_)})
    label = ["label"] if protocol == "pfcp" else []
    flagged = F.max(F.coalesce(F.lower(detail("retransmitted")).isin("true", "1"), F.lit(False))).alias("flagged")
    return rows.where("id is not null").groupBy("capture_id", "src_ip", "dst_ip", *label, "id").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.min("flow_id").alias("flow_id"), flagged).where("n > 1")


def tail_note(messages: DataFrame, slack: float = TAIL_SLACK) -> DataFrame:
    """near_end: within 2 s of the capture's end."""
    ends = messages.groupBy("capture_id").agg(F.max("ts").alias("__end"))
    return messages.join(ends, "capture_id").withColumn("near_end", F.col("__end") - F.col("ts") <= slack).drop("__end")


def radio_connections(messages: DataFrame, start: Column, release: Column) -> DataFrame:
    """Intervals from each starting message to the first release before the next start, else the last message before it."""
    w = in_flow()
    held = messages.withColumns({"__s": start.cast("int"), "__r": release}).withColumn("connection", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("connection > 0")
    spans = held.groupBy(*FLOW, "connection").agg(
        F.min("frame").alias("start_frame"), F.min("ts").alias("start"), F.min(F.when(F.col("__r"), F.struct(*IN_TIME))).alias("r"), F.max(F.struct(*IN_TIME)).alias("l"), F.count("*").alias("messages")
    )
    end = F.coalesce("r", "l")
    return spans.select(*FLOW, "connection", "start_frame", "start", end["frame"].alias("end_frame"), end["ts"].alias("end"), F.round(end["ts"] - F.col("start"), 6).alias("duration"), "messages")


SEVERITY = {"failure": 0, "incomplete": 1, "success": 2}


def connection_summary(members: DataFrame) -> DataFrame:
    """Per connection: first intent, worst outcome, first failure's cause. members: rows with outcome, kind, cause."""
    rank = F.try_element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("outcome"))
    names = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv[::-1]))
    held = members.groupBy(*FLOW, "connection").agg(F.min_by("kind", "start_frame").alias("intent"), F.min(rank).alias("w"), F.min(F.when(F.col("cause").isNotNull(), F.struct("start_frame", "cause")))["cause"].alias("cause"), F.round(F.max("end") - F.min("start"), 6).alias("duration"))
    return held.withColumn("outcome", names[F.col("w")]).drop("w")


def collapse_frames(messages: DataFrame) -> DataFrame:
    """One row per frame, source and destination of a flow: labels joined, failure of any, the failing row's cause, later details win."""
    rows = messages.groupBy(*FLOW, "frame", F.col("src.ip").alias("src_ip"), F.col("dst.ip").alias("dst_ip")).agg(
        F.min("ts").alias("ts"),
        F.array_sort(F.collect_list(F.struct("ts", "seq", "label", "protocol", F.map_entries("detail").alias("entries")))).alias("rows"),
        F.max("is_failure").alias("is_failure"),
        F.min(F.when(F.col("is_failure"), F.struct("ts", "seq", "cause")))["cause"].alias("cause"),
    )
    entries = F.flatten("rows.entries")
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]))
    return rows.select(*FLOW, "frame", "src_ip", "dst_ip", "ts", F.array_join("rows.label", " + ").alias("label"), F.array_join(F.array_distinct("rows.protocol"), ",").alias("protocols"), "is_failure", "cause", last.alias("detail"))


def match_sequences(failures: DataFrame, rules: DataFrame, segment: list[str]) -> DataFrame:
    """Segments whose consecutive failures' cause values hold a declared sequence; the longest rule, then the least. rules: table, values, says.

    All failures of the segment must be of one table and have a value. Each failure sees
    as many following ones as the longest rule has, and meets the rules that begin with
    its value, so no segment is gathered whole and none meets every rule.
    """
    longest = rules.agg(F.max(F.size("values"))).first()[0] or 1
    rows = failures.select(*segment, *IN_TIME, F.col("cause.table").alias("table"), F.col("cause.value").alias("value"))
    whole = Window.partitionBy(*segment)
    seen = F.collect_list("value").over(whole.orderBy(*IN_TIME).rowsBetween(0, longest - 1))
    # A null value is no list entry, so the segment is left out before its lists are compared.
    alike = (F.min("table").over(whole) == F.max("table").over(whole)) & (F.count("table").over(whole) == F.count(F.lit(1)).over(whole)) & (F.count("value").over(whole) == F.count(F.lit(1)).over(whole))
    marked = rows.withColumns({"__seen": seen, "__alike": alike}).where("__alike")
    dim = dimension(rules.select("table", F.get("values", F.lit(0)).alias("value"), "values", "says"))
    hits = marked.join(dim, ["table", "value"]).where(F.slice("__seen", F.lit(1), F.size("values")) == F.col("values"))
    best = F.min(F.struct((-F.size("values")).alias("n"), "says", "values", "table")).alias("b")
    return hits.groupBy(*segment).agg(best).select(*segment, "b.table", "b.values", "b.says")


def truncate_ladder(messages: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows of each flow, with how many there are."""
    w = Window.partitionBy(*FLOW, alone())
    return messages.withColumns({"shown": F.row_number().over(in_flow()), "total": F.count("*").over(w)}).where(F.col("shown") <= limit)


def causal_chain(members: DataFrame, segment: list[str], radio_role: str = "ran") -> DataFrame:
    """For failed segments: origin, nearest earlier other core sender, first and last failure, in order."""
    rows = members.groupBy(*segment).agg(
        F.min(F.struct(*IN_TIME, F.col("src.ip").alias("ip"), "label")).alias("origin"),
        F.min(F.when(F.col("is_failure"), F.struct(*IN_TIME, F.col("src.ip").alias("ip"), "label"))).alias("first"),
        F.max(F.when(F.col("is_failure"), F.struct(*IN_TIME, F.col("src.ip").alias("ip"), "label"))).alias("last"),
    ).where("first is not null")
    others = members.join(rows.select(*segment, F.col("first").alias("f")), segment).where((F.coalesce(F.col("src.role"), F.lit("")) != radio_role) & (F.col("src.ip") != F.col("f.ip")) & (F.struct(*IN_TIME) < F.struct("f.ts", "f.frame", "f.seq")))
    near = others.groupBy(*segment).agg(F.max(F.struct(*IN_TIME, F.col("src.ip").alias("ip"), "label")).alias("sender"))
    return rows.join(near, segment, "left").select(*segment, F.array_compact(F.array(F.struct(F.lit("origin").alias("step"), "origin.*"), F.when(F.col("sender").isNotNull(), F.struct(F.lit("sender").alias("step"), "sender.*")), F.struct(F.lit("first failure").alias("step"), "first.*"), F.struct(F.lit("last failure").alias("step"), "last.*"))).alias("chain"))


def status_events(messages: DataFrame, retransmitted: DataFrame, unanswered: DataFrame) -> DataFrame:
    """capture_id, flow_id, frame, kind: failures, retransmissions and unanswered requests, owned by their first frame's flow."""
    failed = messages.where("is_failure").select(*FLOW, "frame", F.lit("failure").alias("kind"))
    again = retransmitted.select(*FLOW, F.col("first_frame").alias("frame"), F.lit("retransmission").alias("kind"))
    open_ = unanswered.select(*FLOW, "frame", F.lit("unanswered").alias("kind"))
    return failed.unionByName(again).unionByName(open_)
