"""Aggregations over messages: causes, blast radius, identities, sessions, subscribers, elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.schema import EXCHANGE, SUBSCRIBER

#: Rows up to which a dimension is broadcast; larger ones are joined by shuffle.
SMALL = 100_000


def dimension(dim: DataFrame) -> DataFrame:
    """dim with a broadcast hint where its counted size allows it."""
    return F.broadcast(dim) if dim.limit(SMALL + 1).count() <= SMALL else dim


def supis(keys: str = "keys") -> Column:
    return F.transform(F.filter(keys, lambda k: k["kind"] == "supi"), lambda k: k["value"])


def with_causes(messages: DataFrame, causes: DataFrame) -> DataFrame:
    """Adds cause_name and outcome; unknown causes are "not catalogued"; outcome "user" is no failure."""
    dim = dimension(causes.select(F.col("table").alias("c_table"), F.col("value").alias("c_value"), F.col("name").alias("c_name"), "outcome"))
    joined = messages.join(dim, (F.col("cause.table") == F.col("c_table")) & (F.col("cause.value") == F.col("c_value")), "left")
    name = F.when(F.col("cause").isNotNull(), F.coalesce("c_name", F.lit("not catalogued")))
    return joined.withColumn("cause_name", name).withColumn("is_failure", F.col("is_failure") & ~F.coalesce(F.col("outcome") == "user", F.lit(False))).drop("c_table", "c_value", "c_name")


def failures(explained: DataFrame) -> DataFrame:
    """Failure rows with their cause; sinks order them by frame, protocol, label."""
    return explained.where("is_failure").select("capture_id", "frame", "seq", "protocol", "label", F.col("cause.table").alias("cause_table"), F.col("cause.value").alias("cause_value"), "cause_name")


def cause_rollup(explained: DataFrame, approximate: bool = False) -> DataFrame:
    """Per capture and cause: failures, first frame, subscribers. Frames stay rows (see failures), not arrays."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    # A message counts at its first subscriber, so that one distinct count is left.
    held = explained.where("is_failure").select("capture_id", "cause_name", "frame", F.posexplode_outer(supis()).alias("pos", "supi"))
    return held.groupBy("capture_id", "cause_name").agg(F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("n"), F.min("frame").alias("first_frame"), distinct("supi").alias("subscribers"))


def blast_radius(messages: DataFrame, dimensions: dict[str, Column], approximate: bool = False) -> DataFrame:
    """Per dimension and value (unknown: null): failures and distinct subscribers. Each dimension sums to all failures."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    failed = messages.where("is_failure").select("capture_id", F.get(supis(), F.lit(0)).alias("supi"), *(c.cast("string").alias(n) for n, c in dimensions.items()))
    long = failed.select("capture_id", "supi", F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in dimensions))).alias("d"))
    return long.select("capture_id", "supi", "d.*").groupBy("capture_id", "dimension", "value").agg(F.count("*").alias("failures"), distinct("supi").alias("subscribers"))


def identities(messages: DataFrame) -> DataFrame:
    """Per key of a flow: messages, flows and failures of all flows that hold it, SUPIs that share one of them, and its scope."""
    rows = messages.where("flow_id is not null")
    totals = rows.groupBy("capture_id", "flow_id").agg(F.count("*").alias("messages"), F.count_if("is_failure").alias("failures"))
    keys = rows.select("capture_id", "flow_id", F.explode("keys").alias("k")).select("capture_id", "flow_id", "k.kind", "k.value").distinct()
    counts = keys.join(totals, ["capture_id", "flow_id"]).groupBy("capture_id", "kind", "value").agg(F.sum("messages").alias("messages"), F.count("*").alias("flows"), F.sum("failures").alias("failures"))
    # A flow has few SUPIs, but a key may be in many flows: distinct pairs, then counts.
    people = keys.where("kind = 'supi'").select("capture_id", "flow_id", F.col("value").alias("supi"))
    shared = keys.join(people, ["capture_id", "flow_id"]).groupBy("capture_id", "kind", "value").agg(F.count_distinct("supi").alias("supis"))
    scope = F.when(F.col("value").contains("/"), F.substring_index("value", "/", 1))
    return counts.join(shared, ["capture_id", "kind", "value"], "left").fillna(0, ["supis"]).withColumn("scope", scope)


def frame_owners(messages: DataFrame) -> DataFrame:
    """A row per frame and key."""
    return messages.select("capture_id", "frame", F.explode("keys").alias("k")).select("capture_id", "frame", "k.kind", "k.value").distinct()


def availability(messages: DataFrame) -> DataFrame:
    """Per kind of key: distinct values and messages."""
    keys = messages.select("capture_id", "frame", "seq", F.explode("keys").alias("k"))
    return keys.groupBy("capture_id", F.col("k.kind").alias("kind")).agg(F.count_distinct("k.value").alias("values"), F.count_distinct("frame", "seq").alias("messages"))


def light(failures_: Column, retransmissions: Column, unanswered: Column) -> Column:
    """red, amber or green."""
    return F.when(failures_ > 0, "red").when((retransmissions > 0) | (unanswered > 0), "amber").otherwise("green")


LIGHT_RANK = {"red": 0, "amber": 1, "green": 2}


def sessions(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Per flow: span, protocols, counts and light. events: capture_id, flow_id, kind."""
    spans = messages.groupBy("capture_id", "flow_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.round(F.max("ts") - F.min("ts"), 6).alias("duration"), F.count("*").alias("messages"), F.array_sort(F.collect_set("protocol")).alias("protocols"))
    counts = events.groupBy("capture_id", "flow_id").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("failure", "failures"), ("retransmission", "retransmissions"), ("unanswered", "unanswered"))))
    joined = spans.join(counts, ["capture_id", "flow_id"], "left").fillna(0, ["failures", "retransmissions", "unanswered"])
    return joined.withColumn("light", light(F.col("failures"), F.col("retransmissions"), F.col("unanswered")))


def subscribers(sessions_: DataFrame, groups: DataFrame) -> DataFrame:
    """Per subscriber group: its sessions, messages and worst light; flows of no group share one orphan row."""
    joined = sessions_.join(groups, ["capture_id", "flow_id"], "left")
    rank = F.try_element_at(F.create_map(*(F.lit(x) for kv in LIGHT_RANK.items() for x in kv)), F.col("light"))
    names = F.create_map(*(F.lit(x) for kv in LIGHT_RANK.items() for x in kv[::-1]))
    rolled = joined.groupBy("capture_id", "subscriber").agg(F.count("*").alias("sessions"), F.sum("messages").alias("messages"), F.sum("failures").alias("failures"), F.min("start").alias("start"), F.max("end").alias("end"), F.min(rank).alias("worst"))
    return rolled.withColumn("light", names[F.col("worst")]).drop("worst")


def network_elements(messages: DataFrame) -> DataFrame:
    """Per address: messages (once per end), ports, roles seen."""
    ends = messages.select("capture_id", F.explode(F.array("src", "dst")).alias("e"))
    return ends.groupBy("capture_id", F.coalesce("e.ip", "e.host").alias("address")).agg(F.count("*").alias("messages"), F.count_distinct("e.port").alias("ports"), F.array_sort(F.collect_set("e.role")).alias("roles"))


def capture_facts(messages: DataFrame) -> DataFrame:
    """Per capture: decoded frames, span, start, protocols."""
    return messages.groupBy("capture_id").agg(F.count_distinct("frame").alias("frames"), F.round(F.max("ts") - F.min("ts"), 6).alias("span"), F.min("event_time").alias("started_at"), F.array_sort(F.collect_set("protocol")).alias("protocols"))


def cause_cards(observed: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Per cause, else protocol and label: deduplicated failures, all frames, peers, and its place in its capture, most first."""
    card = F.coalesce("cause_name", F.concat_ws(" ", "protocol", "label"))
    once = observed.where("is_failure").groupBy("capture_id", card.alias("card")).agg(F.count_distinct("frame").alias("n"))
    every = all_rows.where("is_failure").groupBy("capture_id", card.alias("card")).agg(F.count_distinct("frame").alias("frames"), F.min("frame").alias("first_frame"), F.count_distinct(F.array_sort(F.array("src.ip", "dst.ip"))).alias("peers"))
    place = F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("n"), "first_frame", "card"))
    return once.join(every, ["capture_id", "card"]).withColumn("place", place)


def scenario_breakdown(procedures: DataFrame) -> DataFrame:
    """Per kind: outcomes, top cause, a sample frame (a failure's first), and its place, worst first."""
    rows = procedures.groupBy("capture_id", "kind").agg(
        *(F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "failure", "incomplete")),
        F.count("*").alias("total"),
        F.min(F.struct(F.when(F.col("outcome") == "failure", 0).otherwise(1).alias("r"), F.col("start_frame").alias("f")))["f"].alias("sample_frame"),
    )
    causes = procedures.where("cause is not null").groupBy("capture_id", "kind", "cause").count()
    top = causes.groupBy("capture_id", "kind").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("cause").alias("c")))["c"].alias("top_cause"))
    place = F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("failure"), F.desc("incomplete"), F.desc("total"), "kind"))
    return rows.join(top, ["capture_id", "kind"], "left").withColumn("place", place)


def subscriber_titles(messages: DataFrame) -> DataFrame:
    """Subscriber keys per flow, and whether any is a SUPI."""
    keys = messages.select("capture_id", "flow_id", F.explode("keys").alias("k")).where(F.col("k.kind").isin(*SUBSCRIBER)).select("capture_id", "flow_id", "k.kind", "k.value").distinct()
    return keys.groupBy("capture_id", "flow_id").agg(F.count("*").alias("keys"), F.count_if(F.col("kind") == "supi").alias("supis"))


def exchange_only(keys: Column) -> Column:
    """No key that makes a flow of its own."""
    return ~F.exists(keys, lambda k: ~k["kind"].isin(*EXCHANGE))


def first_row(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
