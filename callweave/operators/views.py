"""What a reader asks for first: overview, subscribers, the ladder of a handle, parties of a call, set conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.scalars import access_kind, domain_of, international_msisdn, msisdn_of
from callweave.operators.coverage import search, select_identity
from callweave.operators.links import with_owner
from callweave.operators.pairing import reference_points
from callweave.operators.rollups import LIGHT_RANK, light
from callweave.operators.sequences import deltas, detail
from callweave.schema import SUBSCRIBER

N2_ONLY = ("ngap", "nas-5gs")


def overview(captures: DataFrame, sessions: DataFrame, subscribers: DataFrame, procedures: DataFrame) -> DataFrame:
    """Per capture: verdict, subscribers by light, outcomes of procedures, totals of sessions.

    The verdict is the worst light of the grouped subscribers, without any that of
    the totals, and "empty" only where no message was read at all.
    captures: capture_id; subscribers: rows of rollups.subscribers.
    """
    rank = F.try_element_at(F.create_map(*(F.lit(x) for kv in LIGHT_RANK.items() for x in kv)), F.col("light"))
    names = F.create_map(*(F.lit(x) for kv in LIGHT_RANK.items() for x in kv[::-1]))
    people = subscribers.where("subscriber is not null").groupBy("capture_id").agg(*(F.count_if(F.col("light") == x).alias(x) for x in LIGHT_RANK), F.min(rank).alias("worst"))
    counts = ("messages", "failures", "retransmissions", "unanswered")
    totals = sessions.groupBy("capture_id").agg(F.count("*").alias("sessions"), *(F.sum(c).alias(c) for c in counts))
    outcomes = procedures.groupBy("capture_id").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "failure", "incomplete", "cancelled")))
    held = captures.select("capture_id").distinct()
    for part in (people, totals, outcomes):
        held = held.join(part, "capture_id", "left")
    numbers = [*LIGHT_RANK, "sessions", *counts, "success", "failure", "incomplete", "cancelled"]
    held = held.fillna(0, numbers)
    verdict = F.when(F.col("messages") == 0, "empty").otherwise(F.coalesce(names[F.col("worst")], light(F.col("failures"), F.col("retransmissions"), F.col("unanswered"))))
    return held.select("capture_id", verdict.alias("verdict"), *numbers)


def subscriber_summary(messages: DataFrame) -> DataFrame:
    """Per SUPI: flows that hold it, their messages and failures, other subscriber keys of these flows, PDU sessions."""
    rows = messages.where("flow_id is not null")
    totals = rows.groupBy("capture_id", "flow_id").agg(F.count("*").alias("messages"), F.count_if("is_failure").alias("failures"))
    keys = rows.select("capture_id", "flow_id", F.explode("keys").alias("k")).select("capture_id", "flow_id", "k.kind", "k.value").where(F.col("kind").isin(*SUBSCRIBER)).distinct()
    people = keys.where("kind = 'supi'").select("capture_id", "flow_id", F.col("value").alias("supi"))
    counts = people.join(totals, ["capture_id", "flow_id"]).groupBy("capture_id", "supi").agg(F.count("*").alias("flows"), F.sum("messages").alias("messages"), F.sum("failures").alias("failures"))
    others = people.join(keys, ["capture_id", "flow_id"]).where("kind <> 'supi' or value <> supi").groupBy("capture_id", "supi").agg(F.count_distinct("kind", "value").alias("aliases"))
    sessions = rows.select("capture_id", "flow_id", detail("pdu-session-id").alias("pdu")).where("pdu is not null").distinct()
    pdu = people.join(sessions, ["capture_id", "flow_id"]).groupBy("capture_id", "supi").agg(F.count_distinct("pdu").alias("pdu_sessions"))
    return counts.join(others, ["capture_id", "supi"], "left").join(pdu, ["capture_id", "supi"], "left").fillna(0, ["aliases", "pdu_sessions"])


def unlinked_identities(messages: DataFrame) -> DataFrame:
    """Subscriber keys none of whose flows holds a SUPI: capture_id, kind, value, messages."""
    keys = messages.where("flow_id is not null").select("capture_id", "flow_id", "frame", "seq", F.explode("keys").alias("k")).select("*", "k.kind", "k.value").where(F.col("kind").isin(*SUBSCRIBER))
    known = keys.where("kind = 'supi'").select("capture_id", "flow_id").distinct()
    linked = keys.join(known, ["capture_id", "flow_id"], "left_semi").select("capture_id", "kind", "value").distinct()
    return keys.join(linked, ["capture_id", "kind", "value"], "left_anti").groupBy("capture_id", "kind", "value").agg(F.count_distinct("frame", "seq").alias("messages"))


def ladder(messages: DataFrame, kind: str, value: str, segments: DataFrame, points: DataFrame, level: str = "flow") -> DataFrame:
    """The events of a handle: all messages of flows that hold the key (or of the flow, kind "flow"), with procedure, interface, domain and delta.

    Deltas and owners are those of the selected messages; order by ts, frame, seq.
    """
    chosen = messages.where(F.col("flow_id") == value) if kind == "flow" else select_identity(messages, kind, value, level)
    events = reference_points(with_owner(deltas(chosen), segments), points)
    return events.withColumn("domain", domain_of(F.col("protocol")))


def domains_elsewhere(messages: DataFrame) -> DataFrame:
    """Per flow of a SUPI: domains of the SUPI's other flows that the flow itself lacks."""
    rows = messages.where("flow_id is not null")
    here = rows.groupBy("capture_id", "flow_id").agg(F.collect_set(domain_of(F.col("protocol"))).alias("here"))
    people = rows.select("capture_id", "flow_id", F.explode("keys").alias("k")).where("k.kind = 'supi'").select("capture_id", "flow_id", F.col("k.value").alias("supi")).distinct()
    # Domains are few: a SUPI's set has a bound, its flows have none and stay rows.
    every = people.join(here, ["capture_id", "flow_id"]).groupBy("capture_id", "supi").agg(F.array_distinct(F.flatten(F.collect_set("here"))).alias("all"))
    held = people.join(every, ["capture_id", "supi"]).groupBy("capture_id", "flow_id").agg(F.array_distinct(F.flatten(F.collect_set("all"))).alias("all"))
    return held.join(here, ["capture_id", "flow_id"]).select("capture_id", "flow_id", F.array_sort(F.array_except("all", "here")).alias("elsewhere"))


def only_n2(messages: DataFrame) -> DataFrame:
    """Per capture: whether nothing but N2 and its NAS was read."""
    return messages.groupBy("capture_id").agg(F.every(F.col("protocol").isin(*N2_ONLY)).alias("only_n2"))


def packets_of(packets: DataFrame, messages: DataFrame, q: str | None = None, identity: tuple[str, str] | None = None) -> DataFrame:
    """Packets that meet the text filter and carry the identity; a condition that is not given holds for all, one that hits nothing for none."""
    held = search(packets, q) if q is not None else packets
    if identity is None:
        return held
    frames = select_identity(messages, *identity, "flow").select("capture_id", F.col("frame").alias("number")).distinct()
    return held.join(frames, ["capture_id", "number"], "left_semi")


def call_parties(messages: DataFrame) -> DataFrame:
    """Per call (capture_id, call): caller and callee, their numbers and where these are from, privacy, access of each side.

    messages: SIP rows with the column call. The caller's own claim, asserted by the
    network, goes before the From address; the callee is the Request-URI, else To.
    """
    rows = messages.where("protocol = 'sip' and call is not null")
    place = F.struct("ts", "frame", "seq")
    invite = F.col("label") == "INVITE"
    first = lambda c, when: F.min_by(c, F.when(when & c.isNotNull(), place))
    answer = F.col("label").rlike("^(18[0-9]|2[0-9][0-9])( |$)")
    made = rows.groupBy("capture_id", "call").agg(
        first(detail("P-Asserted-Identity"), invite).alias("asserted"),
        first(detail("From"), invite).alias("from_uri"),
        first(detail("Request-URI"), invite).alias("target"),
        first(detail("To"), invite).alias("to_uri"),
        first(detail("Privacy"), invite).alias("privacy"),
        first(detail("access-type"), invite).alias("caller_access"),
        first(detail("access-type"), answer).alias("callee_access"),
    )
    number = lambda uri: F.coalesce(international_msisdn(uri), msisdn_of(uri))
    source = F.when(number(F.col("asserted")).isNotNull(), "asserted").when(number(F.col("from_uri")).isNotNull(), "from")
    return made.select(
        "capture_id",
        "call",
        F.coalesce("asserted", "from_uri").alias("caller"),
        F.coalesce("target", "to_uri").alias("callee"),
        F.coalesce(number(F.col("asserted")), number(F.col("from_uri"))).alias("caller_number"),
        source.alias("caller_source"),
        F.coalesce(number(F.col("target")), number(F.col("to_uri"))).alias("callee_number"),
        F.when(F.col("privacy") != "none", F.col("privacy")).alias("privacy"),
        access_kind(F.col("caller_access")).alias("caller_access"),
        access_kind(F.col("callee_access")).alias("callee_access"),
    )


def end_to_end(own: DataFrame, media: DataFrame, charged: DataFrame, numbers: DataFrame) -> DataFrame:
    """All messages of a call (capture_id, call, frame, seq), each with how it belongs: the strongest of signalling, media, charging, number."""
    ways = (own, "signalling"), (media, "media"), (charged, "charging"), (numbers, "number")
    every = None
    for n, (rows, way) in enumerate(ways):
        one = rows.select("capture_id", "call", "frame", "seq", F.struct(F.lit(n).alias("rank"), F.lit(way).alias("way")).alias("w"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("capture_id", "call", "frame", "seq").agg(F.min("w")["way"].alias("way"))
