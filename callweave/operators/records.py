"""Diameter flows, PDU sessions, security associations, and the summary document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.sequences import detail

PDU_FIELDS = ("dnn", "sst", "5qi", "qfi", "ue-ipv4", "gtp-teid", "gtp-address", "gtp-teid-owner")


def diameter_hosts(messages: DataFrame) -> DataFrame:
    """host per address with a single Diameter origin; several are ambiguous and null."""
    rows = messages.where("protocol = 'diameter'").select("capture_id", F.col("src.ip").alias("address"), detail("origin-host").alias("origin")).where("origin is not null")
    return rows.groupBy("capture_id", "address").agg(F.count_distinct("origin").alias("origins"), F.min("origin").alias("lo")).select("capture_id", "address", "origins", F.when(F.col("origins") == 1, F.col("lo")).alias("host"))


def diameter_transactions(messages: DataFrame) -> DataFrame:
    """Per end-to-end id: hops, first frame, and the answer of the first hop that has one."""
    rows = messages.where("protocol = 'diameter'").select("capture_id", "flow_id", "frame", "ts", "label", "is_failure", detail("end-to-end-id").alias("id"), F.array_join(F.array_sort(F.array("src.ip", "dst.ip")), "|").alias("peers"))
    answer = F.col("label").endswith("Answer")
    hops = rows.where("id is not null").groupBy("capture_id", "id", "peers").agg(F.min("frame").alias("first_frame"), F.min(F.when(answer, F.struct("frame", "label", "is_failure"))).alias("answer"), F.count("*").alias("messages"))
    made = hops.groupBy("capture_id", "id").agg(F.count("*").alias("hops"), F.min("first_frame").alias("first_frame"), F.sum("messages").alias("messages"), F.min(F.when(F.col("answer").isNotNull(), F.struct("first_frame", "answer")))["answer"].alias("answer"))
    outcome = F.when(F.col("answer").isNull(), "unanswered").when(F.col("answer.is_failure"), "failure").otherwise("success")
    return made.select("capture_id", "id", "hops", (F.col("hops") > 1).alias("relayed"), "first_frame", "messages", F.col("answer.label").alias("answer"), outcome.alias("outcome"))


def diameter_flows(messages: DataFrame) -> DataFrame:
    """Per session (else peer pair): commands, peers, messages, failures, span."""
    peers = F.array_join(F.array_sort(F.array("src.ip", "dst.ip")), "|")
    rows = messages.where("protocol = 'diameter'").withColumns({"session": F.coalesce(detail("session-id"), peers), "peers": peers})
    return rows.groupBy("capture_id", "session").agg(F.array_sort(F.collect_set("label")).alias("commands"), F.count_distinct("peers").alias("hops"), F.count("*").alias("messages"), F.count_if("is_failure").alias("failures"), F.min("frame").alias("first_frame"), F.round(F.max("ts") - F.min("ts"), 6).alias("duration"))


def pdu_sessions(messages: DataFrame) -> DataFrame:
    """One row per (SUPI, PDU id): each field's first non-null value in (frame, protocol) order, with its frame and source."""
    supi = F.get(F.transform(F.filter("keys", lambda k: k["kind"] == "supi"), lambda k: k["value"]), F.lit(0))
    rows = messages.withColumns({"supi": supi, "pdu_id": detail("pdu-session-id")}).where("supi is not null and pdu_id is not null")
    field = lambda n: F.min(F.when(detail(n).isNotNull(), F.struct("frame", "protocol", detail(n).alias("value")))).alias(n.replace("-", "_"))
    return rows.groupBy("capture_id", "supi", "pdu_id").agg(*map(field, PDU_FIELDS), F.min("frame").alias("first_frame"), F.count("*").alias("messages"))


def tunnel_packets(sessions: DataFrame, gtp: DataFrame) -> DataFrame:
    """User-plane packets per session and side, joined on the tunnel (address, TEID)."""
    keys = sessions.select("capture_id", "supi", "pdu_id", F.col("gtp_address.value").alias("address"), F.col("gtp_teid.value").alias("teid"), F.coalesce("gtp_teid_owner.value", F.lit("upf")).alias("side"))
    # Counted per tunnel first: sessions of one tunnel don't meet its packets one by one.
    counts = gtp.groupBy("capture_id", F.col("dst.ip").alias("address"), detail("teid").alias("teid")).agg(F.count("*").alias("n"))
    return keys.join(counts, ["capture_id", "address", "teid"]).groupBy("capture_id", "supi", "pdu_id", "side").agg(F.sum("n").alias("packets"))


def security_associations(offers: DataFrame) -> DataFrame:
    """Earliest frame per (SPI, receiver); readable where the cipher is null."""
    return offers.groupBy("capture_id", "spi", "receiver").agg(F.min("frame").alias("frame"), F.min_by("cipher", "frame").alias("cipher")).withColumn("readable", F.col("cipher") == "null")


def summary_table(facts: DataFrame, causes: DataFrame, blast: DataFrame, elements: DataFrame) -> DataFrame:
    """One JSON document per capture. Its lists are roll-ups, bounded by causes, dimension values and addresses, not by messages."""
    lists = lambda df, name, *cols: df.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    held = facts.join(lists(causes, "causes", "cause_name", "n", "subscribers"), "capture_id", "left").join(lists(blast, "blast_radius", "dimension", "value", "failures", "subscribers"), "capture_id", "left").join(lists(elements, "elements", "address", "messages"), "capture_id", "left")
    return held.select("capture_id", F.to_json(F.struct(*[c for c in held.columns if c != "started_at"])).alias("document"))
