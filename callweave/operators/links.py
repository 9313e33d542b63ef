"""Links between messages, procedures, connections, calls, packets and subscribers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.sequences import detail
from callweave.operators.validity import owned, owner_at, values_of
from callweave.schema import IN_TIME, ROW


def with_owner(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """Each message with the segment that has it as a member; not by frame range."""
    own = segments.where("segment is not null").select(*ROW, "segment", F.col("kind").alias("procedure"))
    return messages.join(own, list(ROW), "left")


def first_connection(members: DataFrame, connections: DataFrame) -> DataFrame:
    """Per segment: the first radio connection that holds one of its members. connections: ROW and connection."""
    return members.join(connections.select(*ROW, "connection"), list(ROW)).groupBy("capture_id", "flow_id", "segment").agg(F.min_by("connection", F.struct("frame", "seq")).alias("connection"))


def carrying_sessions(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """capture_id, session, call: Diameter sessions in which any message carries the ICID of a call, each once. calls: capture_id, call, icid."""
    rows = messages.where("protocol = 'diameter'").select("capture_id", detail("session-id").alias("session"), detail("icid").alias("icid")).where("session is not null and icid is not null")
    return rows.distinct().join(calls.select("capture_id", "icid", "call").distinct(), ["capture_id", "icid"]).select("capture_id", "session", "call").distinct()


def charged_messages(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Diameter messages of sessions in which any message carries the ICID of a call, each once per call. calls: capture_id, call, icid."""
    rows = messages.where("protocol = 'diameter'").withColumn("session", detail("session-id")).where("session is not null")
    return rows.join(carrying_sessions(messages, calls), ["capture_id", "session"])


def packet_status(packets: DataFrame, flowed: DataFrame, owners: DataFrame) -> DataFrame:
    """Packets with their subscriber and ERROR for a failure's frame, SUCCESS for an owned one, else null. owners: capture_id, flow_id, subscriber."""
    facts = flowed.join(owners, ["capture_id", "flow_id"], "left").groupBy("capture_id", F.col("frame").alias("number")).agg(F.min("subscriber").alias("subscriber"), F.max("is_failure").alias("failed"))
    status = F.when(F.col("failed"), "ERROR").when(F.col("failed").isNotNull(), "SUCCESS")
    return packets.join(facts, ["capture_id", "number"], "left").withColumn("status", status).drop("failed")


def subscriber_of(targets: DataFrame, flowed: DataFrame) -> DataFrame:
    """targets (value) with the one SUPI whose flows hold the value; null where several subscribers touch it."""
    keys = flowed.select("capture_id", "flow_id", F.explode("keys").alias("k")).select("capture_id", "flow_id", "k.kind", "k.value").distinct()
    people = keys.where("kind = 'supi'").select("capture_id", "flow_id", F.col("value").alias("supi"))
    held = targets.join(keys.select("capture_id", "flow_id", "value").distinct(), "value").join(people, ["capture_id", "flow_id"])
    one = held.groupBy("capture_id", "value").agg(F.min("supi").alias("lo"), F.max("supi").alias("hi"))
    return one.select("capture_id", "value", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("supi"))


def inferred_joins(verdicts: DataFrame) -> DataFrame:
    """How many quotes joined flows, were refused, or changed nothing."""
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


def not_visible(captures: DataFrame, blind_spots: DataFrame, kinds: list[str]) -> DataFrame:
    """Per capture and kind of blind spot: how many, 0 where there is none; every kind is always there."""
    wanted = captures.select("capture_id").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    counts = blind_spots.groupBy("capture_id", "kind").agg(F.sum("n").alias("n"))
    return wanted.join(counts, ["capture_id", "kind"], "left").fillna(0, ["n"])


def numbers_in_calls(calls: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Calls with subscribers that share their flow or an international number."""
    by_flow = calls.join(subscribers.select("capture_id", "flow_id", "subscriber"), ["capture_id", "flow_id"]).select("capture_id", "call", "subscriber")
    by_number = calls.where("number like '+%'").join(subscribers.select("capture_id", "number", "subscriber"), ["capture_id", "number"]).select("capture_id", "call", "subscriber")
    return by_flow.unionByName(by_number).distinct()


def sightings_of_addresses(messages: DataFrame) -> DataFrame:
    """address, supi, ts, frame, seq: what messages say about which subscriber's session holds a UE address, and when its session is released."""
    supi = F.get(values_of("supi", F.col("keys")), F.lit(0))
    freed = F.col("label").rlike("(?i)release|delet|detach|deregistration")
    return messages.select("capture_id", detail("ue-ipv4").alias("address"), supi.alias("supi"), *IN_TIME, freed.alias("released")).where("address is not null and supi is not null")


def subscriber_of_address(targets: DataFrame, messages: DataFrame) -> DataFrame:
    """targets (capture_id, address, ts) with the SUPI that held the UE address at that time; null where nobody is known to."""
    held = owned(sightings_of_addresses(messages), ["capture_id", "address"], "supi", "ts", list(IN_TIME), "released")
    return owner_at(targets, held, ["capture_id", "address"], "ts", "supi")


def session_messages(messages: DataFrame) -> DataFrame:
    """capture_id, supi, pdu_id, frame, seq, protocol, side: PFCP and GTP-U messages on the tunnels of each PDU session, while it had them.

    Tunnels are the keys that a message with subscriber and session id states; another
    session that states the same tunnel later has it from then on.
    """
    supi = F.get(values_of("supi", F.col("keys")), F.lit(0))
    stated = messages.select("capture_id", *IN_TIME, supi.alias("supi"), detail("pdu-session-id").alias("pdu_id"), F.coalesce(detail("gtp-teid-owner"), F.lit("upf")).alias("side"), F.explode(values_of("gtp_teid", F.col("keys"))).alias("tunnel"), F.lit(False).alias("released"))
    stated = stated.where("supi is not null and pdu_id is not null").withColumn("owner", F.struct("supi", "pdu_id", "side"))
    held = owned(stated, ["capture_id", "tunnel"], "owner", "ts", list(IN_TIME), "released")
    rows = messages.where("protocol in ('pfcp', 'gtp')").select("capture_id", *IN_TIME, "protocol", F.explode(F.array_distinct(values_of("gtp_teid", F.col("keys")))).alias("tunnel"))
    got = owner_at(rows, held, ["capture_id", "tunnel"], "ts", "owner").where("owner is not null")
    return got.select("capture_id", "owner.supi", "owner.pdu_id", "frame", "seq", "protocol", "owner.side").distinct()
