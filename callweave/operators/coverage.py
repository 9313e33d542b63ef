"""What was not decoded, capture shape, narrowing, and packet searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SYNTHETIC, UNCLAIMED, TOP_PORTS, INTERESTING, LEAST_TOTAL, MAX_CONVERSATIONS = 4, 2, 8, 10, 200, 500
TRANSPORT = ("tcp", "udp", "sctp", "ip", "ipv6", "eth", "data")


def census(packets: DataFrame, decoded: DataFrame) -> DataFrame:
    """Undecoded frames by leaf protocol, ancestors and port. packets: number, protocols (a:b:c), src_port, dst_port."""
    open_ = packets.join(decoded.select("capture_id", F.col("frame").alias("number")).distinct(), ["capture_id", "number"], "left_anti")
    parts = F.split("protocols", ":")
    return open_.groupBy("capture_id", F.element_at(parts, -1).alias("leaf"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ":").alias("chain"), F.least("src_port", "dst_port").alias("port")).agg(F.count("*").alias("frames"), F.min("number").alias("first_frame"))


def coverage(packets: DataFrame, decoded: DataFrame) -> DataFrame:
    """Per capture: total = parsed + fragments + segments + missed, and the ratio of what isn't missed.

    Fragments are pieces named by a whole frame; segments are reassembled
    elsewhere; a piece that is itself a message counts as parsed.
    """
    parsed = decoded.select("capture_id", F.col("frame").alias("number")).distinct().withColumn("parsed", F.lit(True))
    pieces = packets.select("capture_id", F.explode("fragments").alias("number")).distinct().withColumn("piece", F.lit(True))
    held = packets.join(parsed, ["capture_id", "number"], "left").join(pieces, ["capture_id", "number"], "left")
    kind = F.when(F.col("parsed"), "parsed").when(F.col("piece"), "fragment").when(F.col("reassembled_in").isNotNull(), "segment").otherwise("missed")
    counted = held.groupBy("capture_id").agg(F.count("*").alias("total"), *(F.count_if(kind == k).alias(n) for k, n in (("parsed", "parsed"), ("fragment", "fragments"), ("segment", "segments"), ("missed", "missed"))))
    return counted.withColumn("ratio", F.round(1 - F.col("missed") / F.col("total"), 6))


def coverage_notes(census_: DataFrame) -> DataFrame:
    """Worth mentioning: other leaves always; transport leaves only in numbers."""
    total = F.sum("frames").over(Window.partitionBy("capture_id"))
    return census_.withColumn("__t", total).where(~F.col("leaf").isin(*TRANSPORT) | ((F.col("frames") >= INTERESTING) & (F.col("__t") >= LEAST_TOTAL))).drop("__t")


def suggest_port(census_: DataFrame, mapped: list[int]) -> DataFrame:
    """Most frequent undecoded port per capture, ten frames at least; a tie prefers a mapped port, then the lower."""
    ports = census_.where("port is not null").groupBy("capture_id", "port").agg(F.sum("frames").alias("frames")).where(F.col("frames") >= INTERESTING)
    return ports.groupBy("capture_id").agg(F.max_by(F.struct("port", "frames"), F.struct("frames", F.col("port").isin(*mapped), -F.col("port"))).alias("p")).select("capture_id", "p.*")


def address_pairs(packets: DataFrame, protocol: str) -> DataFrame:
    pairs = packets.where(F.col("protocol") == protocol)
    return pairs.groupBy("capture_id").agg(F.count_distinct(F.array_sort(F.array("src", "dst"))).alias("pairs"))


def synthetic_sequences(segments: DataFrame, least: int = SYNTHETIC) -> DataFrame:
    """Directions of a stream with `least` payload frames or more that all carry one raw sequence number."""
    made = segments.where("payload > 0").groupBy("capture_id", "stream", "src_port").agg(F.count("*").alias("frames"), F.count_distinct("seq_raw").alias("numbers"))
    return made.where((F.col("frames") >= least) & (F.col("numbers") == 1)).drop("numbers")


def server_ports(segments: DataFrame) -> DataFrame:
    """Server port per stream: where the handshake went, else the port used by strictly more streams, else the first payload's destination."""
    syn = segments.where("syn and not ack").groupBy("capture_id", "stream").agg(F.min_by("dst_port", "number").alias("by_handshake"))
    ends = segments.groupBy("capture_id", "stream").agg(F.min("src_port").alias("a"), F.max("src_port").alias("b"), F.min_by("dst_port", F.when(F.col("payload") > 0, F.col("number"))).alias("by_payload"))
    used = segments.select("capture_id", "stream", F.explode(F.array("src_port", "dst_port")).alias("port")).distinct().groupBy("capture_id", "port").agg(F.count("*").alias("streams"))
    u = lambda c: used.select("capture_id", F.col("port").alias(c), F.col("streams").alias(f"n_{c}"))
    held = ends.join(u("a"), ["capture_id", "a"], "left").join(u("b"), ["capture_id", "b"], "left").join(syn, ["capture_id", "stream"], "left")
    more = F.when(F.col("n_a") > F.col("n_b"), F.col("a")).when(F.col("n_b") > F.col("n_a"), F.col("b"))
    return held.select("capture_id", "stream", F.coalesce("by_handshake", more, "by_payload").alias("server_port"))


def unclaimed_ports(unclaimed: DataFrame, top: int = TOP_PORTS) -> DataFrame:
    """Server ports with at least two unclaimed frames, the busiest `top` per capture."""
    made = unclaimed.groupBy("capture_id", "server_port").agg(F.count("*").alias("frames")).where(F.col("frames") >= UNCLAIMED)
    return made.withColumn("n", F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("frames"), "server_port"))).where(F.col("n") <= top).drop("n")


def port_protocols(streams: DataFrame) -> DataFrame:
    """Per server port: the protocol all its streams agree on, or null and mixed."""
    made = streams.groupBy("capture_id", "server_port").agg(F.min("protocol").alias("lo"), F.max("protocol").alias("hi"), F.count_distinct("stream").alias("streams"))
    return made.select("capture_id", "server_port", "streams", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("protocol"), (F.col("lo") != F.col("hi")).alias("mixed"))


def accept_rerun(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per capture: whether a re-decode is accepted: strictly more messages, and no protocol has fewer."""
    count = lambda df, n: df.groupBy("capture_id", "protocol").agg(F.count("*").alias(n))
    both = count(before, "b").join(count(after, "a"), ["capture_id", "protocol"], "full").fillna(0, ["a", "b"])
    return both.groupBy("capture_id").agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.every(F.col("a") >= F.col("b")).alias("kept")).withColumn("accepted", F.col("kept") & (F.col("after") > F.col("before"))).drop("kept")


def narrow(frames: DataFrame, text: Column, digits: str, most: int = MAX_CONVERSATIONS) -> DataFrame:
    """Frames of all conversations in which a frame holds the identifier; no hit or too many conversations narrows nothing.

    frames: capture_id, transport (tcp or sctp), stream.
    """
    if not (digits.isdigit() and 5 <= len(digits) <= 20):
        raise ValueError("an identifier has 5 to 20 digits")
    hits = frames.where(text.contains(digits)).where("stream is not null").select("capture_id", "transport", "stream").distinct()
    n = hits.limit(most + 1).count()
    return frames.join(hits, ["capture_id", "transport", "stream"], "left_semi") if 0 < n <= most else frames


def narrow_excluded(frames: DataFrame, narrowed: DataFrame) -> DataFrame:
    """What fell outside a narrowing, by transport."""
    return frames.join(narrowed.select("capture_id", "number"), ["capture_id", "number"], "left_anti").groupBy("capture_id", "transport").agg(F.count("*").alias("frames"))


def search(packets: DataFrame, q: str) -> DataFrame:
    """Substring of info, protocol or an address, letter case aside; a number also matches that packet."""
    low = q.lower()
    hit = F.lit(False)
    for c in ("info", "protocol", "src", "dst"):
        hit = hit | F.coalesce(F.lower(c).contains(low), F.lit(False))
    return packets.where(hit | (F.col("number") == int(q)) if q.isdigit() else hit)


def time_window(df: DataFrame, since: float | None = None, until: float | None = None) -> DataFrame:
    """ts within [since, until], relative seconds, both ends included."""
    if (since or 0) < 0 or (until or 0) < 0 or (since is not None and until is not None and since > until):
        raise ValueError("since and until are non-negative, and in order")
    for bound, keep in ((since, F.col("ts") >= F.lit(since)), (until, F.col("ts") <= F.lit(until))):
        df = df.where(keep) if bound is not None else df
    return df


def select_identity(messages: DataFrame, kind: str, value: str, level: str = "flow") -> DataFrame:
    """Messages with the key, or all messages of flows that hold it."""
    hit = messages.where(F.exists("keys", lambda k: (k["kind"] == kind) & (k["value"] == value)))
    return hit if level == "message" else messages.join(hit.select("capture_id", "flow_id").distinct(), ["capture_id", "flow_id"], "left_semi")


def sessions_in_window(messages: DataFrame, since: Column, until: Column) -> DataFrame:
    """Flows with any message inside the absolute window; captures without a clock keep all."""
    inside = messages.where(F.col("event_time").between(since, until) | F.col("event_time").isNull()).select("capture_id", "flow_id").distinct()
    return messages.join(inside, ["capture_id", "flow_id"], "left_semi")


def lookup(identities: DataFrame, q: str) -> DataFrame:
    return identities.where(F.lower("value").contains(q.lower()) | (F.concat_ws("=", "kind", "value") == q))


def search_reasons(captures: DataFrame, identities: DataFrame, blind_spots: DataFrame, q: str) -> DataFrame:
    """capture_id, hits, supis, reason: why a capture has no identity like q; null where it has one.

    blind_spots: capture_id, kind, n; the kinds "protected" (concealed SUCI) and "ciphered" (NAS) count.
    all-protected: concealed subscribers and no SUPI. some-protected: SUPIs, but none
    alike, and whom is sought may be concealed. no-match: SUPIs, none alike. ciphered: no
    SUPI, and NAS that can't be read. no-identity: none of these.
    """
    hits = lookup(identities, q).groupBy("capture_id").agg(F.count("*").alias("hits"))
    people = identities.where("kind = 'supi'").groupBy("capture_id").agg(F.count("*").alias("supis"))
    spots = blind_spots.groupBy("capture_id").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("protected", "ciphered")))
    held = captures.select("capture_id").distinct()
    for part in (hits, people, spots):
        held = held.join(part, "capture_id", "left")
    held = held.fillna(0, ["hits", "supis", "protected", "ciphered"])
    some = F.col("supis") > 0
    reason = F.when(F.col("hits") > 0, None).when((F.col("protected") > 0) & ~some, "all-protected").when(F.col("protected") > 0, "some-protected").when(some, "no-match").when(F.col("ciphered") > 0, "ciphered").otherwise("no-identity")
    return held.select("capture_id", "hits", "supis", reason.alias("reason"))


def select_flows(messages: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Messages of the wanted (capture_id, flow_id); a flow that isn't there is an error, not an empty answer."""
    given = messages.sparkSession.createDataFrame(wanted, "capture_id string, flow_id string").distinct()
    missing = given.join(messages.select("capture_id", "flow_id"), ["capture_id", "flow_id"], "left_anti").limit(5).collect()
    if missing:
        raise LookupError(f"no such flow: {[tuple(r) for r in missing]}")
    return messages.join(given, ["capture_id", "flow_id"], "left_semi")


def piece_frames(packets: DataFrame, decoded: DataFrame) -> DataFrame:
    """Fragments that are no messages themselves."""
    pieces = packets.select("capture_id", F.explode("fragments").alias("frame")).distinct()
    return pieces.join(decoded.select("capture_id", "frame").distinct(), ["capture_id", "frame"], "left_anti")
