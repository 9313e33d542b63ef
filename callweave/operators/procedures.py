"""Procedures: segmentation of flows, release folding, finishing, SIP and Diameter segments, records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.operators.sequences import detail, distinct_observed
from callweave.schema import ROW

QUIET_GAP = 1.0

# What opens a procedure (own label; exact or contained), and what completes it. First match wins.
OPENERS = (
    ("registration", "Registration request", False, ("Registration accept", "Registration complete", "InitialContextSetupResponse")),
    ("pdu-session-establishment", "PDU session establishment request", False, ("PDU session establishment accept", "PDUSessionResourceSetupResponse")),
    ("pdu-session-release", "PDU session release request", False, ("PDU session release complete", "PDUSessionResourceReleaseResponse")),
    ("service-request", "Service request", False, ("Service accept", "InitialContextSetupResponse")),
    ("deregistration", "Deregistration request", False, ("Deregistration accept",)),
    ("attach", "Attach request", False, ("Attach accept", "Attach complete", "InitialContextSetupResponse")),
    ("handover", "HandoverPreparation", True, ("HandoverNotification", "Forward Relocation Complete Acknowledge")),
    ("ue-context-release", "UEContextReleaseRequest", True, ("UEContextReleaseResponse", "UEContextReleaseComplete")),
    ("ue-context-release", "UEContextRelease", True, ("UEContextReleaseResponse", "UEContextReleaseComplete")),
    ("ue-context-release", "UEContextReleaseCommand", True, ("UEContextReleaseResponse", "UEContextReleaseComplete")),
    ("pdu-session-modification", "PDUSessionResourceModify", True, ("PDUSessionResourceModifyResponse", "PDU session modification complete")),
    ("handover", "Forward Relocation Request", True, ("HandoverNotification", "Forward Relocation Complete Acknowledge")),
    ("handover", "HandoverResourceAllocation", True, ("HandoverNotification", "Forward Relocation Complete Acknowledge")),
    ("context-transfer", "Context Request", True, ("Context Acknowledge",)),
    ("tau", "Tracking area update request", False, ("Tracking area update accept", "Tracking area update complete")),
    ("detach", "Detach request", False, ("Detach accept",)),
    ("service-request", "Downlink Data Notification", True, ("Service accept", "InitialContextSetupResponse")),
    ("service-request", "Paging", True, ("Service accept", "InitialContextSetupResponse")),
    ("dedicated-bearer-activation", "Create Bearer Request", True, ("Create Bearer Response",)),
    ("dedicated-bearer-deactivation", "Delete Bearer Request", True, ("Delete Bearer Response",)),
    ("bearer-modification", "E-RABModificationIndication", True, ("E-RABModificationIndicationResponse",)),
    ("handover", "HandoverCancel", True, ("HandoverCancelResponse",)),
    ("handover", "Relocation Cancel Request", True, ("Relocation Cancel Response",)),
    ("handover", "PathSwitchRequest", True, ("PathSwitchRequestResponse",)),
    ("csfb", "Extended service request", False, ("UEContextModificationResponse", "InitialContextSetupResponse")),
    ("pdn-connection-release", "Delete Session Request", True, ("Delete Session Response",)),
)
NETWORK_TRIGGERS = ("Downlink Data Notification", "Paging")
#: What a cancelling message's own label begins with.
CANCELS = ("HandoverCancel", "Relocation Cancel")
RELEASES = ("ue-context-release",)
# Handover types between the systems, and which element asks for the context of a UE that has come to it.
TO_EPS, TO_5GS = "5gs-to-eps", "eps-to-5gs"
HANDOVER_WAYS = (("fivegs-to-eps", TO_EPS), ("eps-to-5gs", TO_5GS))
ASKER_WAYS = (("MME", TO_EPS), ("AMF", TO_5GS))
UNFINISHED_ABSORB = ("tau", "attach", "registration")


def own_labels(label: str) -> str:
    return label.split(" + ")[0]


def opener(label: Column, openers=OPENERS) -> Column:
    """Place of the first rule that the own label meets."""
    own = F.split(label, r" \+ ")[0]
    return F.coalesce(*(F.when(own == text if exact else own.contains(text), F.lit(n)) for n, (_, text, exact, _) in enumerate(openers)))


def _opens(label: str, openers) -> int | None:
    own = own_labels(label)
    return next((n for n, (_, text, exact, _) in enumerate(openers) if (own == text if exact else text in own)), None)


class Segmenter:
    """The state of one flow: which segment is open and what it has seen. Batch and stream share it."""

    def __init__(self, quiet: float = QUIET_GAP, openers=OPENERS, state: tuple | None = None):
        self.quiet, self.openers = quiet, openers
        self.number, self.kind, self.success, self.last, self.failed, self.outcome = state or (0, None, (), 0.0, False, False)

    def state(self) -> tuple:
        return self.number, self.kind, self.success, self.last, self.failed, self.outcome

    def _seen(self, label: str) -> bool:
        return any(s in label for s in self.success) or own_labels(label).startswith(CANCELS)

    def step(self, ts: float, label: str, failed: bool) -> tuple[int, str] | None:
        """(segment, kind) that the message belongs to, or None."""
        if self.kind and self.outcome and ts - self.last > self.quiet:
            self.kind = None
        n = _opens(label, self.openers)
        if n is not None:
            kind, _, _, success = self.openers[n]
            cancel = own_labels(label).startswith(CANCELS)
            # A repeated opener belongs to the open segment, which keeps the rule that opened it.
            same = self.kind == kind and not (self.failed or (self.outcome and not cancel))
            absorbed = kind == "context-transfer" and self.kind in UNFINISHED_ABSORB and not self.outcome
            if not same and not absorbed:
                self.number, self.kind, self.success, self.failed, self.outcome = self.number + 1, kind, success, False, False
        if not self.kind:
            return None
        self.last, self.failed, self.outcome = ts, self.failed or failed, self.outcome or self._seen(label)
        return self.number, self.kind


def segment_procedures(messages: DataFrame, quiet: float = QUIET_GAP, openers=OPENERS) -> DataFrame:
    """capture_id, flow_id, frame, seq, segment, kind (null: unassigned), SIP left out.

    Which message closes a segment depends on what the segment holds, so flows
    are replayed in order: rows are dealt and sorted by flow and time, and one pass
    over a partition's batches keeps the state of the current flow alone, so a long
    flow costs time but no memory. The null flow stays unassigned where it is.
    """
    rows = messages.where("protocol <> 'sip'").select("capture_id", "flow_id", "frame", "seq", "ts", "label", "is_failure")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, machine = None, Segmenter(quiet, openers)
        for batch in batches:
            capture, flows, ts, label, failed = (batch.column(n).to_pylist() for n in ("capture_id", "flow_id", "ts", "label", "is_failure"))
            got = []
            for c, f, t, x, bad in zip(capture, flows, ts, label, failed, strict=True):
                if (c, f) != flow:
                    flow, machine = (c, f), Segmenter(quiet, openers)
                got.append(machine.step(t, x, bad))
            made = [pa.array([g and g[k] for g in got], kind) for k, kind in ((0, pa.int64()), (1, pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("capture_id", "flow_id", "frame", "seq")), *made], ["capture_id", "flow_id", "frame", "seq", "segment", "kind"])

    schema = "capture_id string, flow_id string, frame long, seq int, segment long, kind string"
    dealt = rows.where("flow_id is not null").repartition("capture_id", "flow_id").sortWithinPartitions("capture_id", "flow_id", "ts", "frame", "seq")
    made = dealt.mapInArrow(run, schema)
    none = rows.where("flow_id is null").select("capture_id", "flow_id", "frame", "seq", F.lit(None).cast("long").alias("segment"), F.lit(None).cast("string").alias("kind"))
    return made.unionByName(none)


SEGMENT = ["capture_id", "flow_id", "segment", "kind"]


def finish(messages: DataFrame, segments: DataFrame, openers=OPENERS) -> DataFrame:
    """One row per segment: outcome, causes, span, trigger, timings, attributes.

    direction: from the handover type, from who asks for a context, or of an update
    that fetches one; null where nothing says it. family: 5g with any NGAP or 5GS NAS
    message, else 4g with S1AP, EPS NAS or GTPv2-C, else other.
    """
    rows = messages.join(segments.where("segment is not null").drop("flow_id"), list(ROW))
    success = F.coalesce(*(F.when(F.col("kind") == k, F.exists(F.array(*map(F.lit, sorted({s for kk, _, _, ss in openers if kk == k for s in ss}))), lambda s: F.col("label").contains(s))) for k in sorted({o[0] for o in openers})), F.lit(False))
    place = F.struct("ts", "frame", "seq")
    own = F.split("label", r" \+ ")[0]
    cancel = own.startswith(CANCELS[0]) | own.startswith(CANCELS[1])
    reason = F.coalesce("cause_name", "label") if "cause_name" in messages.columns else F.coalesce(F.concat_ws(" ", "cause.table", "cause.value"), "label")
    failed = F.col("is_failure")
    has = lambda *names: F.max(F.col("protocol").isin(*names))
    only = lambda name: F.when(F.min(detail(name)) == F.max(detail(name)), F.min(detail(name)))
    made = rows.groupBy(*SEGMENT).agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("messages"), F.max(place).alias("last_pos"), F.min(place).alias("first_pos"),
        F.max(F.when(success, place)).alias("s"), F.max(F.when(failed, F.struct(place.alias("p"), reason.alias("c")))).alias("f"), F.min(F.when(failed, F.struct(place.alias("p"), reason.alias("c")))).alias("f0"),
        F.max(cancel).alias("cancelled"), F.max(F.col("label").isin(*NETWORK_TRIGGERS)).alias("network"), F.max(detail("handover-type")).alias("handover_type"),
        F.max((F.col("cause.table") == "ngap_radioNetwork") & (F.col("cause.value") == 36)).alias("fallback"),
        only("pdu-session-id").alias("pdu_session_id"), only("dnn").alias("dnn"), F.min_by(F.col("src.role"), place).alias("initiator"),
        F.min(F.when(F.col("label").contains("HandoverPreparationResponse") | F.col("label").contains("HandoverCommand"), F.col("ts"))).alias("command"), F.min(F.when(own == "HandoverResourceAllocationResponse", F.col("ts"))).alias("acknowledged"), F.min(F.when(F.col("label").contains("HandoverNotification"), F.col("ts"))).alias("notify"),
        F.min(F.get(F.transform(F.filter("keys", lambda k: k["kind"] == "supi"), lambda k: k["value"]), F.lit(0))).alias("supi"),
        F.max(own == "Context Request").alias("context"), has("ngap", "nas-5gs").alias("five"), has("s1ap", "nas-eps", "gtpv2").alias("four"),
    )
    outcome = F.when(F.col("s").isNotNull() & (F.col("f").isNull() | (F.col("s") > F.col("f.p"))), "success").when(F.col("f").isNotNull(), "failure").otherwise("incomplete")
    made = made.withColumn("outcome", outcome).withColumn("outcome", F.when((F.col("kind") == "handover") & F.col("cancelled") & (F.col("outcome") != "success"), "cancelled").otherwise(F.col("outcome")))
    kind = F.when((F.col("kind") == "pdu-session-modification") & F.coalesce("fallback", F.lit(False)), "eps-fallback").otherwise(F.col("kind"))
    # The source side's command says that all is prepared; a trace of the target side alone has only its acknowledgement.
    ready = F.coalesce("command", "acknowledged")
    moved = lambda c, ways: F.coalesce(*(F.when(c == k, v) for k, v in ways))
    direction = F.when(F.col("kind") == "handover", moved(F.col("handover_type"), HANDOVER_WAYS)).when(F.col("kind") == "context-transfer", moved(F.col("initiator"), ASKER_WAYS)).when((F.col("kind") == "tau") & F.col("context"), TO_EPS)
    return made.select(
        "capture_id", "flow_id", "segment", kind.alias("kind"), "outcome", F.col("f.c").alias("cause"), F.when(F.col("f0.c") != F.col("f.c"), F.col("f0.c")).alias("first_failure"), "start_frame", "end_frame", "start", "end", F.round(F.col("end") - F.col("start"), 6).alias("duration"), "messages",
        F.when(F.col("kind") == "service-request", F.when(F.col("network"), "network").otherwise("ue")).alias("trigger"), "handover_type", "pdu_session_id", "dnn", "initiator", F.round(ready - F.col("start"), 6).alias("prep_s"), F.round(F.col("notify") - ready, 6).alias("exec_s"), "supi", "first_pos", "last_pos",
        direction.alias("direction"), F.when(F.col("five"), "5g").when(F.col("four"), "4g").otherwise("other").alias("family"),
    )


def fold_releases(procedures: DataFrame, positions: DataFrame) -> DataFrame:
    """Marks a release segment that directly follows a non-release segment (by message position in the flow) as its child."""
    w = Window.partitionBy("capture_id", "flow_id").orderBy("first")
    held = procedures.join(positions, ["capture_id", "flow_id", "segment"])
    previous = F.lag(F.struct("last", "kind", "segment")).over(w)
    held = held.withColumn("__p", previous)
    child = F.col("kind").isin(*RELEASES) & (F.col("__p.last") + 1 == F.col("first")) & ~F.col("__p.kind").isin(*RELEASES)
    return held.withColumn("folded_into", F.when(child, F.col("__p.segment"))).drop("__p", "first", "last")


def segment_positions(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """First and last place of each segment in its flow's order."""
    placed = messages.where("flow_id is not null and protocol <> 'sip'").select(*ROW, "flow_id", F.row_number().over(Window.partitionBy("capture_id", "flow_id").orderBy("ts", "frame", "seq")).alias("n"))
    return placed.join(segments.where("segment is not null").drop("flow_id"), list(ROW)).groupBy("capture_id", "flow_id", "segment").agg(F.min("n").alias("first"), F.max("n").alias("last"))


def sip_segments(messages: DataFrame) -> DataFrame:
    """Per Call-ID: kind of the first request, final response, ring, answer, talk, who released."""
    call = F.get(F.transform(F.filter("keys", lambda k: k["kind"] == "sip_call_id"), lambda k: k["value"]), F.lit(0))
    rows = messages.where("protocol = 'sip'").withColumns({"call": call, "status": F.regexp_extract("label", r"^([1-6][0-9]{2})(?: |$)", 1).try_cast("int"), "method": detail("cseq-method"), "from_tag": detail("from-tag")}).where("call is not null")
    place = F.struct("ts", "frame", "seq")
    request = F.col("status").isNull()
    made = rows.groupBy("capture_id", "call").agg(
        F.min_by(F.when(request, F.col("label")), F.when(request, place)).alias("kind"), F.min("frame").alias("start_frame"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("messages"),
        F.min(F.when((F.col("status") >= 200) & (F.col("method") == "INVITE"), F.struct(place.alias("p"), "status"))).alias("final"),
        F.min(F.when(F.col("status") == 180, F.col("ts"))).alias("ring_at"), F.min(F.when((F.col("status") == 200) & (F.col("method") == "INVITE"), F.col("ts"))).alias("answer_at"),
        F.min(F.when(F.col("label") == "BYE", F.struct(place.alias("p"), "from_tag"))).alias("bye"), F.min_by("from_tag", F.when(request, place)).alias("caller_tag"), F.max("is_failure").alias("failed"),
    )
    bye = F.col("bye.p.ts")
    return made.select("capture_id", "call", F.lower("kind").alias("kind"), "start_frame", "start", "end", "messages", F.col("final.status").alias("final_status"), F.round(F.col("ring_at") - F.col("start"), 6).alias("ring_s"), F.round(F.col("answer_at") - F.col("start"), 6).alias("answer_s"), F.round(bye - F.col("answer_at"), 6).alias("talk_s"), F.when(F.col("bye").isNotNull(), F.when(F.col("bye.from_tag") == F.col("caller_tag"), "caller").otherwise("callee")).alias("released_by"), F.when(F.col("answer_at").isNotNull(), "success").when(F.col("failed"), "failure").otherwise("incomplete").alias("outcome"))


def diameter_segments(unassigned: DataFrame) -> DataFrame:
    """Per Session-Id among Diameter messages of no procedure: relay copies once; redirects settle nothing."""
    rows = distinct_observed(unassigned.where("protocol = 'diameter'")).withColumn("session", detail("session-id")).where("session is not null")
    redirect = detail("redirect-host").isNotNull()
    place = F.struct("ts", "frame", "seq")
    made = rows.groupBy("capture_id", "session").agg(F.min_by("label", place).alias("first"), F.min("frame").alias("start_frame"), F.count("*").alias("messages"), F.max(F.col("is_failure") & ~redirect).alias("failed"), F.max(F.col("label").endswith("Answer") & ~redirect & ~F.col("is_failure")).alias("answered"))
    return made.select("capture_id", "session", F.concat(F.lit("hss-"), F.lower(F.regexp_replace("first", r"[ -]?(Request|Answer)$", ""))).alias("kind"), "start_frame", "messages", F.when(F.col("failed"), "failure").when(F.col("answered"), "success").otherwise("incomplete").alias("outcome"))


def xdr_totals(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """Per capture: messages, assigned, unassigned; the last two sum to the first."""
    held = messages.where("protocol <> 'sip'").join(segments.drop("flow_id"), list(ROW), "left")
    return held.groupBy("capture_id").agg(F.count("*").alias("messages"), F.count("segment").alias("assigned"), F.count_if(F.col("segment").isNull()).alias("unassigned"))


def write_xdr(procedures: DataFrame, totals: DataFrame, path: str, version: int = 1) -> None:
    """Records by capture, ordered by start frame and SUPI, beside the conservation counters; a large capture is cut over files by range."""
    rows = procedures.drop("first_pos", "last_pos").withColumn("version", F.lit(version))
    order = ["capture_id", "start_frame", "supi", "segment"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("capture_id").parquet(f"{path}/records")
    totals.write.parquet(f"{path}/totals")


FAMILIES = {"registration": "mobility", "tau": "mobility", "attach": "mobility", "deregistration": "mobility", "detach": "mobility", "service-request": "mobility", "context-transfer": "mobility", "handover": "handover", "ue-context-release": "release"}


def behaviours(procedures: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Category, KPI and its value, and slow where it is over the threshold."""
    limits = {"handover": 1.5, "registration": 1.0, "call": 3.0} | (thresholds or {})
    category = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv)), F.col("kind")), F.lit("session"))
    limit = F.try_element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("kind"))
    return procedures.withColumns({"category": category, "slow": F.col("duration") > limit})
