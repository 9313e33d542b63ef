"""Diameter flows with their end: transactions over relays, the way a request took, what stayed unanswered, how it ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.staging import staged
from callweave.operators.pairing import pair_cascade
from callweave.operators.sequences import detail

FLOW = ["capture_id", "kind", "session"]
#: A leg stays inside its flow: by hop-by-hop id, then by end-to-end id.
STAGES = (("hop", (*FLOW, "peers", "hop")), ("end", (*FLOW, "peers", "end")))


def diameter_rows(messages: DataFrame) -> DataFrame:
    """Diameter messages with their flow: the session they name ("session"), else the pair of their peers ("peer")."""
    peers = F.array_join(F.array_sort(F.array(F.coalesce("src.ip", F.lit("?")), F.coalesce("dst.ip", F.lit("?")))), "|")
    named = detail("session-id")
    return messages.where("protocol = 'diameter'").select(
        "capture_id", F.when(named.isNotNull(), "session").otherwise("peer").alias("kind"), F.coalesce(named, peers).alias("session"), "frame", "seq", "ts", "label", F.coalesce("is_failure", F.lit(False)).alias("is_failure"), F.col("src.ip").alias("src"), F.col("dst.ip").alias("dst"), peers.alias("peers"),
        detail("hop-by-hop-id").alias("hop"), detail("end-to-end-id").alias("end"), F.coalesce("label", F.lit("")).rlike("(^| )Request$|-Request$").alias("asks"), detail("redirect-host").isNotNull().alias("redirect"), detail("reference_point").alias("interface"), F.when(F.col("cause").isNotNull(), F.concat_ws(" ", "cause.table", "cause.value")).alias("cause"),
    )


def flow_legs(rows: DataFrame) -> DataFrame:
    """A row per leg: its ends in the direction of the request, first frame, transaction, answer (null: none), stage that paired it.

    A transaction is what shares an end-to-end id in a flow; a leg without the id is
    one of its own. A lone answer is a leg, read backwards.
    """
    legs = pair_cascade(rows.where("asks"), rows.where("not asks"), STAGES)
    either = lambda c: F.coalesce(F.col(f"request.{c}"), F.col(f"answer.{c}"))
    alone = F.concat_ws("/", F.lit("leg"), either("frame"), either("seq"))
    end = either("end")
    answer = F.when(F.col("answer").isNotNull(), F.struct("answer.frame", "answer.seq", "answer.is_failure", "answer.cause"))
    return legs.select(
        *(either(c).alias(c) for c in FLOW), F.when(end.isNull(), alone).otherwise(F.concat(F.lit("end/"), end)).alias("transaction"),
        F.least("request.frame", "answer.frame").alias("first_frame"), F.coalesce("request.src", "answer.dst").alias("from"), F.coalesce("request.dst", "answer.src").alias("to"), F.col("request").isNotNull().alias("asked"), answer.alias("answer"), "stage",
    )


def flow_transactions(legs: DataFrame) -> DataFrame:
    """Per transaction: legs, first frame, requests without an answer, and the answer of the leg nearest the one that asked."""
    held = legs.groupBy(*FLOW, "transaction").agg(
        F.count("*").alias("hops"), F.min("first_frame").alias("first_frame"), F.count_if(F.col("asked") & F.col("answer").isNull()).alias("unanswered"),
        F.min(F.when(F.col("answer").isNotNull(), F.struct("first_frame", "answer")))["answer"].alias("answer"),
    )
    outcome = F.when(F.col("answer").isNull(), "incomplete").when(F.col("answer.is_failure"), "failure").otherwise("success")
    return held.withColumn("outcome", outcome)


def flow_paths(legs: DataFrame) -> DataFrame:
    """The way of each flow's first transaction, a row per place: who asked (0), then the receiver of each leg."""
    lead = legs.groupBy(*FLOW).agg(F.min(F.struct("first_frame", "transaction")).alias("lead")).select(*FLOW, "lead.transaction")
    held = legs.join(lead, [*FLOW, "transaction"])
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy(*FLOW).orderBy("first_frame", "from", "to")))
    start = placed.where("place = 1").select(*FLOW, F.lit(0).alias("place"), F.col("from").alias("address"))
    return start.unionByName(placed.select(*FLOW, "place", F.col("to").alias("address")))


def flow_outcomes(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flows, paths).

    flows: a row per session, else peer pair, with interface (of its first message),
    messages, commands, transactions, hops, relayed, unanswered, failures, outcome,
    cause, first and last frame, duration. A failure that relays pass on counts once.
    A session fails with any failure but a redirect, and succeeds with any answer that
    is neither; peers succeed when every leg has its answer. The cause is that of the
    last failed transaction. Messages without addresses share the peer "?". The legs
    are staged once and read by both results.
    """
    rows = diameter_rows(messages)
    legs = staged(flow_legs(rows), "diameter-legs")
    place = F.struct("frame", "seq")
    failure = F.when(F.col("is_failure"), F.struct("end", "label", "cause"))
    said = rows.groupBy(*FLOW).agg(
        F.min_by("interface", place).alias("interface"), F.count("*").alias("messages"), F.array_sort(F.collect_set(F.regexp_replace("label", r"[ -]?(Request|Answer)$", ""))).alias("commands"), F.count_distinct(failure).alias("failures"), F.max(F.col("is_failure") & ~F.col("redirect")).alias("failed"),
        F.max(~F.col("asks") & ~F.col("is_failure") & ~F.col("redirect")).alias("settled"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.round(F.max("ts") - F.min("ts"), 6).alias("duration"),
    )
    done = flow_transactions(legs).groupBy(*FLOW).agg(
        F.count("*").alias("transactions"), F.max("hops").alias("hops"), F.max(F.col("hops") > 1).alias("relayed"), F.sum("unanswered").alias("unanswered"),
        F.max(F.when(F.col("outcome") == "failure", F.struct("first_frame", "answer.frame", "answer.cause")))["cause"].alias("cause"),
    )
    whole = legs.groupBy(*FLOW).agg(F.count_if(F.col("answer").isNull()).alias("open"), F.max(F.coalesce("answer.is_failure", F.lit(False))).alias("refused"))
    session = F.when(F.col("failed"), "failure").when(F.col("settled"), "success").otherwise("incomplete")
    peer = F.when(F.col("refused"), "failure").when(F.col("open") == 0, "success").otherwise("incomplete")
    flows = said.join(done, FLOW).join(whole, FLOW).withColumn("outcome", F.when(F.col("kind") == "session", session).otherwise(peer))
    return flows.drop("failed", "settled", "open", "refused"), flow_paths(legs)
