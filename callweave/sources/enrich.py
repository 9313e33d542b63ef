"""Trace enrichment of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sidecar(messages: DataFrame, trace: DataFrame) -> DataFrame:
    """Joins trace rows (capture_id, ordinal) to messages by frame, only in captures where both have as many.

    Fills missing hosts and roles, and adds the trace's subscriber as a SUPI key.
    """
    frames = messages.groupBy("capture_id").agg(F.count_distinct("frame").alias("n"))
    same = trace.groupBy("capture_id").agg(F.count("*").alias("t")).join(frames, "capture_id").where("n = t").select("capture_id")
    held = trace.join(same, "capture_id").select("capture_id", F.col("ordinal").cast("long").alias("frame"), "initiator_fqdn", "initiator_type", "target_fqdn", "target_type", "id_type", "id_value")
    out = messages.join(held, ["capture_id", "frame"], "left")
    for end, e in (("src", "initiator"), ("dst", "target")):
        out = out.withColumn(end, F.col(end).withField("host", F.coalesce(f"{end}.host", f"{e}_fqdn")).withField("role", F.coalesce(f"{end}.role", f"{e}_type")))
    supi = F.when(F.upper("id_type") == "IMSI", F.array(F.struct(F.lit("supi").alias("kind"), F.col("id_value").alias("value"))))
    out = out.withColumn("keys", F.when(supi.isNotNull() & F.col("id_value").isNotNull(), F.array_union("keys", supi)).otherwise(F.col("keys")))
    return out.select(messages.columns)
