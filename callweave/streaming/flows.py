"""Streaming ingest, and flows that grow with every micro-batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.staging import staged
from callweave.operators.components import chain_ends, connected_components
from callweave.operators.correlate import edges_of, with_flows
from callweave.sources.readers import frame_rows, with_endpoints


def stream_frames(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Dissected frames of growing files as a stream; ts is the absolute time, as a stream has no first frame to count from."""
    lines = spark.readStream.options(**options).text(path).withColumn("capture_id", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)$", 1))
    return with_endpoints(frame_rows(lines).withColumn("ts", F.col("abs_ts")))


class FlowTable:
    """Key -> flow, kept in the shared store as what each micro-batch adds: new keys, and labels that it found to be another flow.

    A batch looks up its own keys, finds the components of its edges with known
    keys contracted to their flows, and writes two small folders of its own number,
    so a batch that is run again replaces what it wrote and changes nothing else.
    Every `compact` batches the labels are folded into the keys.
    """

    KEYS, LABELS = "node string, component string", "old string, new string"

    def __init__(self, spark: SparkSession, path: str, compact: int = 20):
        self.spark, self.path, self.compact = spark, path.rstrip("/"), compact

    def _read(self, kind: str, schema: str, after: int, before: int | None) -> DataFrame:
        try:
            rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{kind}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        held = rows.where(F.col("batch") > after)
        return (held if before is None else held.where(F.col("batch") < before)).drop("batch")

    def _base(self, before: int | None) -> int:
        """The last batch that is folded in; -1 for none."""
        done = self._read("folded", "upto long", -1, before).agg(F.max("upto")).first()[0]
        return -1 if done is None else done

    def components(self, before: int | None = None) -> DataFrame:
        """node, component: all keys so far (or before a batch), each with the least key of its flow."""
        return self._components(self._base(before), before)

    def _components(self, base: int, before: int | None) -> DataFrame:
        keys = self._read("keys", self.KEYS, base, before)
        if base >= 0:
            folded = self.spark.read.schema(self.KEYS).parquet(f"{self.path}/base/upto={base}")
            keys = folded.unionByName(keys)
        ends = chain_ends(self._read("labels", self.LABELS, base, before), "old", "new")
        held = keys.join(ends.withColumnRenamed("old", "component"), "component", "left")
        return held.select("node", F.coalesce("new", "component").alias("component"))

    def add(self, messages: DataFrame, batch: int) -> None:
        """Merges a micro-batch's messages; for foreachBatch."""
        edges = staged(edges_of(messages), "batch-edges")
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        known = staged(self.components(batch).join(nodes, "node", "left_semi"), "known-keys")
        for end in ("a", "b"):
            edges = edges.join(known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_flow")), end, "left")
        edges = edges.select(*(F.coalesce(f"{end}_flow", end).alias(end) for end in ("a", "b")))
        parts = staged(connected_components(edges, "a", "b"), "batch-parts")
        new = nodes.join(known.select("node"), "node", "left_anti").join(parts, "node")
        new.select("node", "component").write.mode("overwrite").parquet(f"{self.path}/keys/batch={batch}")
        moved = known.select(F.col("component").alias("node")).distinct().join(parts, "node").where("node <> component")
        moved.select(F.col("node").alias("old"), F.col("component").alias("new")).write.mode("overwrite").parquet(f"{self.path}/labels/batch={batch}")
        if self.compact and batch % self.compact == self.compact - 1:
            self._components(self._base(batch), batch + 1).write.mode("overwrite").parquet(f"{self.path}/base/upto={batch}")
            self.spark.range(1).select(F.lit(batch).cast("long").alias("upto")).write.mode("overwrite").parquet(f"{self.path}/folded/batch={batch}")

    def flowed(self, messages: DataFrame) -> DataFrame:
        """messages with the flow_id that the table gives them now; equal to `correlate` of all that was added."""
        return with_flows(messages, staged(self.components(), "stream-components"))

    def follow(self, messages: DataFrame, checkpoint: str):
        """A writer that adds every micro-batch of a stream of messages."""
        return messages.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
