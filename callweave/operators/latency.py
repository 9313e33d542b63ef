"""Where the time of a procedure goes: to the innermost request that is open, else to nobody."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a slice belongs to while no request is open.
IDLE = "between requests"


class Sweep:
    """Open intervals of one procedure; each stretch of time goes to the one that was opened last and still waits."""

    def __init__(self):
        self.open: list[tuple] = []
        self.at: int | None = None
        self.spent: dict[str, int] = {}

    def until(self, t: int) -> None:
        """The time up to t, cut wherever the innermost interval ends."""
        while self.at is not None and self.at < t:
            while self.open and self.open[0][2] <= self.at:
                heapq.heappop(self.open)
            leg, end = (self.open[0][3], min(t, self.open[0][2])) if self.open else (IDLE, t)
            self.spent[leg] = self.spent.get(leg, 0) + end - self.at
            self.at = end
        self.at = t if self.at is None else max(self.at, t)

    def add(self, start: int, stop: int, leg: str) -> None:
        self.until(start)
        # The latest start first; of equal ones the one that ends first lies inside.
        heapq.heappush(self.open, (-start, stop, stop, leg))


def latency_slices(procedures: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """by, leg, micros, share: how long each leg was what a procedure waited for. The legs' times sum up to its duration.

    procedures: by, start_us, stop_us. intervals: by, leg, start_us, stop_us, of
    requests and their answers, cut to the procedure. Where requests lie inside each
    other the innermost has the time; with equal starts the one that ends first. A
    sweep over starts in order holds the intervals that are open, never a whole
    procedure. A procedure without requests has all its time between requests;
    intervals without a procedure are left out.
    """
    # The procedure itself is the first row of its sweep: kind 0 opens it, kind 2 closes it.
    bounds = procedures.select(*by, F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(0).alias("kind")), F.struct(F.col("stop_us").alias("t"), F.lit(2).alias("kind")))).alias("e")).select(*by, "e.t", "e.kind", F.lit(None).cast("string").alias("leg"), F.lit(None).cast("long").alias("stop"))
    cut = intervals.join(procedures.select(*by, F.col("start_us").alias("__s"), F.col("stop_us").alias("__e")), by)
    cut = cut.select(*by, F.greatest("start_us", "__s").alias("t"), F.lit(1).alias("kind"), "leg", F.least("stop_us", "__e").alias("stop")).where("t < stop")
    rows = bounds.unionByName(cut).withColumn("__by", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    dealt = rows.select("__by", "t", "kind", "leg", "stop").repartition("__by").sortWithinPartitions("__by", "t", "kind", "leg", "stop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sweep()
        for batch in batches:
            names, legs, spent = [], [], []
            for name, t, kind, leg, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    state = Sweep()
                    state.until(t)
                elif kind == 1:
                    state.add(t, stop, leg)
                else:
                    state.until(t)
                    names += [name] * len(state.spent)
                    legs += state.spent
                    spent += state.spent.values()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(legs, pa.string()), pa.array(spent, pa.int64())], ["__by", "leg", "micros"])

    got = dealt.mapInArrow(run, "__by string, leg string, micros long")
    kind = procedures.select(*by).schema
    held = got.withColumn("k", F.from_json("__by", kind)).select("k.*", "leg", "micros")
    whole = procedures.select(*by, (F.col("stop_us") - F.col("start_us")).alias("__all"))
    return held.join(whole, by).select(*by, "leg", "micros", F.try_divide(F.col("micros").cast("double"), F.col("__all")).alias("share"))
