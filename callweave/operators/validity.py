"""Valid time: during which interval a number, an address or a tunnel belongs to whom, and joins on that."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.staging import staged
from callweave.operators.pairing import asof_backward


def owned(sightings: DataFrame, by: list[str], owner: str, at: str, order: list[str], released: str | None = None) -> DataFrame:
    """by, owner, valid_from, valid_to: islands of sightings of a key with one owner.

    An island ends where the key is released (the releasing sighting still belongs
    to it) or seen with another owner; the last one of a key is open (valid_to null),
    as nothing says that it ended. Sightings without an owner say nothing. order: a
    total order in time, `at` first.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = sightings.where(F.col(owner).isNotNull())
    freed = F.coalesce(F.col(released), F.lit(False)) if released else F.lit(False)
    rows = rows.withColumn("__freed", freed)
    new = F.lag(owner).over(w).isNull() | (F.lag(owner).over(w) != F.col(owner)) | F.lag("__freed").over(w)
    rows = rows.withColumn("__new", new.cast("int")).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    made = rows.groupBy(*by, "__island").agg(F.first(owner).alias(owner), F.min(at).alias("valid_from"), F.max(F.when(F.col("__freed"), F.col(at))).alias("__end"))
    following = F.lead("valid_from").over(Window.partitionBy(*by).orderBy("__island"))
    return made.withColumn("valid_to", F.coalesce("__end", following)).select(*by, owner, "valid_from", "valid_to")


def owner_at(points: DataFrame, intervals: DataFrame, by: list[str], at: str, owner: str) -> DataFrame:
    """points with the owner of their key at their time, or null; an interval holds its start and its end.

    Intervals of a key don't overlap but at their ends, so the latest start decides: an
    as-of join, one union and one window.
    """
    held = intervals.select(*by, F.col("valid_from").alias(at), F.struct(owner, "valid_to").alias("__i"))
    got = asof_backward(points, held, by, at, ["__i"], strict=False)
    there = F.col("__i.valid_to").isNull() | (F.col(at) <= F.col("__i.valid_to"))
    return got.withColumn(owner, F.when(there, F.col(f"__i.{owner}"))).drop("__i")


def overlapping(spans: DataFrame, intervals: DataFrame, by: list[str], bucket: float, on: tuple[str, str] = ("start", "stop"), other: tuple[str, str] = ("valid_from", "valid_to")) -> DataFrame:
    """spans joined with the intervals of their key that overlap them, ends included; an open end reaches to the end of the data.

    Both sides are dealt to the time buckets that they touch, so the join is on
    equality and meets only what is near; a pair counts in the first bucket that it
    shares. A span or interval is in as many buckets as it is long: choose the
    bucket about as long as the shorter side usually is.
    """
    last = F.broadcast(spans.agg(F.max(on[1]).alias("__last")))  # one value
    place = lambda c: F.floor(c / F.lit(bucket)).cast("long")
    left = spans.withColumn("__first", place(F.col(on[0]))).withColumn("__b", F.explode(F.sequence(place(F.col(on[0])), place(F.col(on[1])))))
    end = F.coalesce(F.col(other[1]), F.greatest(F.col("__last"), F.col(other[0])))
    # Beyond the last span nothing can meet.
    right = intervals.join(last).where(F.col(other[0]) <= F.col("__last")).withColumn("__end", end).withColumn("__ifirst", place(F.col(other[0])))
    right = right.withColumn("__b", F.explode(F.sequence(F.col("__ifirst"), place(F.least("__end", "__last"))))).drop("__last")
    hit = left.join(right, [*by, "__b"]).where((F.col(other[0]) <= F.col(on[1])) & (F.col("__end") >= F.col(on[0])) & (F.col("__b") == F.greatest("__first", "__ifirst")))
    return hit.drop("__b", "__first", "__ifirst", "__end")


def counted_within(spans: DataFrame, points: DataFrame, by: list[str], at: str, name: str, on: tuple[str, str] = ("start", "stop")) -> DataFrame:
    """spans with how many points of their key lie in them, ends included: a difference of running counts, so no span meets its points.

    Ranges of (key, time) are counted apart and offset by the counts before them, so one
    key with all points is no single task.
    """
    keys = [F.col(b) for b in by]
    marks = spans.withColumn("__id", F.struct(*spans.columns))
    events = points.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__o"), F.lit(1).alias("__n"), F.lit(None).cast(marks.schema["__id"].dataType).alias("__id"), F.lit(0).alias("__s"))
    ends = marks.select(*keys, F.explode(F.array(F.struct(F.col(on[0]).alias("t"), F.lit(0).alias("o"), F.lit(-1).alias("s")), F.struct(F.col(on[1]).alias("t"), F.lit(2).alias("o"), F.lit(1).alias("s")))).alias("e"), "__id")
    ends = ends.select(*keys, F.col("e.t").alias("__t"), F.col("e.o").alias("__o"), F.lit(0).alias("__n"), "__id", F.col("e.s").alias("__s"))
    dealt = staged(events.unionByName(ends).repartitionByRange(*by, "__t", "__o").withColumn("__part", F.spark_partition_id()), "counted")
    counts = dealt.groupBy(*by, "__part").agg(F.sum("__n").alias("__m"))
    before = counts.select(*(F.col(b).alias(f"__{b}") for b in by), F.col("__part").alias("__p"), (F.sum("__m").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__m")).alias("__before"))
    w = Window.partitionBy(*by, "__part").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.withColumn("__c", F.sum("__n").over(w)).where("__s <> 0")
    sums = sums.join(before, reduce(and_, (F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by), F.col("__part") == F.col("__p")))
    return sums.groupBy("__id").agg(F.sum((F.col("__c") + F.col("__before")) * F.col("__s")).cast("long").alias("__count")).select("__id.*", F.col("__count").alias(name))


def values_of(kind: str, keys: Column) -> Column:
    return F.transform(F.filter(keys, lambda k: k["kind"] == kind), lambda k: k["value"])
