"""Quotes as weak edges between flows: ordered merging that never puts two subscribers together, in Spark rounds.

In order, each quote joins the flows at its ends, unless both sides name subscribers
and together more than one. The rounds come to the same verdicts without replaying the
order, because of three facts. What a named component is called never changes: it only
takes in nameless ones and ones of the same single name. So a quote between two that
can't be joined is refused at any time. And the earliest open quote of a component
surely joins if the component is nameless, or if both ends are named alike: whatever
else happens before, nothing touches that component.

Each round settles what lies within one component ("already joined") or is refused, lets
every component that may commit its earliest quote, and contracts what was joined. Every
nameless component with an open quote commits, so a round at least halves them; a hub
with any number of quotes takes no more rounds than a chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.staging import shuffle_partitions, staged
from callweave.operators.components import connected_components

NONE = "array<string>"


def _numbered(quotes: DataFrame) -> DataFrame:
    """quotes with o, their place in the order frame, ts, seq (where there are such columns), a, b, looks."""
    order = [c for c in ("frame", "ts", "seq", "a", "b", "looks") if c in quotes.columns]
    held = quotes.repartitionByRange(shuffle_partitions(quotes.sparkSession), *order).sortWithinPartitions(*order)
    return staged(held.withColumn("o", F.monotonically_increasing_id()), "quotes")


def _renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """rows with the column's labels replaced by those that names (node, component) has for them."""
    held = rows.join(names.select(F.col("node").alias(column), F.col("component").alias("__new")), column, "left")
    return held.withColumn(column, F.coalesce("__new", column)).drop("__new")


def apply_quotes(quotes: DataFrame, flow_supis: DataFrame, max_rounds: int = 80) -> DataFrame:
    """quotes (frame, a, b: flows that a bound quote would join; ts, seq, looks if there are) with verdict, a_flow, b_flow.

    Verdicts: joined, already joined, refused; the final flow of each end is the
    least of its component. A quote with a missing end is left out. flow_supis:
    flow_id, supis.
    """
    given = _numbered(quotes.where("a is not null and b is not null"))
    now = given.select("o", F.col("a").alias("x"), F.col("b").alias("y"))
    ends = given.select(F.col("a").alias("node")).union(given.select("b")).distinct()
    labels = staged(ends.select("node", F.col("node").alias("component")), "quote-labels")
    people = flow_supis.select(F.col("flow_id").alias("component"), F.explode("supis").alias("s")).where("s is not null")
    names = people.join(ends.select(F.col("node").alias("component")), "component", "left_semi").groupBy("component").agg(F.array_sort(F.collect_set("s")).alias("supis"))
    names = staged(names, "quote-names")
    verdicts = []
    for _ in range(max_rounds):
        for end in ("x", "y"):
            now = now.join(names.select(F.col("component").alias(end), F.col("supis").alias(f"s{end}")), end, "left")
        named, other = F.col("sx").isNotNull(), F.col("sy").isNotNull()
        clash = named & other & (F.size(F.array_union("sx", "sy")) > 1)
        now = staged(now.withColumn("verdict", F.when(F.col("x") == F.col("y"), "already joined").when(clash, "refused")).select("o", "x", "y", named.alias("nx"), other.alias("ny"), "verdict"), "open-quotes")
        verdicts.append(now.where("verdict is not null").select("o", "verdict"))
        now = now.where("verdict is null").drop("verdict")
        if now.isEmpty():
            break
        sides = now.select(F.col("x").alias("c"), F.struct("o", F.col("nx").alias("own"), F.col("ny").alias("other"), "x", "y").alias("q")).union(now.select("y", F.struct("o", F.col("ny"), F.col("nx"), "x", "y")))
        first = sides.groupBy("c").agg(F.min("q").alias("q")).where("not q.own or q.other")
        joined = staged(first.select("q.o", "q.x", "q.y").distinct(), "joined-quotes")
        verdicts.append(joined.select("o", F.lit("joined").alias("verdict")))
        parts = connected_components(joined, "x", "y")
        parts = staged(parts.where("node <> component"), "quote-parts")
        left = now.join(joined.select("o"), "o", "left_anti").select("o", "x", "y")
        now = _renamed(_renamed(left, "x", parts), "y", parts)
        labels = staged(_renamed(labels, "component", parts), "quote-labels")
        names = staged(_renamed(names, "component", parts).groupBy("component").agg(F.first("supis").alias("supis")), "quote-names")
    else:
        raise RuntimeError("quotes were not settled")
    every = verdicts[0]
    for more in verdicts[1:]:
        every = every.union(more)
    out = given.join(every, "o")
    for end in ("a", "b"):
        out = out.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_flow")), end)
    kept = [c for c in ("frame", "ts", "seq", "a", "b", "looks") if c in quotes.columns]
    return out.select(*kept, "verdict", "a_flow", "b_flow")


def quote_totals(verdicts: DataFrame) -> DataFrame:
    """joined, refused, embedded: quotes that joined flows, that were refused, and that joined by a subscriber named inside a resource id. One row, zeros for nothing."""
    embedded = F.count_if((F.col("verdict") == "joined") & (F.col("looks") == "embedded")) if "looks" in verdicts.columns else F.lit(0).cast("long")
    return verdicts.agg(F.count_if(F.col("verdict") == "joined").alias("joined"), F.count_if(F.col("verdict") == "refused").alias("refused"), embedded.alias("embedded"))


def quoted_flows(flowed: DataFrame) -> DataFrame:
    """Quotes of messages with a flow, as flows that they would join: frame, ts, seq, a, b, looks. A quoted key that no message carries itself joins nothing."""
    name = lambda k: F.concat_ws("=", k["kind"], k["value"])
    owners = flowed.where("flow_id is not null").select("capture_id", F.explode("keys").alias("k"), "flow_id").select("capture_id", name(F.col("k")).alias("key"), F.col("flow_id").alias("b")).distinct()
    quotes = flowed.where("flow_id is not null and size(keys) > 0").select("capture_id", "frame", "ts", "seq", F.col("flow_id").alias("a"), F.explode("quotes").alias("q"))
    return quotes.withColumn("key", name(F.col("q"))).join(owners, ["capture_id", "key"]).select("frame", "ts", "seq", "a", "b", F.col("q.looks").alias("looks"))


def bridged(flowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with flow_id after their quotes were applied, the verdicts)."""
    people = flowed.where("flow_id is not null").select("flow_id", F.explode("keys").alias("k")).where("k.kind = 'supi'").groupBy("flow_id").agg(F.collect_set("k.value").alias("supis"))
    verdicts = staged(apply_quotes(quoted_flows(flowed), people), "quote-verdicts")
    final = verdicts.select(F.col("a").alias("flow_id"), F.col("a_flow").alias("__f")).union(verdicts.select("b", "b_flow")).distinct()
    held = flowed.join(final, "flow_id", "left").withColumn("flow_id", F.coalesce("__f", "flow_id"))
    return held.select(flowed.columns), verdicts
