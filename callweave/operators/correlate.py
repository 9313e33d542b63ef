"""Who is the same subscriber: flows, episodes, quotes, audits, subscriber groups, call legs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.staging import staged
from callweave.operators.components import connected_components
from callweave.operators.quotes import apply_quotes as apply_quotes
from callweave.operators.rollups import exchange_only
from callweave.schema import REUSABLE, ROW, SOLITARY, SUBSCRIBER

#: Kinds that may bridge by reuse, left out by the audit.
BRIDGING = ("s_tmsi", "gtpv2_transaction")
#: Reusable kinds whose keys meet others of their message.
ASSOCIATING = frozenset(REUSABLE) - frozenset(SOLITARY)


def edges_of(messages: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """(least key, other key) of each message; keys carry their capture."""
    keys = F.transform(F.filter("keys", lambda k: ~k["kind"].isin(*without)) if without else F.col("keys"), lambda k: F.concat_ws("=", k["kind"], k["value"]))
    rows = messages.select("capture_id", keys.alias("keys")).where(F.size("keys") > 0)
    rows = rows.select(F.concat_ws("|", "capture_id", F.array_min("keys")).alias("a"), "capture_id", F.explode("keys").alias("b"))
    return rows.select("a", F.concat_ws("|", "capture_id", "b").alias("b")).distinct()


def correlate(messages: DataFrame) -> DataFrame:
    """messages with flow_id: the least key of the connected component, null for keyless and exchange-only ones.

    Keyless rows never enter the joins on keys. Components of exchange keys
    alone share the null flow.
    """
    # The edges are read twice, by the rounds and for the nodes; staged, they cost one pass over the messages.
    edges = staged(edges_of(messages), "edges_of_keys")
    return with_flows(messages, staged(connected_components(edges, "a", "b"), "components"))


def with_flows(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """messages with flow_id from their keys' components (node, component)."""
    kinds = parts.withColumn("kind", F.regexp_extract("node", r"^[^|]*\|([^=]*)=", 1))
    worthy = kinds.groupBy("component").agg(F.max(~F.col("kind").isin("sbi_stream", "h248_transaction", "gtpv2_transaction")).alias("worthy")).where("worthy").select("component")
    flows = staged(parts.join(worthy, "component").select("node", F.col("component").alias("flow_id")), "flows")
    keyed = messages.where(F.size("keys") > 0).withColumn("__k", F.concat_ws("|", "capture_id", F.array_min(F.transform("keys", lambda k: F.concat_ws("=", k["kind"], k["value"])))))
    keyed = keyed.join(flows, keyed["__k"] == flows["node"], "left").drop("__k", "node")
    return keyed.unionByName(messages.where("keys is null or size(keys) = 0").withColumn("flow_id", F.lit(None).cast("string")))


def flow_order(flowed: DataFrame) -> DataFrame:
    """Flows ordered by their first (ts, frame): capture_id, flow_id, place. Ranges are sorted apart and offset by the counts before them."""
    first = flowed.where("flow_id is not null").groupBy("capture_id", "flow_id").agg(F.min(F.struct("ts", "frame")).alias("first"))
    dealt = staged(first.repartitionByRange("capture_id", "first", "flow_id").withColumn("part", F.spark_partition_id()), "flow_order")
    counts = dealt.groupBy("capture_id", "part").agg(F.count("*").alias("n"))
    before = counts.select("capture_id", "part", (F.sum("n").over(Window.partitionBy("capture_id").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("capture_id", "part").orderBy("first", "flow_id")) + F.col("before")
    return dealt.join(before, ["capture_id", "part"]).select("capture_id", "flow_id", place.cast("int").alias("place"))


def supi_bridges(flowed: DataFrame) -> DataFrame:
    """Flows with two SUPIs or more that fall apart without the bridging kinds: flow_id, supis, parts."""
    keys = flowed.where("flow_id is not null").select("flow_id", "capture_id", F.explode("keys").alias("k"))
    many = staged(keys.where("k.kind = 'supi'").groupBy("flow_id").agg(F.count_distinct("k.value").alias("supis")).where("supis > 1"), "many_supis")
    suspects = flowed.join(many.select("flow_id"), "flow_id", "left_semi")
    parts = connected_components(edges_of(suspects, BRIDGING), "a", "b")
    owner = suspects.select("flow_id", F.explode("keys").alias("k"), "capture_id").select("flow_id", F.concat_ws("|", "capture_id", F.concat_ws("=", "k.kind", "k.value")).alias("node")).distinct()
    roots = owner.where(F.col("node").contains("|supi=")).join(parts, "node", "left").groupBy("flow_id").agg(F.count_distinct(F.coalesce("component", "node")).alias("parts"))
    return many.join(roots, "flow_id").where("parts > 1")


def subscriber_groups(flowed: DataFrame) -> DataFrame:
    """capture_id, flow_id, subscriber: flows that share a subscriber-class key."""
    keys = flowed.where("flow_id is not null").select("capture_id", "flow_id", F.explode("keys").alias("k")).where(F.col("k.kind").isin(*SUBSCRIBER))
    edges = keys.select("capture_id", "flow_id", F.concat_ws("|", F.lit("~"), "capture_id", F.concat_ws("=", "k.kind", "k.value")).alias("key")).distinct()
    parts = connected_components(edges, "flow_id", "key")
    return edges.select("capture_id", "flow_id").distinct().join(parts, F.col("flow_id") == F.col("node")).select("capture_id", "flow_id", F.col("component").alias("subscriber"))


class Episodes:
    """The state of one component: episodes of its reusable keys, which of them meet, and which an anchor carried.

    A message belongs to the episode before its own releases. The release of a
    reusable key ends the episode of all that it met, directly or by others. An
    anchor, such as a call, is not used again itself: its release ends the episode
    of the reusable keys that its messages carried, and of no other.
    """

    def __init__(self, anchors: tuple[str, ...] | None = None):
        """anchors: kinds that are released and not used again, if they are known; else any may be."""
        self.anchors = anchors
        self.episode: dict[tuple, int] = {}
        self.met: dict[tuple, set] = {}
        self.carried: dict[tuple, set] = {}

    def _end(self, keys: set) -> None:
        for k in keys:
            self.episode[k] = self.episode.get(k, 0) + 1
            for other in self.met.pop(k, ()):
                self.met.get(other, set()).discard(k)

    def step(self, keys: list[tuple], releases: list[tuple]) -> list[tuple]:
        """The message's keys with their episodes."""
        out = [(k[0], f"{k[1]}@{self.episode[k] + 1}") if k in self.episode else k for k in keys]
        pairing = {k for k in keys if k[0] in ASSOCIATING}
        if len(pairing) > 1:
            for k in pairing:
                self.met.setdefault(k, set()).update(pairing - {k})
        if pairing:
            for k in keys:
                if k[0] not in REUSABLE and (self.anchors is None or k[0] in self.anchors):
                    self.carried.setdefault(k, set()).update(pairing)
        if releases:
            ended, queue = set(), [k for k in releases if k[0] in REUSABLE]
            while queue:
                k = queue.pop()
                if k not in ended:
                    ended.add(k)
                    queue += self.met.get(k, ())
            self._end(ended)
            for k in releases:
                if k[0] not in REUSABLE:
                    self._end(self.carried.pop(k, set()))
        return out


def _lists(column: pa.ListArray) -> tuple[list[int], list[tuple]]:
    """Offsets and (kind, value) of a column of keys; a null list is empty."""
    ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.list_value_length(column), 0)).to_pylist()
    held = column.flatten()
    return [0, *ends], list(zip(held.field("kind").to_pylist(), held.field("value").to_pylist(), strict=True))


def assign_episodes(messages: DataFrame) -> DataFrame:
    """Reusable keys rewritten per episode. Without any release the input comes back.

    Only messages connected to a released key, or to an anchor of a kind that is
    released, are replayed: dealt and sorted by component and frame, in one pass
    over the batches that keeps the keys of the current component, never its
    messages. Solitary kinds never associate, so theirs is a running count of
    earlier releases. Every column goes through the replay: give only those needed.
    """
    freed = messages.where("size(releases) > 0").select(F.explode("releases.kind").alias("kind")).distinct()
    kinds = sorted(r[0] for r in freed.collect())  # of a fixed list of kinds
    if not kinds:
        return messages
    associating = [k for k in REUSABLE if k not in SOLITARY] + [k for k in kinds if k not in REUSABLE]
    held = messages.withColumn("__r", F.filter(F.concat("keys", "releases"), lambda k: k["kind"].isin(*associating)))
    some = held.where(F.size("__r") > 0)
    name = lambda k: F.concat_ws("|", "capture_id", F.concat_ws("=", k["kind"], k["value"]))
    nodes = some.select(*ROW, F.transform("__r", name).alias("n"))
    parts = staged(connected_components(nodes.select(F.array_min("n").alias("a"), F.explode("n").alias("b")).distinct(), "a", "b"), "episode_parts")
    tagged = some.withColumn("__n", F.array_min(F.transform("__r", name))).join(parts, F.col("__n") == F.col("node"))
    live = staged(tagged.where(F.size("releases") > 0).select("component").distinct(), "released")
    cols = messages.columns
    place = cols.index("keys")
    anchors = tuple(k for k in kinds if k not in REUSABLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, state = None, Episodes(anchors)
        for batch in batches:
            column = batch.column("keys")
            at, keys = _lists(column)
            freed_at, freed = _lists(batch.column("releases"))
            made = []
            for n, c in enumerate(batch.column("component").to_pylist()):
                if c != component:
                    component, state = c, Episodes(anchors)
                own, ended = keys[at[n] : at[n + 1]], freed[freed_at[n] : freed_at[n + 1]]
                # Solitary kinds are counted over all messages, below.
                named = iter(state.step([k for k in own if k[0] not in SOLITARY], [k for k in ended if k[0] not in SOLITARY]))
                made += [k if k[0] in SOLITARY else next(named) for k in own]
            out = batch.select(cols)
            kind = out.schema.field(place).type
            held = pa.StructArray.from_arrays([pa.array([k for k, _ in made], pa.string()), pa.array([v for _, v in made], pa.string())], fields=list(kind.value_type))
            yield out.set_column(place, out.schema.field(place), pa.ListArray.from_arrays(pa.array(at, pa.int32()), held, type=kind))

    dealt = tagged.join(live, "component", "left_semi").select(*cols, "component").repartition("component").sortWithinPartitions("component", "frame", "ts", "seq")
    replayed = dealt.mapInArrow(run, messages.schema)
    rest = tagged.join(live, "component", "left_anti").select(cols).unionByName(held.where(F.size("__r") == 0).select(cols))
    # Staged: a plan that reads the episodes again would replay them again, even to learn that a column of them is empty.
    return _solitary(staged(replayed.unionByName(rest), "episodes"))


def _solitary(messages: DataFrame) -> DataFrame:
    each = messages.select(*ROW, "ts", F.posexplode("keys").alias("i", "k"), "releases").where(F.col("k.kind").isin(*SOLITARY))
    if each.isEmpty():
        return messages
    freed = F.exists("releases", lambda r: r == F.col("k")).cast("int")
    w = Window.partitionBy("capture_id", "k").orderBy("frame", "ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    count = each.withColumn("f", freed).withColumn("n", F.coalesce(F.sum("f").over(w), F.lit(0))).where("n > 0")
    new = count.groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("__e"))
    joined = messages.join(new, list(ROW), "left")
    keys = F.transform("keys", lambda k, i: F.when(F.try_element_at("__e", i).isNotNull(), k.withField("value", F.concat_ws("@", k["value"], F.try_element_at("__e", i) + 1))).otherwise(k))
    return joined.withColumn("keys", F.when(F.col("__e").isNotNull(), keys).otherwise(F.col("keys"))).drop("__e")


def merge_legs(legs: DataFrame) -> DataFrame:
    """Legs (capture_id, leg, icid, start, end) -> call: legs of one ICID that overlap in time; no ICID: a call each."""
    w = Window.partitionBy("capture_id", "icid").orderBy("start", "end", "leg")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    with_id = legs.where("icid is not null").withColumn("__new", F.when(F.col("start") <= reach, 0).otherwise(1))
    with_id = with_id.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")
    with_id = with_id.withColumn("call", F.concat_ws("#", "icid", "island")).drop("island")
    return with_id.unionByName(legs.where("icid is null").withColumn("call", F.concat_ws("#", F.lit("leg"), "leg")))


def call_totals(calls: DataFrame) -> DataFrame:
    """Per capture: calls, legs, and calls of more than one leg."""
    each = calls.groupBy("capture_id", "call").agg(F.count("*").alias("legs"))
    return each.groupBy("capture_id").agg(F.count("*").alias("calls"), F.sum("legs").alias("legs"), F.count_if(F.col("legs") > 1).alias("merged"))


def closure(start: DataFrame, links: DataFrame, max_rounds: int = 20) -> DataFrame:
    """(call, key) extended over links (a, b) until nothing new is reached."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    reached, fresh = staged(start.select("call", "key").distinct(), "reached"), None
    fresh = reached
    for _ in range(max_rounds):
        step = fresh.join(both, fresh["key"] == both["a"]).select("call", F.col("b").alias("key")).distinct()
        fresh = staged(step.join(reached, ["call", "key"], "left_anti"), "fresh")
        if fresh.isEmpty():
            return reached
        reached = staged(reached.unionByName(fresh), "reached")
    raise RuntimeError("the closure did not end")


def keyless(messages: DataFrame) -> DataFrame:
    """Rows of the null flow: without keys, or with exchange keys only."""
    return messages.where(F.col("keys").isNull() | (F.size("keys") == 0) | exchange_only(F.col("keys")))
