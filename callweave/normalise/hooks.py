"""What a normaliser may give beside its messages, checked and routed to where it takes effect."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.schema import KEY

Hook = Callable[[DataFrame], DataFrame]
#: Columns that each output must have; further ones are left out.
OUTPUTS = {
    # Content of an earlier message: its key and sender, and what to add to that message's detail.
    "continuations": "capture_id string, frame long, protocol string, key string, src_ip string, src_port int, detail map<string,string>",
    # A block of another protocol that this one carries, as that protocol's dissected layer.
    "carriers": "capture_id string, frame long, layer string, body variant",
    "blind_spots": "capture_id string, kind string, key string, n long",
    # Identity keys that a message gives back.
    "releases": f"capture_id string, frame long, protocol string, keys array<{KEY}>",
}
HOOKS: dict[str, dict[str, Hook]] = {}


@dataclass
class Outputs:
    """All messages of the frames, and what the hooks gave that isn't part of a message."""

    messages: DataFrame
    blind_spots: DataFrame | None = None
    continuations: DataFrame | None = field(default=None)


def register_hooks(name: str, **hooks: Hook) -> None:
    """Adds hooks to a registered protocol: functions of frames that give the tables of OUTPUTS."""
    for kind, hook in hooks.items():
        if kind not in OUTPUTS:
            raise ValueError(f"{name}: there is no hook {kind}; there are {', '.join(OUTPUTS)}")
        if not callable(hook):
            raise TypeError(f"{name}: {kind} takes frames and gives a table")
    HOOKS.setdefault(name, {}).update(hooks)


def checked(made: DataFrame, name: str, kind: str) -> DataFrame:
    """The output's columns in order and of the right types; an error names what is missing or of another type."""
    wanted = made.sparkSession.createDataFrame([], OUTPUTS[kind]).schema
    for f in wanted:
        if f.name not in made.columns:
            raise ValueError(f"{name}: {kind} lacks {f.name}")
        got = made.schema[f.name].dataType
        if got.simpleString() != f.dataType.simpleString() and got.simpleString() != "void":
            raise TypeError(f"{name}: {kind}.{f.name} is {got.simpleString()}, not {f.dataType.simpleString()}")
    return made.select(*(F.col(f.name).cast(f.dataType) for f in wanted))


def outputs_of(frames: DataFrame, names: list[str] | None, kind: str) -> DataFrame | None:
    """The union of what all registered hooks of a kind give."""
    every = None
    for name in sorted(HOOKS):
        if kind in HOOKS[name] and (names is None or name in names):
            one = checked(HOOKS[name][kind](frames), name, kind)
            every = one if every is None else every.unionByName(one)
    return every


def with_carried(frames: DataFrame, carried: DataFrame | None) -> DataFrame:
    """frames, and a frame of its own for each carried block: it has the carrying frame's number, ends and clocks, and the one layer.

    The registered job of that layer reads it like any other block (up to the depth
    that carriers themselves give; a carried block isn't asked for carriers again).
    """
    if carried is None:
        return frames
    held = carried.join(frames.drop("layers"), ["capture_id", "frame"])
    body = F.to_json(F.map_from_arrays(F.array("layer"), F.array("body")))
    return frames.unionByName(held.withColumn("layers", F.parse_json(body)).select(frames.columns))


def with_releases(messages: DataFrame, freed: DataFrame | None) -> DataFrame:
    """messages with the released keys added to the first message of that protocol in the frame."""
    if freed is None:
        return messages
    each = freed.select("capture_id", "frame", "protocol", F.explode("keys").alias("k")).groupBy("capture_id", "frame", "protocol").agg(F.array_sort(F.collect_set("k")).alias("__freed"))
    first = messages.groupBy("capture_id", "frame", "protocol").agg(F.min("seq").alias("seq"))
    place = first.join(each, ["capture_id", "frame", "protocol"])
    held = messages.join(place, ["capture_id", "frame", "protocol", "seq"], "left")
    return held.withColumn("releases", F.when(F.col("__freed").isNotNull(), F.array_union("releases", "__freed")).otherwise(F.col("releases"))).select(messages.columns)


def with_continuations(messages: DataFrame, found: DataFrame | None) -> DataFrame:
    """messages with the detail that later frames of the same key and sender brought; what a message says itself stays."""
    from callweave.operators.pairing import late_body_attach

    if found is None:
        return messages
    keyed = messages.select("capture_id", "protocol", F.explode("keys.value").alias("key"), F.col("src.ip").alias("src_ip"), F.col("src.port").alias("src_port"), "frame").distinct()
    entries = late_body_attach(found.select("capture_id", "protocol", "key", "src_ip", "src_port", "frame", F.map_entries("detail").alias("e")), keyed).where("target_frame is not null")
    one = entries.select("capture_id", "protocol", "key", F.col("target_frame").alias("frame"), F.col("frame").alias("__from"), F.explode("e").alias("e"))
    best = one.groupBy("capture_id", "protocol", "frame", "key", F.col("e.key").alias("name")).agg(F.min_by("e.value", "__from").alias("v"))
    more = best.groupBy("capture_id", "protocol", "frame", "key").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("__more"))
    place = messages.select("capture_id", "protocol", "frame", "seq", F.explode("keys.value").alias("key")).join(more, ["capture_id", "protocol", "frame", "key"])
    place = place.groupBy("capture_id", "protocol", "frame", "seq").agg(F.min_by("__more", "key").alias("__more"))
    held = messages.join(place, ["capture_id", "protocol", "frame", "seq"], "left")
    new = F.map_filter("__more", lambda k, _: ~F.map_contains_key("detail", k))
    return held.withColumn("detail", F.when(F.col("__more").isNotNull(), F.map_concat("detail", new)).otherwise(F.col("detail"))).select(messages.columns)
