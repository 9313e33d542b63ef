"""Normalisers: dissected frames -> messages, a Spark job per protocol, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from callweave.normalise import core, hooks

#: name -> (order, job). Order gives a message its place in a frame.
REGISTRY: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]] = {}


def register(name: str, order: int, job: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a protocol. A name can't be taken twice, and the job must be callable."""
    if name in REGISTRY:
        raise ValueError(f"{name} is registered already")
    if not callable(job):
        raise TypeError(f"{name}: the job takes frames and returns messages")
    REGISTRY[name] = order, job


def normalise(frames: DataFrame, names: list[str] | None = None) -> DataFrame:
    """All messages of the frames, in the total order capture, frame, seq."""
    chosen = sorted((order, name, job) for name, (order, job) in REGISTRY.items() if names is None or name in names)
    out = None
    for order, name, job in chosen:
        made = core.checked(job(frames), name).withColumn("__order", core.F.lit(order))
        out = made if out is None else out.unionByName(made)
    return core.sequenced(out)


def normalise_all(frames: DataFrame, names: list[str] | None = None) -> hooks.Outputs:
    """Messages with everything that hooks give: carried blocks are read by their own protocols, releases and continuations are
    part of the messages, and blind spots are counted together with those of ciphered and undecoded blocks."""
    whole = hooks.with_carried(frames, hooks.outputs_of(frames, names, "carriers"))
    made = hooks.with_releases(normalise(whole, names), hooks.outputs_of(frames, names, "releases"))
    later = hooks.outputs_of(frames, names, "continuations")
    spots, more = nas.blind_spots(frames), hooks.outputs_of(frames, names, "blind_spots")
    if more is not None:
        spots = spots.unionByName(more).groupBy("capture_id", "kind", "key").agg(core.F.sum("n").alias("n"))
    return hooks.Outputs(hooks.with_continuations(made, later), spots, later)


from callweave.normalise import access, core_network, ims, nas, sbi  # noqa: E402

for _n, _o, _j in (("ngap", 10, access.ngap), ("s1ap", 11, access.s1ap), ("gtpv2", 13, core_network.gtpv2), ("sbi", 15, sbi.sbi), ("nas-5gs", 20, nas.nas5gs), ("nas-eps", 21, nas.naseps), ("sip", 25, ims.sip), ("megaco", 30, ims.megaco), ("diameter", 35, core_network.diameter), ("sgsap", 36, access.sgsap), ("enum", 37, ims.enum), ("pfcp", 40, core_network.pfcp), ("gtp", 50, core_network.gtp)):
    register(_n, _o, _j)
