"""Valid time, cascades, latency and hooks: hand cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from callweave import normalise
from callweave.normalise import hooks
from callweave.operators import calls, latency, links, pairing, validity
from callweave.schema import MESSAGES
from tests.test_ordered_streams import message
from tests.test_rules import frame


def test_islands_end_at_a_release_or_another_owner(spark):
    rows = [("k", "a", 1, False), ("k", "a", 2, True), ("k", "a", 5, False), ("k", None, 6, False), ("k", "b", 7, False), ("k", "b", 8, None), ("j", "b", 3, True)]
    table = spark.createDataFrame(rows, "key string, owner string, at int, freed boolean")
    held = validity.owned(table, ["key"], "owner", "at", ["at"], "freed")
    assert sorted(map(tuple, held.collect())) == [("j", "b", 3, 3), ("k", "a", 1, 2), ("k", "a", 5, 7), ("k", "b", 7, None)]
    points = spark.createDataFrame([("k", t) for t in range(10)] + [("j", 3), ("j", 4), ("x", 1)], "key string, at int")
    got = {(r.key, r.at): r.owner for r in validity.owner_at(points, held, ["key"], "at", "owner").collect()}
    assert got == {**{("k", t): o for t, o in enumerate([None, "a", "a", None, None, "a", "a", "b", "b", "b"])}, ("j", 3): "b", ("j", 4): None, ("x", 1): None}


@pytest.mark.parametrize("bucket", [0.5, 7.0, 1000.0])
def test_overlaps_and_counts_equal_brute_force(spark, bucket):
    r = random.Random(8)
    spans = [(r.choice("ab"), n, *sorted(r.sample(range(100), 2))) for n in range(30)] + [("a", 99, 5, 5)]
    held = [(r.choice("abc"), f"i{n}", s, r.choice([None, s, s + r.randrange(30)])) for n in range(30) for s in [r.randrange(100)]]
    left = spark.createDataFrame([(k, n, float(a), float(b)) for k, n, a, b in spans], "key string, n int, start double, stop double")
    right = spark.createDataFrame([(k, i, float(a), None if b is None else float(b)) for k, i, a, b in held], "key string, i string, valid_from double, valid_to double")
    got = [(x.n, x.i) for x in validity.overlapping(left, right, ["key"], bucket).collect()]
    want = [(n, i) for k, n, a, b in spans for q, i, s, e in held if k == q and s <= b and (e is None or e >= a)]
    assert sorted(got) == sorted(want)
    points = right.select("key", F.col("valid_from").alias("at"))
    counted = {x.n: x.c for x in validity.counted_within(left, points, ["key"], "at", "c").collect()}
    assert counted == {n: sum(1 for q, _, s, _ in held if q == k and a <= s <= b) for k, n, a, b in spans}


def test_each_row_is_used_once_in_the_first_stage_that_fits(spark):
    d = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        message(1, 1, label="A Request", protocol="diameter", detail=d(hop_by_hop_id="1", end_to_end_id="9")), message(2, 2, label="A Answer", protocol="diameter", detail=d(hop_by_hop_id="1", end_to_end_id="8")),
        message(3, 3, label="A Request", protocol="diameter", detail=d(hop_by_hop_id="2", end_to_end_id="7")), message(4, 4, label="A Answer", protocol="diameter", detail=d(hop_by_hop_id="3", end_to_end_id="7")),
        message(5, 5, label="A Answer", protocol="diameter", detail=d(end_to_end_id="9")), message(6, 6, label="A Request", protocol="diameter"), message(7, 7, label="A Request", protocol="diameter", detail=d(hop_by_hop_id="1")),
    ]
    got = pairing.diameter_legs(spark.createDataFrame(rows, MESSAGES)).collect()
    assert sorted(((x.request_frame, x.answer_frame, x.stage) for x in got), key=str) == sorted([(1, 2, "hop"), (3, 4, "end"), (None, 5, "loose"), (6, None, "loose"), (7, None, "loose")], key=str)


def test_slices_sum_to_the_duration(spark):
    r = random.Random(9)
    procedures, legs = [], []
    for p in range(25):
        a = r.randrange(50)
        z = a + r.randrange(60)
        procedures.append((p, a, z))
        for n in range(r.randrange(6)):
            s = r.randrange(-10, 110)
            legs.append((p, f"l{n % 4}", s, s + r.randrange(40)))
    legs.append((999, "x", 1, 2))
    got = latency.latency_slices(spark.createDataFrame(procedures, "p int, start_us long, stop_us long"), spark.createDataFrame(legs, "p int, leg string, start_us long, stop_us long"), ["p"]).collect()
    want = {}
    for p, a, z in procedures:
        for t in range(a, z):
            over = [(-max(s, a), min(e, z), leg) for q, leg, s, e in legs if q == p and max(s, a) <= t < min(e, z)]
            leg = min(over)[2] if over else latency.IDLE
            want[p, leg] = want.get((p, leg), 0) + 1
    assert {(x.p, x.leg): x.micros for x in got} == want
    total = {p: z - a for p, a, z in procedures if z > a}
    assert all(abs(sum(x.share for x in got if x.p == p) - 1) < 1e-9 for p in total)


def test_addresses_and_sessions_change_hands(spark):
    ip = lambda f, t, supi, label="x": message(f, t, label=label, keys=[("supi", supi)], detail={"ue-ipv4": "10.1.1.1"})
    rows = [ip(1, 10, "1"), ip(2, 20, "1", "PDU Session Release Complete"), ip(3, 40, "2")]
    table = spark.createDataFrame(rows, MESSAGES)
    at = spark.createDataFrame([("c", "10.1.1.1", float(t)) for t in (5, 15, 30, 50)] + [("d", "10.1.1.1", 15.0)], "capture_id string, address string, ts double")
    got = {(x.capture_id, x.ts): x.supi for x in links.subscriber_of_address(at, table).collect()}
    assert got == {("c", 5.0): None, ("c", 15.0): "1", ("c", 30.0): None, ("c", 50.0): "2", ("d", 15.0): None}
    teid = ("gtp_teid", "9/1")
    rows = [message(1, 1, keys=[("supi", "1"), teid], detail={"pdu-session-id": "5", "gtp-teid-owner": "gnb"}), message(2, 2, protocol="pfcp", keys=[teid]), message(3, 3, protocol="gtp", keys=[teid]), message(4, 4, keys=[("supi", "2"), teid], detail={"pdu-session-id": "6"}), message(5, 5, protocol="gtp", keys=[teid]), message(6, 0.5, protocol="gtp", keys=[teid])]
    got = links.session_messages(spark.createDataFrame(rows, MESSAGES)).collect()
    assert sorted((x.supi, x.pdu_id, x.frame, x.side) for x in got) == [("1", "5", 2, "gnb"), ("1", "5", 3, "gnb"), ("2", "6", 5, "upf")]


def test_a_call_is_put_together(spark):
    media, context = ("media_endpoint", "9/1"), ("h248_context", "g/1")
    sip = lambda f, t, label="x", **d: (*message(f, t, label=label, protocol="sip", keys=[media], detail=d), "call", "f1")
    other = lambda f, t, p, keys=(), flow="f2", **d: (*message(f, t, protocol=p, keys=keys, detail={k.replace("_", "-"): v for k, v in d.items()}), None, flow)
    rows = [
        sip(1, 10, "INVITE", icid="i", From="sip:+15550000001@x"), sip(9, 90), other(2, 200, "megaco", [media, context]), other(3, 300, "megaco", [context]), other(4, 400, "diameter", session_id="s", icid="i"), other(5, 20, "diameter", session_id="s", flow="f5"),
        other(6, 30, "enum", [("msisdn", "+15550000001")], "f6"), other(7, 99, "diameter", [("msisdn", "+15550000001")], "f6"), other(8, 50, "diameter", session_id="z", flow=None), other(10, 91, "diameter", session_id="z", flow=None),
    ]
    ways, left = calls.assembled_calls(spark.createDataFrame(rows, MESSAGES + ", call string, flow_id string"))
    assert {x.frame: x.way for x in ways.collect()} == {1: "signalling", 9: "signalling", 2: "media", 3: "media", 4: "charging", 5: "charging", 6: "number"}
    assert [tuple(x) for x in left.collect()] == [("c", "call", 1)]


def test_a_normaliser_gives_more_than_messages(spark, tmp_path):
    body = {"pfcp_pfcp_msg_type": "52", "pfcp_pfcp_seid": ["0x7", "0x0"]}
    lines = [frame(1, {"lab": {"op": "start", "id": "7", "inner": body}}), frame(2, {"lab": {"op": "more", "id": "7", "dnn": "internet", "op2": "x"}}), frame(3, {"lab": {"op": "stop", "id": "7"}}), frame(4, {"lab": {"op": "secret"}})]
    (tmp_path / "a.ndjson").write_text("\n".join(lines))
    core, where = normalise.core, lambda rows, op: rows.where(core.text("op") == op)
    rows = lambda frames: core.blocks(frames, "lab")
    tunnel = lambda: core.key("pfcp_seid", F.concat(F.lit("lab/"), core.text("id")))

    def job(frames):
        return core.messages(rows(frames).where(core.text("op").isin("start", "stop")), "lab", core.text("op"), F.array(tunnel()), F.lit(False), core.details(op=core.text("op")))

    normalise.register("lab", 90, job)
    try:
        hooks.register_hooks(
            "lab",
            continuations=lambda f: where(rows(f), "more").select("capture_id", "frame", F.lit("lab").alias("protocol"), F.concat(F.lit("lab/"), core.text("id")).alias("key"), "src_ip", "src_port", core.details(dnn=core.text("dnn"), op=core.text("op2")).alias("detail")),
            carriers=lambda f: rows(f).withColumn("body", F.try_variant_get("b", "$.inner", "variant")).where("body is not null").select("capture_id", "frame", F.lit("pfcp").alias("layer"), "body"),
            blind_spots=lambda f: where(rows(f), "secret").groupBy("capture_id").agg(F.count("*").alias("n")).select("capture_id", F.lit("sealed-lab").alias("kind"), F.lit(None).cast("string").alias("key"), "n"),
            releases=lambda f: where(rows(f), "stop").select("capture_id", "frame", F.lit("lab").alias("protocol"), F.array(tunnel()).alias("keys")),
        )
        made = normalise.normalise_all(normalise_frames(spark, tmp_path), ["lab", "pfcp"])
        got = {(x.frame, x.protocol): x for x in made.messages.collect()}
        assert set(got) == {(1, "lab"), (1, "pfcp"), (3, "lab")}
        assert got[1, "lab"].detail == {"op": "start", "dnn": "internet"} and got[3, "lab"].detail == {"op": "stop"}
        assert [k.value for k in got[3, "lab"].releases] == ["lab/7"] and got[1, "lab"].releases == [] and len(got[1, "pfcp"]["keys"]) == 1
        assert [(x.kind, x.n) for x in made.blind_spots.collect()] == [("sealed-lab", 1)]
        with pytest.raises(ValueError, match="there is no hook"):
            hooks.register_hooks("lab", sniff=lambda f: f)
        hooks.register_hooks("lab", releases=lambda f: rows(f).select("capture_id", "frame"))
        with pytest.raises(ValueError, match="releases lacks protocol"):
            normalise.normalise_all(normalise_frames(spark, tmp_path), ["lab"])
        hooks.register_hooks("lab", releases=lambda f: rows(f).select("capture_id", F.lit("1").alias("frame"), F.lit("p").alias("protocol"), F.lit("k").alias("keys")))
        with pytest.raises(TypeError, match="releases.frame is string"):
            normalise.normalise_all(normalise_frames(spark, tmp_path), ["lab"])
    finally:
        del normalise.REGISTRY["lab"], hooks.HOOKS["lab"]


def normalise_frames(spark, folder):
    from callweave.sources import readers

    return readers.read_frames(spark, str(folder / "a.ndjson"))
