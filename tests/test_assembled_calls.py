"""Calls of one number at different times: their joins grow with the calls, not with the pairs of calls and flows."""

from callweave.operators import calls, validity
from callweave.schema import MESSAGES
from tests.test_ordered_streams import message

NUMBER, HOUR = "+15550000001", 3600.0


def rows_of_joins(df):
    """df's rows, and how many the largest join made."""
    rows, most, plans = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        node = plans.pop()
        name = node.getClass().getSimpleName()
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ReusedExchangeExec": "child"}.get(name, "plan" if name.endswith("QueryStageExec") else None)
        if inner:
            plans.append(getattr(node, inner)())
            continue
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        plans += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def at_hours(n, session=None):
    """A call an hour with two SIP messages, and a flow an hour that owns the caller's number, with a message inside the call and one after it."""
    rows = []
    for h in range(n):
        sip = lambda f, t, label, h=h, **d: (*message(f, h * HOUR + t, label=label, protocol="sip", detail=d), f"call{h}", f"s{h}")
        asked = lambda f, t, h=h: (*message(f, h * HOUR + t, protocol="diameter", keys=[("msisdn", NUMBER)], detail={"session-id": session or f"z{h}"}), None, f"f{h}")
        rows += [sip(h * 10, 0, "INVITE", icid=f"i{h}", From=f"sip:{NUMBER}@x"), sip(h * 10 + 1, 60, "BYE"), asked(h * 10 + 2, 30), asked(h * 10 + 3, 90)]
    return rows


def test_calls_meet_flows_of_their_number_in_their_time_only(spark):
    n = 120
    ways = calls.messages_of_calls(spark.createDataFrame(at_hours(n), MESSAGES + ", call string, flow_id string"), HOUR)
    rows, most = rows_of_joins(ways)
    assert {(x.call, x.frame): x.way for x in rows} == {(f"call{h}", h * 10 + k): "number" if k == 2 else "signalling" for h in range(n) for k in range(3)}
    assert most <= 4 * n


def test_a_message_of_several_ways_is_there_once(spark):
    rows = [(*message(900, 10, protocol="diameter", keys=[("msisdn", NUMBER)], detail={"session-id": "z0", "icid": "i0"}), None, "f0"), (*message(901, 20, protocol="enum", detail={"session-id": "z0"}), None, "f0")]
    ways, left = calls.assembled_calls(spark.createDataFrame(at_hours(2) + rows, MESSAGES + ", call string, flow_id string"), HOUR)
    got = sorted((x.call, x.frame, x.way) for x in ways.collect())
    assert got == sorted([("call0", 0, "signalling"), ("call0", 1, "signalling"), ("call0", 2, "charging"), ("call0", 3, "charging"), ("call0", 900, "charging"), ("call0", 901, "number"), ("call1", 10, "signalling"), ("call1", 11, "signalling"), ("call1", 12, "number")])
    assert {(x.call, x.unattributed) for x in left.collect()} == {("call0", 0), ("call1", 0)}


def test_what_a_call_lacks_is_counted_without_pairs(spark):
    """Calls of one session of charging, whose messages have no subscriber."""
    n = 60
    rows = at_hours(n)
    for h in range(n):
        facts = {"session-id": "one", "icid": f"i{h}"}
        rows += [(*message(5000 + h * 10 + k, h * HOUR + t, protocol="diameter", detail=d), None, None) for k, (t, d) in enumerate([(20, facts), (70, facts), (40, {"session-id": "two"})])]
    left = calls.unattributed_of_calls(spark.createDataFrame(rows, MESSAGES + ", call string, flow_id string"))
    got, most = rows_of_joins(left)
    assert {x.call: x.unattributed for x in got} == {f"call{h}": 1 for h in range(n)}
    assert most <= 6 * n


def test_counts_of_one_key_are_dealt_by_ranges(spark):
    spans = spark.createDataFrame([("a", n, float(n), float(n + 5)) for n in range(100)] + [(None, 100, 0.0, 9.0)], "key string, n int, start double, stop double")
    points = spark.createDataFrame([("a", float(t)) for t in range(103)] + [(None, 4.0)], "key string, at double")
    got = validity.counted_within(spans, points, ["key"], "at", "c")
    assert {x.n: x.c for x in got.collect()} == {**{n: min(n + 5, 102) - n + 1 for n in range(100)}, 100: 1}
    assert "__part" in got._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1].split("\n")[0]
