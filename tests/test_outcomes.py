import json

import pytest
from pyspark.sql import functions as F

from callweave.operators import coverage as V
from callweave.operators import diameter_paths as D
from callweave.operators import procedures as X
from callweave.operators import sequences as Q
from callweave.operators import summary as Y
from callweave.schema import MESSAGES
from tests.test_operators import message


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame(rows, MESSAGES + ", flow_id string")


def diameter(frame, label, src, dst, end="e1", hop=None, session="s1", failed=False, **more):
    held = {"end-to-end-id": end, "hop-by-hop-id": hop, "session-id": session, **more}
    return message(frame, frame, label, "diameter", src=src, dst=dst, failed=failed, cause=failed and ("diameter_3gpp", 5001) or None, detail={k: v for k, v in held.items() if v})


def by(rows, *names):
    return {tuple(r[n] for n in names): r for r in rows}


def test_relayed_request_is_one_transaction_with_its_way(table):
    rows = [
        diameter(1, "Update-Location Request", "mme", "dra", hop="1", reference_point="S6a"), diameter(2, "Update-Location Request", "dra", "hss", hop="2"),
        diameter(3, "Update-Location Answer", "hss", "dra", hop="2"), diameter(4, "Update-Location Answer", "dra", "mme", hop="1"),
    ]
    flows, paths = D.flow_outcomes(table(rows))
    (flow,) = flows.collect()
    assert (flow.kind, flow.interface, flow.commands, flow.transactions, flow.hops, flow.relayed, flow.unanswered, flow.outcome) == ("session", "S6a", ["Update-Location"], 1, 2, True, 0, "success")
    assert [r.address for r in paths.orderBy("place").collect()] == ["mme", "dra", "hss"]


def test_relayed_failure_counts_once_and_unanswered_legs_are_counted(table):
    rows = [
        diameter(1, "Update-Location Request", "mme", "dra", hop="1"), diameter(2, "Update-Location Request", "dra", "hss", hop="2"), diameter(3, "Update-Location Answer", "hss", "dra", hop="2", failed=True), diameter(4, "Update-Location Answer", "dra", "mme", hop="1", failed=True),
        diameter(5, "Purge-UE Request", "mme", "dra", end="e2", hop="3"),
    ]
    (flow,) = D.flow_outcomes(table(rows))[0].collect()
    assert (flow.failures, flow.transactions, flow.unanswered, flow.outcome, flow.cause) == (1, 2, 1, "failure", "diameter_3gpp 5001")


def test_redirect_settles_nothing_and_peers_need_every_answer(table):
    rows = [
        diameter(1, "Update-Location Request", "a", "b", session="r"), diameter(2, "Update-Location Answer", "b", "a", session="r", failed=True, **{"redirect-host": "far"}),
        diameter(3, "Device-Watchdog Request", "a", "b", session=None, end="w1"), diameter(4, "Device-Watchdog Answer", "b", "a", session=None, end="w1"), diameter(5, "Device-Watchdog Request", "c", "b", session=None, end="w2"),
        diameter(6, "Device-Watchdog Answer", "b", "d", session=None, end=None),
    ]
    flows, paths = D.flow_outcomes(table(rows))
    got = by(flows.collect(), "kind", "session")
    assert {k: r.outcome for k, r in got.items()} == {("session", "r"): "incomplete", ("peer", "a|b"): "success", ("peer", "b|c"): "incomplete", ("peer", "b|d"): "success"}
    assert got["peer", "b|d"].unanswered == 0 and got["peer", "b|c"].unanswered == 1
    # A lone answer is read backwards.
    assert [r.address for r in paths.where("session = 'b|d'").orderBy("place").collect()] == ["d", "b"]


def test_reused_hop_ids_of_two_sessions_stay_apart(table):
    rows = [diameter(n, f"Update-Location {w}", *(("a", "b") if w == "Request" else ("b", "a")), end=f"e{s}", hop="7", session=s, failed=s == "y" and w == "Answer") for n, (s, w) in enumerate([("x", "Request"), ("y", "Request"), ("y", "Answer"), ("x", "Answer")])]
    assert {r.session: r.outcome for r in D.flow_outcomes(table(rows))[0].collect()} == {"x": "success", "y": "failure"}


def test_no_diameter_gives_empty_tables(table):
    flows, paths = D.flow_outcomes(table([message(1, 1, "Paging")]))
    assert flows.count() == 0 and paths.count() == 0


def segment(spark, rows, kind):
    return spark.createDataFrame([("cap", "f", r["frame"], 0, 1, kind) for r in rows], "capture_id string, flow_id string, frame long, seq int, segment long, kind string")


def test_handover_timings_from_source_and_target_side(spark, table):
    ready = message(2, 1.5, "HandoverResourceAllocationResponse")
    rows = [message(1, 1, "HandoverResourceAllocation", detail={"handover-type": "fivegs-to-eps"}), ready, message(3, 4, "HandoverNotification")]
    (got,) = X.finish(table(rows), segment(spark, rows, "handover")).collect()
    assert (got.prep_s, got.exec_s, got.direction, got.family, got.outcome) == (0.5, 2.5, "5gs-to-eps", "5g", "success")
    rows.append(message(4, 2, "HandoverPreparationResponse"))
    (got,) = X.finish(table(rows), segment(spark, rows, "handover")).collect()
    assert (got.prep_s, got.exec_s) == (1.0, 2.0)


def test_direction_of_contexts_and_updates(spark, table):
    way = lambda rows, kind: X.finish(table(rows), segment(spark, rows, kind)).first().direction
    assert way([message(1, 1, "Context Request", "gtpv2", role="MME")], "context-transfer") == "5gs-to-eps"
    assert way([message(1, 1, "Context Request", "gtpv2", role="AMF")], "context-transfer") == "eps-to-5gs"
    assert way([message(1, 1, "Context Request", "gtpv2")], "context-transfer") is None
    assert way([message(1, 1, "Tracking area update request", "nas-eps"), message(2, 2, "Context Request", "gtpv2")], "tau") == "5gs-to-eps"
    assert way([message(1, 1, "Tracking area update request", "nas-eps")], "tau") is None


def test_scenarios_prefer_a_failure_and_keep_null_directions_apart(spark):
    rows = [("c", "5g", "handover", d, None, o, cause, f) for d, o, cause, f in [("5gs-to-eps", "success", None, 1), ("5gs-to-eps", "failure", "b", 9), ("5gs-to-eps", "failure", "a", 7), (None, "success", None, 3)]]
    got = by(Y.scenario_details(spark.createDataFrame(rows, "capture_id string, family string, kind string, direction string, trigger string, outcome string, cause string, start_frame long")).collect(), "direction")
    assert (got["5gs-to-eps",].total, got["5gs-to-eps",].sample_frame, got["5gs-to-eps",].top_cause, got["5gs-to-eps",].place) == (3, 7, "a", 1)
    assert (got[None,].success, got[None,].top_cause, got[None,].place) == (1, None, 2)


def test_failures_are_explained_where_the_table_knows_them(spark):
    failures = spark.createDataFrame([("c", 1, "t", 3), ("c", 2, "t", 4), ("c", 3, None, None)], "capture_id string, frame long, cause_table string, cause_value int")
    guide = spark.createDataFrame([("t", 3, "n", "TS", None, "plain words", ["wrong APN"], None)], "table string, value int, name string, spec string, clause string, plain string, common_causes array<string>, outcome string")
    got = {r.frame: (r.known, r.explanation, r.common_causes) for r in Y.failure_records(failures, guide).collect()}
    assert got == {1: (True, "plain words", ["wrong APN"]), 2: (False, None, None), 3: (False, None, None)}


def test_summary_is_written_in_order_and_keeps_nulls(spark, tmp_path):
    rows = spark.createDataFrame([("c", "failures", n, f"k{n % 3}", json.dumps({"n": n, "x": None})) for n in range(50)] + [("c", "capture", None, "", "{}")], "capture_id string, section string, at_frame long, at_key string, record string")
    Y.write_summary(rows, str(tmp_path / "s"))
    back = spark.read.json(str(tmp_path / "s"))
    assert back.count() == 51 and sorted(r.at_frame for r in back.where("section = 'failures'").collect()) == list(range(50))


def test_sequences_of_failures_need_one_table_and_neighbours(spark, table):
    rules = spark.createDataFrame([("t", [1, 2], "short"), ("t", [1, 2, 3], "long"), ("t", [11, 2], "other"), ("u", [1, 2], "else")], "table string, values array<int>, says string")
    cases = {"f1": [("t", 5), ("t", 1), ("t", 2), ("t", 3)], "f2": [("t", 1), ("t", 2)], "f3": [("t", 1), ("t", 9), ("t", 2)], "f4": [("t", 1), ("t", 2), ("u", 1)], "f5": [("u", 1), ("u", 2)], "f6": [("t", 1), None, ("t", 2)], "f7": [("t", 111), ("t", 2)]}
    rows = [message(10 * int(f[1]) + n, n, "x", flow=f, failed=True, cause=c) for f, seen in cases.items() for n, c in enumerate(seen)]
    got = {r.flow_id: r.says for r in Q.match_sequences(table(rows).where(F.col("is_failure")), rules, ["capture_id", "flow_id"]).collect()}
    assert got == {"f1": "long", "f2": "short", "f5": "else"}


def test_reasons_of_searches_that_find_nothing(spark):
    captures = spark.createDataFrame([(c,) for c in "abcdef"], "capture_id string")
    found = spark.createDataFrame([("a", "supi", "001"), ("b", "supi", "777"), ("c", "supi", "777"), ("e", "amf_ue_ngap_id", "7")], "capture_id string, kind string, value string")
    spots = spark.createDataFrame([("a", "protected", 1), ("b", "protected", 2), ("d", "protected", 1), ("d", "ciphered", 1), ("e", "ciphered", 4), ("f", "other", 1)], "capture_id string, kind string, n long")
    got = {r.capture_id: r.reason for r in V.search_reasons(captures, found, spots, "001").collect()}
    assert got == {"a": None, "b": "some-protected", "c": "no-match", "d": "all-protected", "e": "ciphered", "f": "no-identity"}


def test_unknown_flow_is_an_error(table):
    rows = table([message(1, 1, "x", flow="f"), message(2, 2, "x", flow="g")])
    assert [r.frame for r in V.select_flows(rows, [("cap", "g"), ("cap", "g")]).collect()] == [2]
    with pytest.raises(LookupError, match="zz"):
        V.select_flows(rows, [("cap", "g"), ("cap", "zz")])
