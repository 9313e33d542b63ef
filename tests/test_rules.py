"""Rules that go wrong quietly: episodes of calls, segments of repeated openers, evidence from frames to roles."""

import json

from pyspark.sql import functions as F

from callweave import normalise
from callweave.operators import correlate, privacy, procedures, roles, sequences
from callweave.schema import MESSAGES
from callweave.sources import readers

END = lambda ip, port=None: (ip, port, None, None, None)


def rows(spark, *messages):
    """(frame, ts, protocol, label, keys, releases, detail)"""
    made = [("c", f, 0, float(t), None, p, x, END("1.1.1.1"), END("2.2.2.2"), keys, releases, [], None, False, d) for f, t, p, x, keys, releases, d in messages]
    return spark.createDataFrame(made, MESSAGES)


def keys_of(frame):
    return {r.frame: sorted(k.value for k in r["keys"]) for r in frame.select("frame", "keys").collect()}


def test_bye_frees_the_media_of_its_call_alone(spark):
    call, media, context = (lambda v: ("sip_call_id", v)), ("media_endpoint", "10.0.0.9/4000"), ("h248_context", "g/7")
    given = rows(
        spark,
        (1, 1, "sip", "INVITE", [call("c1"), media], [], {}),
        (2, 2, "megaco", "Add", [media, context], [], {}),
        (3, 3, "sip", "BYE", [call("c1")], [call("c1")], {}),
        (4, 4, "megaco", "Subtract", [context], [context], {}),
        (5, 5, "sip", "INVITE", [call("c2"), media], [], {}),
        (6, 6, "megaco", "Add", [context, media], [], {}),
    )
    got = keys_of(correlate.assign_episodes(given))
    assert got[1] == ["10.0.0.9/4000", "c1"] and got[4] == ["g/7"]
    assert got[5] == ["10.0.0.9/4000@2", "c2"] and got[6] == ["10.0.0.9/4000@2", "g/7@2"]
    flows = {r.frame: r.flow_id for r in correlate.correlate(correlate.assign_episodes(given)).collect()}
    assert flows[1] == flows[2] == flows[4] != flows[5] == flows[6]


def test_release_ends_what_was_met(spark):
    ran, amf, other = ("ran_ue_ngap_id", "s/1"), ("amf_ue_ngap_id", "s/2"), ("pfcp_seid", "s/3")
    given = rows(spark, (1, 1, "ngap", "a", [ran, amf], [], {}), (2, 2, "ngap", "b", [amf, other], [], {}), (3, 3, "ngap", "r", [ran], [ran], {}), (4, 4, "ngap", "c", [ran], [], {}), (5, 5, "pfcp", "d", [other], [], {}))
    got = keys_of(correlate.assign_episodes(given))
    assert got[3] == ["s/1"] and got[4] == ["s/1@2"] and got[5] == ["s/3@2"]


def test_a_repeated_opener_keeps_the_first_rule():
    machine = procedures.Segmenter()
    steps = [(0.0, "HandoverPreparation"), (0.5, "PathSwitchRequest"), (0.6, "PathSwitchRequestResponse"), (4.5, "HandoverNotification")]
    assert [machine.step(t, x, False) for t, x in steps] == [(1, "handover")] * 4
    machine = procedures.Segmenter()
    steps = [(0.0, "HandoverPreparation"), (0.1, "UplinkNASTransport + HandoverCancel"), (3.0, "Other")]
    assert [machine.step(t, x, False) for t, x in steps] == [(1, "handover")] * 3
    machine = procedures.Segmenter()
    assert [machine.step(t, x, False) for t, x in [(0.0, "HandoverPreparation"), (0.1, "HandoverCancelResponse + x"), (3.0, "Other")]] == [(1, "handover"), (1, "handover"), None]


def test_retransmission_rules(spark):
    d = {"end-to-end-id": "7"}
    given = rows(spark, (1, 1, "diameter", "X Request", [], [], d), (2, 2, "diameter", "X Request", [], [], d | {"retransmitted": "1"}), (3, 3, "sip", "INVITE", [], [], {}), (4, 4, "sip", "INVITE", [], [], {}), (5, 5, "nas-5gs", "Registration request", [], [], {}), (6, 6, "nas-5gs", "Registration request", [], [], {})).withColumn("flow_id", F.lit("f"))
    assert [(x.n, x.flagged) for x in sequences.confirmed_retransmissions(given, "diameter", "end-to-end-id").collect()] == [(2, True)]
    assert [(x.label, x.first_frame, x.last_frame) for x in sequences.nas_retransmissions(given).collect()] == [("Registration request", 5, 6)]


def test_rows_without_a_flow_have_no_neighbour(spark):
    given = rows(spark, *((k, k, "sip", "x", [], [], {}) for k in range(1, 6))).withColumn("flow_id", F.when(F.col("frame") > 3, "f"))
    assert {r.frame: r.delta for r in sequences.deltas(given).collect()} == {1: None, 2: None, 3: None, 4: None, 5: 1.0}


def frame(number, layers, src="10.1.1.1", dst="10.2.2.2", ports=None):
    held = {"frame": {"frame_frame_number": str(number)}, "ip": {"ip_ip_src": src, "ip_ip_dst": dst}} | layers
    if ports:
        held["sctp"] = {"sctp_sctp_srcport": str(ports[0]), "sctp_sctp_dstport": str(ports[1])}
    return json.dumps({"timestamp": str(1_700_000_000_000 + number), "layers": held})


def test_roles_from_frames(spark, tmp_path):
    lines = [
        frame(1, {"ngap": {"ngap_ngap_procedureCode": "15", "ngap_ngap_InitiatingMessage_element": "1"}}, "10.0.0.1", "10.0.0.2", (5000, 38412)),
        frame(2, {"s1ap": {"s1ap_s1ap_procedureCode": "9", "s1ap_s1ap_initiatingMessage_element": "1"}}, "10.0.0.3", "10.0.0.4"),
        frame(3, {"http2": {"http2_http2_type": "1", "http2_http2_headers_method": "GET", "http2_http2_headers_path": "/nudm-sdm/v2/imsi-001010000000001/am-data"}}, "10.0.0.2", "10.0.0.5"),
        frame(4, {"diameter": {"diameter_diameter_cmd_code": "318", "diameter_diameter_applicationId": "16777251", "diameter_diameter_flags_request": "1"}}, "10.0.0.4", "10.0.0.6"),
        frame(5, {"pfcp": {"pfcp_pfcp_msg_type": "50"}}, "10.0.0.7", "10.0.0.8"),
    ]
    (tmp_path / "a.ndjson").write_text("\n".join(lines))
    messages = normalise.normalise(readers.with_endpoints(readers.read_frames(spark, str(tmp_path / "a.ndjson"))))
    got = {(r.address, r.role) for r in roles.role_votes(messages).collect()}
    want = {("10.0.0.1", "gNB"), ("10.0.0.2", "AMF"), ("10.0.0.3", "MME"), ("10.0.0.4", "eNB"), ("10.0.0.5", "UDM"), ("10.0.0.4", "MME"), ("10.0.0.6", "HSS"), ("10.0.0.7", "SMF"), ("10.0.0.8", "UPF")}
    assert got == want, got


def test_result_of_the_group(spark, tmp_path):
    group = "0000010a4000000c000028af" + "0000012a4000000c00001389"
    (tmp_path / "a.ndjson").write_text(frame(1, {"diameter": {"diameter_diameter_cmd_code": "318", "diameter_diameter_Vendor-Id": ["999", "10415"], "diameter_diameter_Experimental-Result": group, "diameter_diameter_Experimental-Result-Code": "5001"}}))
    got = normalise.normalise(readers.with_endpoints(readers.read_frames(spark, str(tmp_path / "a.ndjson")))).first()
    assert (got.cause.table, got.cause.value, got.is_failure) == ("diameter_3gpp", 5001, True)


def test_what_a_scrub_changes():
    text = "imsi-001010000000001 at 10.0.0.7, not 10.0.0.700 or 1.2.3; call tel:+15551234567 or +4915123456789. IMEI 490154203237518: no 12345; suci-0-001-01-0-0-0-123456789 me.you@mail.example.org 2001:db8::1 ims.mnc001.mcc999.3gppnetwork.org"
    got = [(k, v) for _, _, k, v in privacy.spans_of(text)]
    assert got == [("imsi", "001010000000001"), ("ipv4", "10.0.0.7"), ("uri", "15551234567"), ("number", "4915123456789"), ("digits", "490154203237518"), ("suci", "suci-0-001-01-0-0-0-123456789"), ("email", "me.you"), ("ipv6", "2001:db8::1"), ("plmn", "mnc001.mcc999")]
    assert all(text[a:b] == v for a, b, _, v in privacy.spans_of(text)) and privacy.spans_of(None) == []
