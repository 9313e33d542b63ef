import json

from callweave import normalise
from callweave.operators import correlate
from callweave.sources import readers

LINES = [
    "", "{broken", json.dumps({"index": {"_id": 1}}),
    json.dumps({"timestamp": "1000000", "layers": {"frame": {"frame_frame_number": "1"}, "ip": {"ip_ip_src": "10.0.0.1", "ip_ip_dst": ["10.0.0.2", "9.9.9.9"]}, "sctp": {"sctp_sctp_srcport": "5000", "sctp_sctp_dstport": "38412"}, "ngap": {"ngap_ngap_procedureCode": "15", "ngap_ngap_initiatingMessage_element": "", "ngap_ngap_RAN_UE_NGAP_ID": "7", "ngap_ngap_tAC": "0x01"}}}),
    json.dumps({"timestamp": "1000500", "layers": {"frame": {"frame_frame_number": ["2"]}, "ip": {"ip_ip_src": "10.0.0.2", "ip_ip_dst": "10.0.0.1"}, "ngap": [{"ngap_ngap_procedureCode": "14", "ngap_ngap_unsuccessfulOutcome_element": "", "ngap_ngap_RAN_UE_NGAP_ID": "7", "ngap_ngap_AMF_UE_NGAP_ID": "9", "ngap_ngap_radioNetwork": "36"}, {"ngap_ngap_procedureCode": "41", "ngap_ngap_successfulOutcome_element": "", "ngap_ngap_RAN_UE_NGAP_ID": "7", "ngap_ngap_AMF_UE_NGAP_ID": "9"}]}}),
    json.dumps({"timestamp": "1002000", "layers": {"frame": {"frame_frame_number": "3"}, "ip": {"ip_ip_src": "10.0.0.3", "ip_ip_dst": "10.0.0.4"}, "pfcp": {"pfcp_pfcp_msg_type": "55", "pfcp_pfcp_seid": "0x05", "pfcp_pfcp_seqno": "12", "pfcp_pfcp_cause": "1"}}}),
    json.dumps({"timestamp": "1003000", "layers": {"frame": {"frame_frame_number": "4"}, "ip": {"ip_ip_src": "10.0.0.5", "ip_ip_dst": "10.0.0.6"}, "tcp": {"tcp_tcp_stream": "3"}, "diameter": {"diameter_diameter_cmd_code": "316", "diameter_diameter_flags_request": "0", "diameter_diameter_Result-Code": "5001", "diameter_diameter_Session-Id": "s;1", "diameter_diameter_User-Name": "001010000000001", "diameter_diameter_applicationId": "16777251", "diameter_diameter_endtoendid": "0x10"}}}),
    json.dumps({"timestamp": "1004000", "layers": {"frame": {"frame_frame_number": "5"}, "ip": {"ip_ip_src": "10.0.0.7", "ip_ip_dst": "10.0.0.8"}, "sip": {"sip_sip_Status-Code": "401", "sip_sip_Status-Line": "SIP/2.0 401 Unauthorized", "sip_sip_Call-ID": "c1", "sip_sip_CSeq": "1 INVITE", "sip_sip_from_addr": "sip:+12025550123@ims.example;user=phone"}}}),
    json.dumps({"timestamp": "1005000", "layers": {"frame": {"frame_frame_number": "6"}, "ip": {"ip_ip_src": "10.0.0.9", "ip_ip_dst": "10.0.0.10"}, "gtpv2": {"gtpv2_gtpv2_message_type": "33", "gtpv2_gtpv2_seq": "77", "gtpv2_gtpv2_cause": "72", "e212_e212_imsi": "001010000000001", "gtpv2_gtpv2_f_teid_gre_key": ["0x1", "0x2"], "gtpv2_gtpv2_f_teid_ipv4": ["10.1.1.1", "10.1.1.2"], "gtpv2_gtpv2_f_teid_interface_type": ["10", "1"]}, "dns": {"dns_dns_qry_type": "35", "dns_dns_qry_name": "3.2.1.0.5.5.5.2.0.2.1.e164.arpa", "dns_dns_flags_response": "1", "dns_dns_flags_rcode": "3"}}}),
]


def test_frames_to_messages(spark):
    lines = spark.createDataFrame([("cap", x) for x in LINES], "capture_id string, value string")
    assert {(r.reason, r.n) for r in readers.bad_lines(lines).collect()} == {("blank", 1), ("malformed", 1), ("index", 1)}
    frames = readers.with_endpoints(readers.parse_frames(lines))
    assert {(r.frame, r.ts, r.src_ip, r.dst_ip, r.src_port, r.stream) for r in frames.where("frame in (1, 4)").collect()} == {(1, 0.0, "10.0.0.1", "10.0.0.2", 5000, None), (4, 3.0, "10.0.0.5", "10.0.0.6", None, 3)}
    rows = normalise.normalise(frames)
    got = {(r.frame, r.seq): r for r in rows.collect()}
    assert [got[k].label for k in sorted(got)] == ["InitialUEMessage", "InitialContextSetupFailure", "UEContextReleaseResponse", "Session Deletion Response", "3GPP-Update-Location Answer", "401 Unauthorized", "Create Session Response", "NAPTR Response"]
    assert {(k.kind, k.value) for k in got[1, 0].keys} == {("ran_ue_ngap_id", "10.0.0.1,10.0.0.2/7")}
    assert got[2, 0].is_failure and (got[2, 0].cause.table, got[2, 0].cause.value) == ("ngap_radioNetwork", 36)
    assert not got[2, 1].is_failure and {k.kind for k in got[2, 1].releases} == {"ran_ue_ngap_id", "amf_ue_ngap_id"}
    assert [(k.kind, k.value) for k in got[3, 0].releases] == [("pfcp_seid", "10.0.0.3,10.0.0.4/5")] and got[3, 0].detail["seqno"] == "12"
    assert got[4, 0].is_failure and got[4, 0].detail["reference_point"] == "S6a/S6d" and ("supi", "001010000000001") in {(k.kind, k.value) for k in got[4, 0].keys}
    assert not got[5, 0].is_failure and ("msisdn", "+12025550123") in {(k.kind, k.value) for k in got[5, 0].keys}
    assert {(k.kind, k.value) for k in got[6, 0].keys} == {("gtpv2_transaction", "10.0.0.10>10.0.0.9/77"), ("supi", "001010000000001"), ("gtp_teid_c", "10.1.1.1/1"), ("gtp_teid", "10.1.1.2/2")} and got[6, 0].is_failure
    assert [(k.kind, k.value) for k in got[6, 1].keys] == [("msisdn", "+12025550123")] and not got[6, 1].is_failure
    flows = correlate.correlate(rows)
    by_frame = {(r.frame, r.seq): r.flow_id for r in flows.collect()}
    assert by_frame[1, 0] == by_frame[2, 0] == by_frame[2, 1] and by_frame[4, 0] == by_frame[6, 0] and by_frame[5, 0] == by_frame[6, 1] and len(set(by_frame.values())) == 4


def test_carried_nas_sbi_and_blind_spots(spark):
    frame = lambda n, **layers: json.dumps({"timestamp": str(n * 1000), "layers": {"frame": {"frame_frame_number": str(n)}, "ip": {"ip_ip_src": "10.0.0.1", "ip_ip_dst": "10.0.0.2"}, **layers}})
    five = {"nas-5gs_nas-5gs_mm_message_type": "0x41", "e212_e212_mcc": "001", "e212_e212_mnc": "01", "nas-5gs_nas-5gs_mm_suci_msin": "0000000001"}
    lines = [
        frame(1, ngap={"ngap_ngap_procedureCode": "15", "ngap_ngap_RAN_UE_NGAP_ID": "7", "nas-5gs": five}),
        frame(2, ngap={"ngap_ngap_procedureCode": "4", "ngap_ngap_RAN_UE_NGAP_ID": "7", "nas-5gs": [{"nas-5gs_nas-5gs_security_header_type": "2"}, {"nas-5gs_nas-5gs_mm_message_type": "0x44", "nas-5gs_nas-5gs_mm_5gmm_cause": "22"}]}),
        frame(3, **{"s1ap": {"s1ap_s1ap_procedureCode": "12", "s1ap_s1ap_ENB_UE_S1AP_ID": "3", "nas-eps": {"nas-eps_nas-eps_security_header_type": "12", "nas-eps_nas-eps_emm_mme_code": "1", "nas-eps_nas-eps_emm_m_tmsi": "0xff"}}}),
        frame(4, http2=[{"http2_http2_type": "1", "http2_http2_streamid": "5", "http2_http2_headers_method": "POST", "http2_http2_headers_path": "/nsmf-pdusession/v1/sm-contexts/9/modify?x=001010000000001", "http2_http2_headers_authority": "10.1.1.1:80", "http2_http2_header_name": ["3gpp-Sbi-Target-apiRoot"], "http2_http2_header_value": ["http://smf.example:80"], "json_json_member_with_value": ["/n2SmInfoType:PDU_RES_SETUP_RSP", "/supi:imsi-001010000000009"], "ngap_ngap_gTP_TEID": "0x7", "ngap_ngap_TransportLayerAddressIPv4": "10.9.9.9"}, {"http2_http2_type": "1", "http2_http2_streamid": "7"}, {"http2_http2_type": "1", "http2_http2_streamid": "9", "http2_http2_headers_status": "404"}]),
    ]
    frames = readers.with_endpoints(readers.parse_frames(spark.createDataFrame([("cap", x) for x in lines], "capture_id string, value string")))
    got = {(r.frame, r.protocol, r.label): r for r in normalise.normalise(frames).collect()}
    keys = lambda *at: {(k.kind, k.value) for k in got[at].keys}
    assert keys(1, "nas-5gs", "Registration request") == {("ran_ue_ngap_id", "10.0.0.1,10.0.0.2/7"), ("supi", "001010000000001")}
    reject = got[2, "nas-5gs", "Registration reject"]
    assert reject.is_failure and reject.cause.value == 22 and reject.detail["identity-from"] == "ngap"
    assert ("s_tmsi", "1-000000ff") in keys(3, "nas-eps", "Service request")
    post = got[4, "sbi", "POST /nsmf-pdusession/v1/sm-contexts/9/modify?x=001010000000001"]
    assert {(k.kind, k.value) for k in post.keys} == {("sbi_stream", "10.0.0.1,10.0.0.2/5"), ("supi", "001010000000009"), ("sm_context_ref", "10.1.1.1:80/9")}
    assert {(q.kind, q.value, q.looks) for q in post.quotes} == {("gtp_teid", "10.9.9.9/7", "reported"), ("supi", "001010000000001", "embedded")}
    assert post.detail["service"] == "nsmf-pdusession" and post.detail["relay-target"] == "smf.example" and got[4, "sbi", "404"].is_failure
    assert {(r.kind, r.key, r.n) for r in normalise.nas.blind_spots(frames).collect()} == {("ciphered-nas", None, 1), ("undecoded-stream", "10.0.0.1,10.0.0.2/7", 1)}
