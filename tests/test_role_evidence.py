"""Roles from consumers, Diameter interfaces, protected SIP and Contact headers."""

from __future__ import annotations

import json

from callweave import normalise
from callweave.operators import role_evidence, roles
from callweave.schema import MESSAGES
from callweave.sources import readers

UE_A, UE_B, PCSCF, TAS = "192.0.2.1", "192.0.2.2", "198.51.100.10", "198.51.100.50"


def frames(spark, folder, captures, protocols):
    """Messages of several captures, a file each."""
    for name, rows in captures.items():
        lines = []
        for n, (src, dst, layers) in enumerate(rows, 1):
            ip = {"ipv6": {"ipv6_ipv6_src": src, "ipv6_ipv6_dst": dst}} if ":" in src else {"ip": {"ip_ip_src": src, "ip_ip_dst": dst}}
            lines.append(json.dumps({"timestamp": str(n * 1000), "layers": {"frame": {"frame_frame_number": str(n)}, **ip, "tcp": {"tcp_tcp_srcport": "5060", "tcp_tcp_dstport": "5060"}, **layers}}))
        (folder / name).write_text("\n".join(lines))
    return normalise.normalise(readers.with_endpoints(readers.read_frames(spark, str(folder))), protocols)


def sip(contact=None, esp=False):
    layers = {"sip": {"sip_sip_Method": "INVITE", **({"sip_sip_Contact": contact} if contact else {})}}
    return layers | ({"esp": {"esp_esp_spi": "1"}} if esp else {})


def get(path):
    return {"http2": {"http2_http2_type": "1", "http2_http2_headers_method": "GET", "http2_http2_headers_path": path}}


def diameter(application, command, request=True):
    return {"diameter": {"diameter_diameter_cmd_code": str(command), "diameter_diameter_applicationId": str(application), "diameter_diameter_flags_request": "1" if request else "0"}}


def test_consumers_interfaces_fan_out_and_contact(spark, tmp_path):
    captures = {
        # Two users of one proxy: the fan-out decides, and a core node's Contact counts for nothing.
        "fanout": [(UE_A, PCSCF, sip(f"<sip:001010000000111@{UE_A}:5060>", esp=True)), (PCSCF, UE_B, sip(f"<sip:001010000000111@{PCSCF}:5060>", esp=True)), (TAS, PCSCF, sip(f"<sip:001010000000111@{TAS}:5060>"))],
        "single": [(UE_A, PCSCF, sip(f"<sip:001010000000111@{UE_A}:5060>", esp=True))],
        # A device instance and IPv6 count; a node without a subscriber and a forwarded Contact don't.
        "contacts": [
            (UE_A, PCSCF, sip(f'<sip:{UE_A}:5060>;+sip.instance="<urn:gsma:imei:1>"')), (TAS, "198.51.100.11", sip(f"<sip:{TAS}:5060>")),
            ("198.51.100.12", "198.51.100.13", sip(f"<sip:001010000000111@{UE_A}:5060>")), ("2001:db8::1", "2001:db8::2", sip("<sip:001010000000112@[2001:db8::1]:5060;transport=tcp>")),
        ],
        "sbi": [
            ("10.0.0.1", "10.0.0.9", get("/nudm-ueau/v1/imsi-001010000000001/security-information/generate-auth-data")), ("10.0.0.2", "10.0.0.8", get("/nsmf-pdusession/v1/sm-contexts")), ("10.0.0.3", "10.0.0.8", get("/nsmf-pdusession/v1/pdu-sessions")),
            ("10.0.0.4", "10.0.0.9", get("/nudm-sdm/v2/imsi-001010000000001/sms-mng-data?x=/am-data")), ("10.0.0.5", "10.0.0.9", get("/nudm-sdm/v2/imsi-001010000000001/sms-data")),
        ],
        "diameter": [
            ("10.1.0.1", "10.1.0.9", diameter(16777216, 300)), ("10.1.0.2", "10.1.0.9", diameter(16777216, 303)), ("10.1.0.9", "10.1.0.2", diameter(16777216, 305)),
            ("10.1.0.9", "10.1.0.1", diameter(16777216, 302, request=False)), ("10.1.0.3", "10.1.0.4", diameter(16777272, 265)), ("10.1.0.4", "10.1.0.9", diameter(16777265, 301)),
        ],
    }
    got: dict = {}
    for r in roles.role_votes(frames(spark, tmp_path, captures, ["sip", "sbi", "diameter"])).collect():
        got.setdefault(r.capture_id.split(".")[0], set()).add((r.address, r.role, r.basis))
    assert got["fanout"] == {(UE_A, "UE", "ipsec-fanout"), (UE_B, "UE", "ipsec-fanout"), (PCSCF, "P-CSCF", "ipsec-fanout")}
    assert got["single"] == {(UE_A, "UE", "contact"), (PCSCF, "P-CSCF", "contact")}
    assert got["contacts"] == {(UE_A, "UE", "contact"), (PCSCF, "P-CSCF", "contact"), ("2001:db8::1", "UE", "contact"), ("2001:db8::2", "P-CSCF", "contact")}
    consumers = {("10.0.0.1", "AUSF", "service-consumer"), ("10.0.0.2", "AMF", "resource-consumer"), ("10.0.0.3", "SMF", "resource-consumer"), ("10.0.0.4", "SMSF", "resource-consumer")}
    assert got["sbi"] == consumers | {("10.0.0.9", "UDM", "service"), ("10.0.0.8", "SMF", "service")}
    assert {(a, r) for a, r, _ in got["diameter"]} == {("10.1.0.1", "I-CSCF"), ("10.1.0.2", "S-CSCF"), ("10.1.0.9", "HSS"), ("10.1.0.3", "PGW"), ("10.1.0.4", "AAA")}


def test_an_interface_has_one_asker_per_command():
    seen = [(number, c) for _, number, _, _, asked, pushed in role_evidence.INTERFACES for c in (*asked, *pushed)]
    assert len(seen) == len(set(seen))


def test_a_callback_of_two_services_says_nothing(spark):
    end = lambda ip: (ip, None, None, None, None)
    row = lambda n, src, dst, path, **more: ("c", n, 0, float(n), None, "sbi", "POST", end(src), end(dst), [], [], [], None, False, {"path": path} | more)
    rows = [row(1, "a", "u", "/nudm-sdm/v2/x", service="nudm-sdm", **{"callback-uris": "/cb/x"}), row(2, "a", "p", "/npcf-smpolicycontrol/v1/y", service="npcf-smpolicycontrol", **{"callback-uris": "/cb/x /cb/y"}), row(3, "n", "a", "/cb/x/1"), row(4, "m", "a", "/cb/y/1")]
    got = {(r.address, r.role) for r in roles.role_votes(spark.createDataFrame(rows, MESSAGES)).where("basis = 'notify'").collect()}
    assert got == {("m", "PCF")}
