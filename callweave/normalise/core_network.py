"""Core network: PFCP, GTP-U, GTPv2-C, Diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.scalars import imsi_from_ims_identity, international_msisdn, integer_of, msisdn_from_tbcd
from callweave.normalise.core import blocks, cause, details, key, messages, named, number, text, texts, tunnels

# PFCP message types (3GPP TS 29.244).
PFCP = {
    1: "Heartbeat Request", 2: "Heartbeat Response", 3: "PFD Management Request", 4: "PFD Management Response", 5: "Association Setup Request", 6: "Association Setup Response", 7: "Association Update Request",
    8: "Association Update Response", 9: "Association Release Request", 10: "Association Release Response", 11: "Version Not Supported Response", 12: "Node Report Request", 13: "Node Report Response",
    14: "Session Set Deletion Request", 15: "Session Set Deletion Response", 50: "Session Establishment Request", 51: "Session Establishment Response", 52: "Session Modification Request",
    53: "Session Modification Response", 54: "Session Deletion Request", 55: "Session Deletion Response", 56: "Session Report Request", 57: "Session Report Response",
}
# GTP-U message types (3GPP TS 29.281).
GTPU = {1: "Echo Request", 2: "Echo Response", 26: "Error Indication", 31: "Supported Extension Headers Notification", 254: "End Marker", 255: "G-PDU"}
# GTPv2-C message types (3GPP TS 29.274).
GTPV2 = {
    1: "Echo Request", 2: "Echo Response", 3: "Version Not Supported Indication", 25: "SRVCC PS to CS Request", 26: "SRVCC PS to CS Response", 32: "Create Session Request", 33: "Create Session Response",
    34: "Modify Bearer Request", 35: "Modify Bearer Response", 36: "Delete Session Request", 37: "Delete Session Response", 38: "Change Notification Request", 39: "Change Notification Response", 64: "Modify Bearer Command",
    65: "Modify Bearer Failure Indication", 66: "Delete Bearer Command", 67: "Delete Bearer Failure Indication", 68: "Bearer Resource Command", 69: "Bearer Resource Failure Indication",
    70: "Downlink Data Notification Failure Indication", 95: "Create Bearer Request", 96: "Create Bearer Response", 97: "Update Bearer Request", 98: "Update Bearer Response", 99: "Delete Bearer Request",
    100: "Delete Bearer Response", 128: "Identification Request", 129: "Identification Response", 130: "Context Request", 131: "Context Response", 132: "Context Acknowledge", 133: "Forward Relocation Request",
    134: "Forward Relocation Response", 135: "Forward Relocation Complete Notification", 136: "Forward Relocation Complete Acknowledge", 139: "Relocation Cancel Request", 140: "Relocation Cancel Response",
    149: "Detach Notification", 150: "Detach Acknowledge", 162: "Suspend Notification", 163: "Suspend Acknowledge", 164: "Resume Notification", 165: "Resume Acknowledge", 170: "Release Access Bearers Request",
    171: "Release Access Bearers Response", 176: "Downlink Data Notification", 177: "Downlink Data Notification Acknowledge", 211: "Modify Access Bearers Request", 212: "Modify Access Bearers Response",
}
# F-TEID interface types of the user plane (3GPP TS 29.274, 8.22).
USER_PLANE = (0, 1, 2, 3, 4, 5, 15, 16, 19, 20, 21, 22, 23, 28, 29, 31, 33, 34, 37, 38, 39, 41)
# Diameter applications and commands (IANA).
APPLICATIONS = {0: "Base", 16777216: "Cx/Dx", 16777217: "Sh", 16777236: "Rx", 16777238: "Gx", 16777251: "S6a/S6d", 16777265: "SWx", 16777272: "S6b"}
COMMANDS = {
    257: "Capabilities-Exchange", 258: "Re-Auth", 265: "AA", 271: "Accounting", 272: "Credit-Control", 274: "Abort-Session", 275: "Session-Termination", 280: "Device-Watchdog", 282: "Disconnect-Peer",
    300: "User-Authorization", 301: "Server-Assignment", 302: "Location-Info", 303: "Multimedia-Auth", 304: "Registration-Termination", 305: "Push-Profile", 306: "User-Data", 307: "Profile-Update",
    308: "Subscribe-Notifications", 309: "Push-Notification", 316: "3GPP-Update-Location", 317: "3GPP-Cancel-Location", 318: "3GPP-Authentication-Information", 319: "3GPP-Insert-Subscriber-Data",
    320: "3GPP-Delete-Subscriber-Data", 321: "3GPP-Purge-UE", 322: "3GPP-Reset", 323: "3GPP-Notify",
}
VENDOR_3GPP, REDIRECT = 10415, 3006
VENDOR_ID = 266


def pfcp(frames: DataFrame) -> DataFrame:
    rows = blocks(frames, "pfcp").withColumns({"code": number("pfcp_pfcp_msg_type"), "c": number("pfcp_pfcp_cause")}).where("code is not null")
    seids = F.transform(F.filter(texts("pfcp_pfcp_seid"), lambda s: F.coalesce(integer_of(s), F.lit(0)) != 0), lambda s: F.struct(F.lit("pfcp_seid").alias("kind"), F.concat_ws("/", "scope", integer_of(s).cast("string")).alias("value")))
    keys = F.concat(seids, tunnels("gtp_teid", texts("pfcp_pfcp_f_teid_teid"), texts("pfcp_pfcp_f_teid_ipv4_addr")), tunnels("gtp_teid", texts("pfcp_pfcp_outer_hdr_creation_teid"), texts("pfcp_pfcp_outer_hdr_creation_ipv4")))
    rows = rows.withColumn("__keys", keys)
    released = F.when(F.col("code").isin(55, 15) & (F.col("c") == 1), F.filter("__keys", lambda k: k["kind"] == "pfcp_seid"))
    return messages(rows, "pfcp", named(F.col("code"), PFCP, "PFCP message type "), F.col("__keys"), F.col("c") >= 64, details(seqno=number("pfcp_pfcp_seqno"), cause=F.col("c")), released, cause("pfcp", F.col("c")))


def gtp(frames: DataFrame) -> DataFrame:
    rows = blocks(frames, "gtp").withColumns({"code": number("gtp_gtp_message"), "teid": number("gtp_gtp_teid")}).where("code is not null")
    tunnel = key("gtp_teid", F.when(F.col("teid") != 0, F.col("teid")), F.col("dst_ip"))
    return messages(rows, "gtp", named(F.col("code"), GTPU, "GTP-U message type "), F.array(tunnel), F.col("code") == 26, details(teid=F.col("teid"), qfi=text("gtp_gtp_ext_hdr_pdu_ses_con_qos_flow_id")))


def gtpv2(frames: DataFrame) -> DataFrame:
    rows = blocks(frames, "gtpv2").withColumns({"code": number("gtpv2_gtpv2_message_type"), "c": number("gtpv2_gtpv2_cause"), "n": number("gtpv2_gtpv2_seq")}).where("code is not null")
    label = named(F.col("code"), GTPV2, "GTPv2 message type ")
    rows = rows.withColumn("answer", label.rlike("(Response|Acknowledge|Failure Indication)$"))
    ends = F.when(F.col("answer"), F.concat_ws(">", "dst_ip", "src_ip")).otherwise(F.concat_ws(">", "src_ip", "dst_ip"))
    exchange = key("gtpv2_transaction", F.col("n"), ends)
    teids = F.arrays_zip(texts("gtpv2_gtpv2_f_teid_gre_key").alias("t"), texts("gtpv2_gtpv2_f_teid_ipv4").alias("a"), texts("gtpv2_gtpv2_f_teid_interface_type").alias("i"))
    named_tunnels = F.transform(F.filter(teids, lambda x: x["a"].isNotNull() & (F.coalesce(integer_of(x["t"]), F.lit(0)) != 0)), lambda x: F.struct(F.when(integer_of(x["i"]).isin(*USER_PLANE), "gtp_teid").otherwise("gtp_teid_c").alias("kind"), F.concat_ws("/", x["a"], integer_of(x["t"]).cast("string")).alias("value")))
    header = key("gtp_teid_c", F.when(number("gtpv2_gtpv2_teid") != 0, number("gtpv2_gtpv2_teid")), F.col("dst_ip"))
    keys = F.concat(F.array(exchange, key("supi", text("e212_e212_imsi")), header), named_tunnels)
    return messages(rows, "gtpv2", label, keys, F.col("c") >= 64, details(seqno=F.col("n"), dnn=text("gtpv2_gtpv2_apn"), ebi=text("gtpv2_gtpv2_ebi")), F.when(F.col("answer") & F.col("n").isNotNull(), F.array(exchange)), cause("gtpv2", F.col("c")))


def _grouped(group: Column, code: int) -> Column:
    """The 32-bit value of an AVP without a vendor inside a group given as hex digits; its AVPs are eight bytes of head and four of value each."""
    avp = F.regexp_extract(group, f"^(?:[0-9a-f]{{24}})*?{code:08x}[0-9a-f]{{2}}00000c([0-9a-f]{{8}})", 1)
    return F.conv(F.nullif(avp, F.lit("")), 16, 10).cast("long")


def diameter(frames: DataFrame) -> DataFrame:
    f = lambda n: text(f"diameter_diameter_{n}")
    group = F.lower(F.regexp_replace(F.coalesce(f("Experimental-Result"), F.lit("")), "[^0-9A-Fa-f]", ""))
    rows = blocks(frames, "diameter").withColumns({"code": integer_of(f("cmd_code")), "base": integer_of(f("Result-Code")), "special": integer_of(f("Experimental-Result-Code")), "vendor": F.coalesce(_grouped(group, VENDOR_ID), integer_of(f("Vendor-Id"))), "redirect": F.array_join(texts("diameter_diameter_Redirect-Host"), ",")}).where("code is not null")
    request = F.lower(f("flags_request")).isin("true", "1")
    result = F.coalesce("base", "special")
    table = F.when(F.col("base").isNull() & (F.col("vendor") == VENDOR_3GPP), "diameter_3gpp").otherwise("diameter_base")
    failed = (result >= 3000) & ~((result == REDIRECT) & (F.col("redirect") != ""))
    user = f("User-Name")
    numbers = F.coalesce(msisdn_from_tbcd(f("MSISDN")), F.when(f("Subscription-Id-Type") == "0", f("Subscription-Id-Data")))
    public = f("Public-Identity")
    keys = F.array(key("diameter_session_id", f("Session-Id")), key("supi", F.coalesce(F.when(user.rlike("^[0-9]+$"), user), imsi_from_ims_identity(user))), key("impi", F.when(user.contains("@"), user)), key("impu", public), key("msisdn", F.coalesce(F.when(numbers.isNotNull(), F.concat(F.lit("+"), F.ltrim(numbers, F.lit("+")))), international_msisdn(public))))
    detail = details(command_code=F.col("code"), application_id=integer_of(f("applicationId")), session_id=f("Session-Id"), end_to_end_id=integer_of(f("endtoendid")), hop_by_hop_id=integer_of(f("hopbyhopid")), origin_host=f("Origin-Host"), destination_host=f("Destination-Host"), relay_record=F.nullif(F.array_join(texts("diameter_diameter_Route-Record"), ","), F.lit("")), redirect_host=F.nullif(F.col("redirect"), F.lit("")), retransmitted=F.when(F.lower(f("flags_T")).isin("true", "1"), "1"), icid=F.trim(f("IMS-Charging-Identifier")))
    point = F.try_element_at(F.create_map(*(F.lit(x) for kv in APPLICATIONS.items() for x in kv)), integer_of(f("applicationId")).cast("int"))
    detail = F.map_concat(detail, F.when(point.isNotNull(), F.create_map(F.lit("reference_point"), point)).otherwise(F.create_map().cast("map<string,string>")))
    label = F.concat_ws(" ", named(F.col("code"), COMMANDS, "Command-"), F.when(request, "Request").otherwise("Answer"))
    host = lambda c: F.when(F.col("src_ip").isNull(), c)
    return messages(rows, "diameter", label, keys, failed, detail, cause_=cause(table, result), src_host=host(f("Origin-Host")), dst_host=host(f("Destination-Host")))


