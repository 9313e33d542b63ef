"""A query per protocol: events written as dissected frames, read back and normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave import normalise as N
from callweave.operators.sequences import detail
from callweave.plans.registry import query
from callweave.plans.standins import messages
from callweave.sources import readers as RD


def label_is(name: str) -> Column:
    return F.col("label") == name


def by_label(**values: str) -> Column:
    """A text per event type."""
    return F.coalesce(*(F.when(label_is(k), F.lit(v)) for k, v in values.items()))


def dissected(spark, d: str, layers: dict[str, Column]) -> DataFrame:
    """events as frames with the given layers beside frame and ip."""
    rows = messages(spark, d).withColumns({"k": detail("seqno").cast("int"), "user": F.col("flow_id").cast("int")})
    base = {"frame": F.struct(F.col("frame").cast("string").alias("frame_frame_number")), "ip": F.struct(F.col("src.ip").alias("ip_ip_src"), F.col("dst.ip").alias("ip_ip_dst"))}
    held = F.struct(*(c.alias(n) for n, c in {**base, **layers}.items()))
    lines = rows.select("capture_id", F.to_json(F.struct((F.col("ts") * 1000).cast("decimal(20,3)").cast("string").alias("timestamp"), held.alias("layers"))).alias("value"))
    return RD.with_endpoints(RD.parse_frames(lines))


def shown(rows: DataFrame) -> DataFrame:
    """Messages with keys, releases and cause as texts."""
    flat = lambda c: F.array_join(F.array_sort(F.transform(c, lambda k: F.concat_ws("=", k["kind"], k["value"]))), " ")
    return rows.select("capture_id", "frame", "protocol", "label", flat("keys").alias("keys"), F.size("releases").alias("releases"), F.concat_ws(" ", "cause.table", "cause.value").alias("cause"), "is_failure", F.col("src.role").alias("src_role"), F.col("dst.role").alias("dst_role"))


SCOPE = "case when src_ip < dst_ip then src_ip || ',' || dst_ip else dst_ip || ',' || src_ip end"


def select(protocol: str, label: str, keys: str, releases: str = "0", cause: str = "''", failed: str = "false", src: str = "null", dst: str = "null", where: str = "true") -> str:
    return f"select capture_id, frame, '{protocol}' as protocol, {label} as label, {keys} as keys, ({releases})::int as releases, {cause} as cause, coalesce({failed}, false) as is_failure, {src}::varchar src_role, {dst}::varchar dst_role from m where {where}"


def block(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query(select("ngap", "case label when 'view' then 'InitialUEMessage' when 'click' then 'InitialContextSetupResponse' when 'signup' then 'UEContextReleaseResponse' when 'purchase' then 'UEContextReleaseRequest' else 'SecondaryRATDataUsageReportFailure' end", f"'amf_ue_ngap_id=' || {SCOPE} || '/' || k || ' ran_ue_ngap_id=' || {SCOPE} || '/' || user_id", "case when label = 'signup' then 2 else 0 end", "case when label = 'error' then 'ngap_radioNetwork ' || k else '' end", "label = 'error'"))
def normalised_ngap(spark, d):
    p = "ngap_ngap_"
    outcome = lambda *names: F.when(F.col("label").isin(*names), F.lit("1"))
    fields = {p + "procedureCode": by_label(view="15", click="14", signup="41", purchase="42", error="52"), p + "initiatingMessage_element": outcome("view", "purchase"), p + "successfulOutcome_element": outcome("click", "signup"), p + "unsuccessfulOutcome_element": outcome("error"), p + "RAN_UE_NGAP_ID": text("user"), p + "AMF_UE_NGAP_ID": text("k"), p + "radioNetwork": F.when(label_is("error"), text("k"))}
    return shown(N.normalise(dissected(spark, d, {"ngap": block(**fields)}), ["ngap"]))


@query(select("s1ap", "case label when 'view' then 'initialUEMessage' when 'click' then 'InitialContextSetupResponse' when 'signup' then 'UEContextReleaseComplete' when 'purchase' then 'UEContextReleaseRequest' else 'ENBConfigurationUpdateFailure' end", f"'enb_ue_s1ap_id=' || {SCOPE} || '/' || user_id || ' mme_ue_s1ap_id=' || {SCOPE} || '/' || k", "case when label = 'signup' then 2 else 0 end", "case when label = 'error' then 's1ap_misc ' || k else '' end", "label = 'error'"))
def normalised_s1ap(spark, d):
    p = "s1ap_s1ap_"
    outcome = lambda *names: F.when(F.col("label").isin(*names), F.lit("1"))
    fields = {p + "procedureCode": by_label(view="12", click="9", signup="23", purchase="18", error="29"), p + "successfulOutcome_element": outcome("click", "signup"), p + "unsuccessfulOutcome_element": outcome("error"), p + "ENB_UE_S1AP_ID": text("user"), p + "MME_UE_S1AP_ID": text("k"), p + "misc": F.when(label_is("error"), text("k"))}
    return shown(N.normalise(dissected(spark, d, {"s1ap": block(**fields)}), ["s1ap"]))


@query(select("gtpv2", "case label when 'view' then 'Create Session Request' when 'click' then 'Create Session Response' when 'signup' then 'Modify Bearer Request' when 'purchase' then 'Delete Session Response' else 'Modify Bearer Response' end", "case when k > 0 and k % 2 = 0 then 'gtp_teid=10.7.0.1/' || k || ' ' when k > 0 then 'gtp_teid_c=10.7.0.1/' || k || ' ' else '' end || 'gtpv2_transaction=' || case when label in ('view', 'signup') then src_ip || '>' || dst_ip else dst_ip || '>' || src_ip end || '/' || user_id", "case when label in ('view', 'signup') then 0 else 1 end", "'gtpv2 ' || case when label = 'error' then 72 else 16 end", "label = 'error'"))
def normalised_gtpv2(spark, d):
    p = "gtpv2_gtpv2_"
    fields = {p + "message_type": by_label(view="32", click="33", signup="34", purchase="37", error="35"), p + "seq": text("user"), p + "cause": by_label(view="16", click="16", signup="16", purchase="16", error="72"), p + "f_teid_gre_key": text("k"), p + "f_teid_ipv4": F.lit("10.7.0.1"), p + "f_teid_interface_type": F.when(F.col("k") % 2 == 0, "22").otherwise("10")}
    return shown(N.normalise(dissected(spark, d, {"gtpv2": block(**fields)}), ["gtpv2"]))


@query(select("sbi", "case when label in ('view', 'click') then 'GET /nudm-sdm/v2/imsi-' || lpad(user_id::varchar, 9, '1') || '/am-data' when label = 'error' then '404' else '200' end", f"'sbi_stream=' || {SCOPE} || '/' || k || case when label in ('view', 'click') then ' supi=' || lpad(user_id::varchar, 9, '1') else '' end", failed="label = 'error'", where="label <> 'signup'"))
def normalised_sbi(spark, d):
    p = "http2_http2_"
    asks = F.col("label").isin("view", "click")
    fields = {p + "type": F.when(label_is("signup"), "0").otherwise("1"), p + "streamid": text("k"), p + "headers_method": F.when(asks, "GET"), p + "headers_path": F.when(asks, F.concat(F.lit("/nudm-sdm/v2/imsi-"), F.lpad(text("user"), 9, "1"), F.lit("/am-data"))), p + "headers_status": by_label(purchase="200", error="404")}
    return shown(N.normalise(dissected(spark, d, {"http2": block(**fields)}), ["sbi"]))


FIVEG = "case label when 'view' then 'Registration request' when 'click' then 'Registration accept' when 'signup' then 'PDU session establishment request' when 'purchase' then 'Service request' else 'Registration reject' end"


@query(select("nas-5gs", FIVEG, f"'ran_ue_ngap_id=' || {SCOPE} || '/' || user_id || case when label = 'view' then ' supi=00101' || k else '' end", cause="case when label = 'error' then 'nas_5gmm ' || k else '' end", failed="label = 'error'"))
def normalised_nas_5gs(spark, d):
    """NAS inside NGAP; every third message two blocks deeper."""
    p, e = "nas-5gs_nas-5gs_", "e212_e212_"
    view = label_is("view")
    inner = block(**{p + "mm_message_type": by_label(view="0x41", click="0x42", purchase="0x4c", error="0x44"), p + "sm_message_type": by_label(signup="0xc1"), p + "mm_5gmm_cause": F.when(label_is("error"), text("k")), e + "mcc": F.when(view, "001"), e + "mnc": F.when(view, "01"), p + "mm_suci_msin": F.when(view, text("k"))})
    deep = F.col("k") % 3 == 0
    ngap = F.struct(F.lit("46").alias("ngap_ngap_procedureCode"), text("user").alias("ngap_ngap_RAN_UE_NGAP_ID"), F.when(~deep, inner).alias("nas-5gs"), F.when(deep, F.struct(F.struct(inner.alias("nas-5gs")).alias("nas-eps"))).alias("s1ap"))
    return shown(N.normalise(dissected(spark, d, {"ngap": ngap}), ["nas-5gs"]))


EPS = "case label when 'view' then 'Attach request' when 'click' then 'Attach accept' when 'signup' then 'PDN connectivity request' when 'purchase' then 'Service request' else 'Attach reject' end"


@query(select("nas-eps", EPS, "'supi=00101' || k", cause="case when label = 'error' then 'nas_eps_emm ' || k else '' end", failed="label = 'error'"))
def normalised_nas_eps(spark, d):
    """NAS inside GTPv2, with the carrier's subscriber."""
    p = "nas-eps_nas-eps_"
    inner = block(**{p + "nas_msg_emm_type": by_label(view="0x41", click="0x42", error="0x44"), p + "nas_msg_esm_type": by_label(signup="0xd0"), p + "security_header_type": by_label(purchase="12"), p + "emm_cause": F.when(label_is("error"), text("k"))})
    gtpv2 = F.struct(F.lit("133").alias("gtpv2_gtpv2_message_type"), F.concat(F.lit("00101"), text("k")).alias("e212_e212_imsi"), inner.alias("nas-eps"))
    return shown(N.normalise(dissected(spark, d, {"gtpv2": gtpv2}), ["nas-eps"]))


@query(select("sip", "case label when 'view' then 'INVITE' when 'click' then '180 Ringing' when 'signup' then '401 Unauthorized' when 'purchase' then 'BYE' else '486 Busy Here' end", "'impu=sip:+1555' || lpad(user_id::varchar, 7, '0') || '@ims.example' || ' msisdn=+1555' || lpad(user_id::varchar, 7, '0') || ' sip_call_id=' || k", "case when label = 'purchase' then 1 else 0 end", "case label when 'signup' then 'sip_status 401' when 'error' then 'sip_status 486' else '' end", "label = 'error'"))
def normalised_sip(spark, d):
    p = "sip_sip_"
    fields = {p + "Method": by_label(view="INVITE", purchase="BYE"), p + "Status-Code": by_label(click="180", signup="401", error="486"), p + "Status-Line": by_label(click="SIP/2.0 180 Ringing", signup="SIP/2.0 401 Unauthorized", error="SIP/2.0 486 Busy Here"), p + "Call-ID": text("k"), p + "from_addr": F.concat(F.lit("sip:+1555"), F.lpad(text("user"), 7, "0"), F.lit("@ims.example"))}
    return shown(N.normalise(dissected(spark, d, {"sip": block(**fields)}), ["sip"]))


@query(select("megaco", "case when label in ('view', 'click') then 'Add Request' when label = 'signup' then 'Modify Request' else 'Subtract Reply' end", "case when k > 0 then 'h248_context=' || case when label in ('view', 'click', 'signup') then dst_ip else src_ip end || '/' || k || ' ' else '' end || 'h248_transaction=' || case when label in ('view', 'click', 'signup') then src_ip else dst_ip end || '/' || user_id", "case when label in ('purchase', 'error') and k > 0 then 1 else 0 end", "case when label = 'error' then 'megaco_error 430' else '' end", "label = 'error'", "case when label in ('view', 'click', 'signup') then 'MGC' else 'MGW' end", "case when label in ('view', 'click', 'signup') then 'MGW' else 'MGC' end"))
def normalised_h248(spark, d):
    p = "megaco_megaco_"
    fields = {p + "command": by_label(view="Add", click="Add", signup="Modify", purchase="Subtract", error="Subtract"), p + "transaction": F.when(F.col("label").isin("purchase", "error"), "Reply").otherwise("Transaction"), p + "context": text("k"), p + "transid": text("user"), p + "error_code": F.when(label_is("error"), "430")}
    return shown(N.normalise(dissected(spark, d, {"megaco": block(**fields)}), ["megaco"]))


@query(select("diameter", "'3GPP-Update-Location ' || case when label in ('view', 'signup') then 'Request' else 'Answer' end", "'diameter_session_id=s;' || k || ' supi=00101' || lpad(user_id::varchar, 10, '0')", cause="case label when 'click' then 'diameter_base 2001' when 'purchase' then 'diameter_3gpp 5420' when 'error' then 'diameter_base 3006' else '' end", failed="label = 'purchase' or (label = 'error' and k % 2 = 0)"))
def normalised_diameter(spark, d):
    """The vendor stands in the group of the result, other vendors beside it."""
    p = "diameter_diameter_"
    group = F.lit("0000010a4000000c000028af" + "0000012a4000000c0000152c")
    fields = {p + "cmd_code": F.lit("316"), p + "applicationId": F.lit("16777251"), p + "flags_request": F.when(F.col("label").isin("view", "signup"), "1").otherwise("0"), p + "Session-Id": F.concat(F.lit("s;"), text("k")), p + "User-Name": F.concat(F.lit("00101"), F.lpad(text("user"), 10, "0")), p + "Result-Code": by_label(click="2001", error="3006"), p + "Vendor-Id": F.lit("999"), p + "Experimental-Result": F.when(label_is("purchase"), group), p + "Experimental-Result-Code": F.when(label_is("purchase"), "5420"), p + "Redirect-Host": F.when(label_is("error") & (F.col("k") % 2 == 1), "aaa://h")}
    return shown(N.normalise(dissected(spark, d, {"diameter": block(**fields)}), ["diameter"]))


@query(select("sgsap", "case label when 'view' then 'SGsAP-LOCATION-UPDATE-REQUEST' when 'click' then 'SGsAP-LOCATION-UPDATE-ACCEPT' when 'signup' then 'SGsAP-PAGING-REQUEST' when 'purchase' then 'SGsAP-SERVICE-REQUEST' else 'SGsAP-LOCATION-UPDATE-REJECT' end", "'supi=00101' || lpad(user_id::varchar, 10, '0')", failed="label = 'error'", src="case when label in ('view', 'purchase') then 'MME' else 'VLR' end", dst="case when label in ('view', 'purchase') then 'VLR' else 'MME' end"))
def normalised_sgsap(spark, d):
    fields = {"sgsap_sgsap_msg_type": by_label(view="9", click="10", signup="1", purchase="6", error="11"), "e212_e212_imsi": F.concat(F.lit("00101"), F.lpad(text("user"), 10, "0"))}
    return shown(N.normalise(dissected(spark, d, {"sgsap": block(**fields)}), ["sgsap"]))


@query(select("enum", "case when label = 'view' then 'NAPTR Query' else 'NAPTR Response' end", "'msisdn=+1555' || lpad(user_id::varchar, 6, '0')", failed="label = 'error'", src="case when label <> 'view' then 'ENUM' end", dst="case when label = 'view' then 'ENUM' end", where="label <> 'signup'"))
def normalised_enum(spark, d):
    digits = F.reverse(F.concat(F.lit("1555"), F.lpad(text("user"), 6, "0")))
    name = F.concat(F.regexp_replace(digits, "(.)", "$1."), F.lit("e164.arpa"))
    fields = {"dns_dns_qry_type": F.when(label_is("signup"), "1").otherwise("35"), "dns_dns_qry_name": name, "dns_dns_flags_response": F.when(label_is("view"), "0").otherwise("1"), "dns_dns_flags_rcode": by_label(click="0", purchase="3", error="2")}
    return shown(N.normalise(dissected(spark, d, {"dns": block(**fields)}), ["enum"]))


@query(select("gtp", "case when label = 'error' then 'Error Indication' when label = 'view' then 'Echo Request' else 'G-PDU' end", "case when k > 0 then 'gtp_teid=' || dst_ip || '/' || k else '' end", failed="label = 'error'"))
def normalised_gtpu(spark, d):
    fields = {"gtp_gtp_message": by_label(view="1", click="255", signup="255", purchase="255", error="26"), "gtp_gtp_teid": text("k")}
    return shown(N.normalise(dissected(spark, d, {"gtp": block(**fields)}), ["gtp"]))


@query("select capture_id, case when label = 'view' then 'ciphered-nas' else 'undecoded-stream' end kind, case when label = 'click' then " + SCOPE + " || '/' || k end as key, count(*) n from m where label in ('view', 'click') group by 1, 2, 3")
def blind_spots(spark, d):
    nas = F.when(label_is("view"), F.struct(F.lit("2").alias("nas-5gs_nas-5gs_security_header_type")))
    http = F.when(label_is("click"), F.struct(F.lit("1").alias("http2_http2_type"), text("k").alias("http2_http2_streamid")))
    return N.nas.blind_spots(dissected(spark, d, {"nas-5gs": nas, "http2": http}))
