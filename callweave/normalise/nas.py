"""NAS of both generations, alone or inside its carrier, and what of it can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.normalise.access import ngap_rows, s1ap_rows
from callweave.normalise.core import blocks, cause, details, key, messages, named, number, scoped, text

# 5GMM and 5GSM message types (3GPP TS 24.501).
FIVEG = {
    0x41: "Registration request", 0x42: "Registration accept", 0x43: "Registration complete", 0x44: "Registration reject", 0x45: "Deregistration request (UE originating)", 0x46: "Deregistration accept (UE originating)",
    0x47: "Deregistration request (UE terminated)", 0x48: "Deregistration accept (UE terminated)", 0x4C: "Service request", 0x4D: "Service reject", 0x4E: "Service accept", 0x4F: "Control plane service request",
    0x54: "Configuration update command", 0x55: "Configuration update complete", 0x56: "Authentication request", 0x57: "Authentication response", 0x58: "Authentication reject", 0x59: "Authentication failure",
    0x5A: "Authentication result", 0x5B: "Identity request", 0x5C: "Identity response", 0x5D: "Security mode command", 0x5E: "Security mode complete", 0x5F: "Security mode reject", 0x64: "5GMM status", 0x65: "Notification",
    0x66: "Notification response", 0x67: "UL NAS transport", 0x68: "DL NAS transport", 0xC1: "PDU session establishment request", 0xC2: "PDU session establishment accept", 0xC3: "PDU session establishment reject",
    0xC4: "PDU session authentication command", 0xC5: "PDU session authentication complete", 0xC6: "PDU session authentication result", 0xC9: "PDU session modification request", 0xCA: "PDU session modification reject",
    0xCB: "PDU session modification command", 0xCC: "PDU session modification complete", 0xCD: "PDU session modification command reject", 0xD1: "PDU session release request", 0xD2: "PDU session release reject",
    0xD3: "PDU session release command", 0xD4: "PDU session release complete", 0xD6: "5GSM status",
}
# EMM and ESM message types (3GPP TS 24.301).
EPS = {
    0x41: "Attach request", 0x42: "Attach accept", 0x43: "Attach complete", 0x44: "Attach reject", 0x45: "Detach request", 0x46: "Detach accept", 0x48: "Tracking area update request", 0x49: "Tracking area update accept",
    0x4A: "Tracking area update complete", 0x4B: "Tracking area update reject", 0x4C: "Extended service request", 0x4D: "Control plane service request", 0x4E: "Service reject", 0x4F: "Service accept",
    0x50: "GUTI reallocation command", 0x51: "GUTI reallocation complete", 0x52: "Authentication request", 0x53: "Authentication response", 0x54: "Authentication reject", 0x55: "Identity request", 0x56: "Identity response",
    0x5C: "Authentication failure", 0x5D: "Security mode command", 0x5E: "Security mode complete", 0x5F: "Security mode reject", 0x60: "EMM status", 0x61: "EMM information", 0x62: "Downlink NAS transport",
    0x63: "Uplink NAS transport", 0xC1: "Activate default EPS bearer context request", 0xC2: "Activate default EPS bearer context accept", 0xC3: "Activate default EPS bearer context reject",
    0xC5: "Activate dedicated EPS bearer context request", 0xC6: "Activate dedicated EPS bearer context accept", 0xC7: "Activate dedicated EPS bearer context reject", 0xC9: "Modify EPS bearer context request",
    0xCA: "Modify EPS bearer context accept", 0xCB: "Modify EPS bearer context reject", 0xCD: "Deactivate EPS bearer context request", 0xCE: "Deactivate EPS bearer context accept", 0xD0: "PDN connectivity request",
    0xD1: "PDN connectivity reject", 0xD2: "PDN disconnect request", 0xD3: "PDN disconnect reject", 0xD4: "Bearer resource allocation request", 0xD5: "Bearer resource allocation reject", 0xD9: "ESM information request",
    0xDA: "ESM information response", 0xE8: "ESM status",
}
SERVICE_REQUEST_HEADER = 12
TMSI_TYPES = (2, 4)


#: Layers that may stand between a carrier and the NAS block it holds, and how deep they are looked through.
BETWEEN, DEPTH = ("nas-5gs", "nas-eps", "ngap", "s1ap"), 3


def _children(block: Column, layer: str) -> Column:
    """Blocks of a layer directly inside a block: an object or a list of them."""
    many, one = F.try_variant_get(block, f"$['{layer}']", "array<variant>"), F.try_variant_get(block, f"$['{layer}']", "variant")
    return F.when(many.isNotNull(), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<variant>"))


def _inside(carrier: DataFrame, layer: str, name: str) -> DataFrame:
    """Blocks of a layer nested in carrier blocks, up to DEPTH levels deep, with the carrier's keys."""
    level, found = F.array("b"), F.array().cast("array<variant>")
    for _ in range(DEPTH):
        found = F.concat(found, F.flatten(F.transform(level, lambda x: _children(x, layer))))
        level = F.flatten(F.transform(level, lambda x: F.concat(*(_children(x, other) for other in BETWEEN))))
    held = carrier.select("*", F.posexplode(found).alias("i", "nested"))
    return held.withColumns({"b": F.col("nested"), "block": F.col("block") * 100 + F.col("i"), "carrier": F.lit(name)}).drop("i", "nested", "code", "outcome")


def carried(frames: DataFrame, layer: str) -> DataFrame:
    """Every block of the NAS layer once: under its carrier, else at the top."""
    none = F.array().cast("array<struct<kind:string,value:string>>")
    if layer == "nas-5gs":
        carriers = [("ngap", ngap_rows(frames)), ("sbi", blocks(frames, "http2").withColumn("__keys", none))]
    else:
        carriers = [("s1ap", s1ap_rows(frames)), ("gtpv2", blocks(frames, "gtpv2").withColumn("__keys", F.array_compact(F.array(key("supi", text("e212_e212_imsi"))))))]
    out = blocks(frames, layer).withColumns({"__keys": none, "carrier": F.lit(None).cast("string")})
    for name, rows in carriers:
        out = out.unionByName(_inside(rows, layer, name))
    return out


def _label(a: Column, b: Column, names: dict[int, str]) -> Column:
    return F.when(F.coalesce(a, b).isNotNull(), named(F.coalesce(a, b), names, "NAS message type "))


def nas5gs(frames: DataFrame) -> DataFrame:
    f = lambda n: f"nas-5gs_nas-5gs_{n}"
    rows = carried(frames, "nas-5gs").withColumns({"mm": number(f("mm_message_type")), "sm": number(f("sm_message_type"))})
    label = _label(F.col("mm"), F.col("sm"), FIVEG)
    supi = F.concat(text("e212_e212_mcc"), text("e212_e212_mnc"), text(f("mm_suci_msin")))
    low = F.lower(F.lpad(F.hex(number(f("5g_tmsi"))), 8, "0"))
    tmsi = F.when(number(f("mm_type_id")).isin(*TMSI_TYPES), F.concat(number(f("amf_set_id")).cast("string"), F.lit("-"), number(f("amf_pointer")).cast("string"), F.lit("-"), low))
    keys = F.concat("__keys", F.array(key("supi", supi), scoped("fiveg_s_tmsi", tmsi)))
    failed = F.lower(label).rlike("reject|authentication failure")
    given = F.when(F.col("mm").isNotNull(), cause("nas_5gmm", number(f("mm_5gmm_cause")))).otherwise(cause("nas_5gsm", number(f("sm_5gsm_cause"))))
    detail = details(registration_type=text(f("mm_5gs_reg_type")), pdu_session_id=text(f("pdu_session_id")), ue_ipv4=text(f("sm_pdu_addr_inf_ipv4")), dnn=text(f("cmn_dnn")), sst=text(f("mm_sst")), qfi=text(f("sm_qfi")), identity_from=F.when(supi.isNull(), F.col("carrier")))
    return messages(rows, "nas-5gs", label, keys, failed, detail, cause_=given)


def naseps(frames: DataFrame) -> DataFrame:
    f = lambda n: f"nas-eps_nas-eps_{n}"
    rows = carried(frames, "nas-eps").withColumns({"mm": number(f("nas_msg_emm_type")), "sm": number(f("nas_msg_esm_type"))})
    label = F.coalesce(_label(F.col("mm"), F.col("sm"), EPS), F.when(number(f("security_header_type")) == SERVICE_REQUEST_HEADER, "Service request"))
    low = F.lower(F.lpad(F.hex(number(f("emm_m_tmsi"))), 8, "0"))
    keys = F.concat("__keys", F.array(key("supi", text("e212_e212_imsi")), key("s_tmsi", F.concat(number(f("emm_mme_code")).cast("string"), F.lit("-"), low))))
    given = F.when(F.col("mm").isNotNull(), cause("nas_eps_emm", number(f("emm_cause")))).otherwise(cause("nas_eps_esm", number(f("esm_cause"))))
    return messages(rows, "nas-eps", label, keys, F.lower(label).rlike("reject|failure"), details(identity_from=F.when(text("e212_e212_imsi").isNull(), F.col("carrier"))), cause_=given)


def blind_spots(frames: DataFrame) -> DataFrame:
    """Per capture: NAS that is ciphered, SUCIs that can't be undone, HTTP/2 streams whose headers weren't decoded."""
    g = lambda n: f"nas-5gs_nas-5gs_{n}"
    five = carried(frames, "nas-5gs")
    eps = carried(frames, "nas-eps")
    untyped = number(g("mm_message_type")).isNull() & number(g("sm_message_type")).isNull()
    hidden = five.where(untyped & (number(g("security_header_type")) != 0)).select("capture_id", F.lit("ciphered-nas").alias("kind"), F.lit(None).cast("string").alias("key"))
    e = lambda n: f"nas-eps_nas-eps_{n}"
    untyped = number(e("nas_msg_emm_type")).isNull() & number(e("nas_msg_esm_type")).isNull()
    header = number(e("security_header_type"))
    hidden = hidden.unionByName(eps.where(untyped & (header != 0) & (header != SERVICE_REQUEST_HEADER)).select("capture_id", F.lit("ciphered-nas").alias("kind"), F.lit(None).cast("string").alias("key")))
    suci = five.where((text(g("mm_suci_scheme_id")).isNotNull() | text(g("mm_suci_supi_fmt")).isNotNull()) & text(g("mm_suci_msin")).isNull())
    hidden = hidden.unionByName(suci.select("capture_id", F.lit("protected-suci").alias("kind"), F.lit(None).cast("string").alias("key")))
    http = blocks(frames, "http2").where((number("http2_http2_type") == 1) & text("http2_http2_headers_method").isNull() & text("http2_http2_headers_status").isNull())
    hidden = hidden.unionByName(http.select("capture_id", F.lit("undecoded-stream").alias("kind"), scoped("sbi_stream", number("http2_http2_streamid"))["value"].alias("key")))
    return hidden.groupBy("capture_id", "kind", "key").agg(F.count("*").alias("n"))
