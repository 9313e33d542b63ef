"""IMS and media: SIP, ENUM, H.248."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.scalars import imsi_from_ims_identity, integer_of, international_msisdn, msisdn_from_enum_name
from callweave.normalise.core import blocks, cause, details, key, messages, number, text, texts

NAPTR = 35


# What stands for the host: an address in brackets, all up to a single colon, or IPv6 without brackets.
CONTACT_HOST = r"(?i)^(?:sips?:)?(?:[^@]*@)?(?:\[([^\]]*)\].*|([^:;]+)(?::[0-9]+)?(?:;.*)?|([^;]*)(?:;.*)?)$"


def _contact_claims(rows: DataFrame) -> DataFrame:
    """claim: ip=UE;ip=P-CSCF where a Contact names its own sender and carries a subscriber: an IMSI as user part, or a device instance."""
    rows = rows.withColumns({"contact": text("sip_sip_Contact"), "uri": F.coalesce(text("sip_sip_contact_addr"), text("sip_sip_Contact"))})
    rows = rows.withColumn("uri", F.regexp_replace("uri", "^[^<]*<([^>]*)>.*$", "$1"))
    own = F.regexp_replace("uri", CONTACT_HOST, "$1$2$3") == F.col("src_ip")
    subscriber = F.col("uri").rlike(r"(?i)^(?:sips?:)?[0-9]{14,15}@") | F.coalesce(F.col("contact").contains("+sip.instance"), F.lit(False))
    return rows.withColumn("claim", F.when(own & subscriber & F.col("dst_ip").isNotNull(), F.concat("src_ip", F.lit("=UE;"), "dst_ip", F.lit("=P-CSCF"))))


def sip(frames: DataFrame) -> DataFrame:
    f = lambda n: text(f"sip_sip_{n}")
    rows = blocks(frames.withColumn("protected", F.try_variant_get("layers", "$.esp", "variant").isNotNull()), "sip").withColumns({"status": integer_of(f("Status-Code")), "method": f("Method"), "call": f("Call-ID")})
    rows = _contact_claims(rows)
    status = F.col("status")
    reason = F.trim(F.regexp_extract(f("Status-Line"), r"^SIP/2\.0 [0-9]{3} ?(.*)$", 1))
    label = F.when(status.isNotNull(), F.trim(F.concat_ws(" ", status.cast("string"), reason))).otherwise(F.col("method"))
    who = f("from_addr")
    user = f("auth_username")
    media = F.transform(F.filter(F.arrays_zip(texts("sdp_sdp_connection_info_address").alias("a"), texts("sdp_sdp_media_port").alias("p")), lambda m: m["a"].isNotNull() & m["p"].isNotNull() & (m["p"] != "0")), lambda m: F.struct(F.lit("media_endpoint").alias("kind"), F.concat_ws(":", m["a"], m["p"]).alias("value")))
    keys = F.concat(F.array(key("sip_call_id", F.col("call")), key("impu", who), key("supi", F.coalesce(imsi_from_ims_identity(who), imsi_from_ims_identity(user))), key("impi", user), key("msisdn", international_msisdn(who))), media)
    q850, own = integer_of(f("reason_cause_q850")), integer_of(f("reason_cause_sip"))
    given = F.when(status >= 300, cause("sip_status", status)).when(q850.isNotNull(), cause("q850", q850)).when(own.isNotNull(), cause("sip_status", own))
    failed = (status >= 400) & ~status.isin(401, 407)
    detail = details(ipsec_roles=F.when(F.col("protected"), F.lit("UE|P-CSCF")), fallback_role_hints=F.col("claim"), CSeq=f("CSeq"), cseq_method=f("CSeq_method"), from_tag=f("from_tag"), to_tag=f("to_tag"), From=who, To=f("to_addr"), Request_URI=f("r-uri"), P_Asserted_Identity=f("P-Asserted-Identity"), Privacy=f("Privacy"), access_type=F.regexp_extract(f("P-Access-Network-Info"), r"^([^;]+)", 1), icid=f("icid_value"), dedupe_id=F.when(F.col("call").isNotNull(), F.concat_ws("/", "call", f("CSeq"))))
    released = F.when(F.col("method") == "BYE", F.array(key("sip_call_id", F.col("call"))))
    return messages(rows, "sip", label, keys, failed, detail, released, given)


def enum(frames: DataFrame) -> DataFrame:
    rows = blocks(frames, "dns").where(number("dns_dns_qry_type") == NAPTR).withColumns({"name": text("dns_dns_qry_name"), "rcode": number("dns_dns_flags_rcode"), "answer": F.lower(text("dns_dns_flags_response")).isin("true", "1")})
    number_ = msisdn_from_enum_name(F.col("name"))
    label = F.when(F.col("answer"), "NAPTR Response").otherwise("NAPTR Query")
    server = F.lit("ENUM")
    rows = rows.where(number_.isNotNull())
    return messages(rows, "enum", label, F.array(key("msisdn", number_)), F.col("answer") & ~F.coalesce("rcode", F.lit(0)).isin(0, 3), details(id=text("dns_dns_id"), service=text("dns_dns_naptr_service"), regex=text("dns_dns_naptr_regex")), src_role=F.when(F.col("answer"), server), dst_role=F.when(~F.col("answer"), server))


def megaco(frames: DataFrame) -> DataFrame:
    """One message per command; a context key belongs to the gateway; Subtract replies release it."""
    rows = blocks(frames, "megaco").select("*", F.posexplode_outer(texts("megaco_megaco_command")).alias("i", "command")).where("command is not null").withColumn("block", F.col("block") * 1000 + F.col("i"))
    context, transaction = text("megaco_megaco_context"), text("megaco_megaco_transaction")
    reply = F.lower(F.coalesce(transaction, F.lit(""))).contains("reply")
    gateway = F.when(reply, F.col("src_ip")).otherwise(F.col("dst_ip"))
    own = key("h248_context", F.when(context.isNotNull() & ~F.upper(context).isin("$", "*", "CHOOSE", "ALL", "0", "NULL"), context), gateway)
    asker = F.when(reply, F.col("dst_ip")).otherwise(F.col("src_ip"))
    keys = F.array(own, key("h248_transaction", text("megaco_megaco_transid"), asker))
    label = F.concat_ws(" ", "command", F.when(reply, "Reply").otherwise("Request"))
    error = number("megaco_megaco_error_code")
    roles = lambda a, b: F.when(reply, a).otherwise(b)
    return messages(rows, "megaco", label, keys, error.isNotNull(), details(termid=text("megaco_megaco_termid"), error=text("megaco_megaco_error_string")), F.when(reply & (F.col("command") == "Subtract") & own.isNotNull(), F.array(own)), cause("megaco_error", error), src_role=roles("MGW", "MGC"), dst_role=roles("MGC", "MGW"))
