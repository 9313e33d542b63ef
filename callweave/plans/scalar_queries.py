"""Queries of the column functions: identifiers made from the customers' keys, with what each must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import scalars as S
from callweave.plans.registry import query, table
from callweave.plans.standins import messages

K = "c_custkey"
DIGITS = "lpad(c_custkey::varchar, 8, '0')"


def customers(spark, d):
    return table(spark, d, "customer").select(K, F.col(K).cast("string").alias("s"), (F.col(K) % 6).alias("v"), F.lpad(F.col(K).cast("string"), 8, "0").alias("digits"))


def cases(*columns):
    """A column per remainder of the key."""
    return F.coalesce(*(F.when(F.col("v") == n, c) for n, c in enumerate(columns) if c is not None))


@query("with u as (select c_custkey, case c_custkey % 6 when 0 then '+1555' || " + DIGITS + " when 1 then case when c_custkey >= 10 then '+44' || c_custkey end when 2 then '9' || " + DIGITS + " when 4 then '7' || " + DIGITS + " end msisdn from customer) select c_custkey, msisdn, case when msisdn like '+%' and length(msisdn) >= 9 then msisdn end international from u")
def msisdns(spark, d):
    c, lit = F.concat, F.lit
    uri = cases(c(lit("tel:+1555"), "digits"), c(lit("sip:+44"), "s", lit("@ims.example")), c(lit("<sip:9"), "digits", lit("@h;user=phone>")), c(lit("sip:user"), "s", lit("@h")), c(lit("sip:7"), "digits", lit(";phone-context=+1@h")))
    return customers(spark, d).select(K, S.msisdn_of(uri).alias("msisdn"), S.international_msisdn(uri).alias("international"))


@query("select c_custkey, case when c_custkey % 2 = 0 then '44' || " + DIGITS + " else '444' || " + DIGITS + " end msisdn, case when c_custkey % 6 < 5 then '+44' || " + DIGITS + " end enum from customer")
def coded_numbers(spark, d):
    """TBCD digits, swapped and filled, and names under e164.arpa; those too short give none."""
    number = F.concat(F.when(F.col("v") % 2 == 0, "44").otherwise("444"), "digits")
    even = F.when(F.length(number) % 2 == 1, F.concat(number, F.lit("f"))).otherwise(number)
    tbcd = F.regexp_replace(even, "(.)(.)", "$2$1")
    name = F.when(F.col("v") < 5, F.concat(F.regexp_replace(F.reverse(F.concat(F.lit("44"), "digits")), "(.)", "$1."), F.lit("E164.arpa."))).otherwise("7.6.5.4.3.2.1.e164.arpa")
    return customers(spark, d).select(K, S.msisdn_from_tbcd(tbcd).alias("msisdn"), S.msisdn_from_enum_name(name).alias("enum"))


@query("select c_custkey, case c_custkey % 6 when 0 then '0010100' || " + DIGITS + " when 1 then '001010' || " + DIGITS + " end imsi, case c_custkey % 6 when 0 then '00101' || c_custkey when 1 then '99970' || c_custkey end supi from customer")
def subscriber_numbers(spark, d):
    c, lit = F.concat, F.lit
    home = lit("@ims.mnc001.mcc001.3gppnetwork.org")
    identity = cases(c(lit("sip:0010100"), "digits", home), c(lit("001010"), "digits", home), c(lit("00101"), "digits", home), c(lit("sip:0010100"), "digits", lit("@example.org")), c(lit("sip:+1"), "digits", home))
    identifier = cases(c(lit("imsi-00101"), "s"), c(lit("suci-0-999-70-0-0-0-"), "s"), c(lit("suci-0-999-70-0-1-0-"), "s"), c(lit("suci-1-999-70-0-0-0-"), "s"), c(lit("imsi-x"), "s"), c(lit("nai-"), "s"))
    return customers(spark, d).select(K, S.imsi_from_ims_identity(identity).alias("imsi"), S.supi_from_identifier(identifier).alias("supi"))


@query("select c_custkey, case c_custkey % 6 when 3 then null else c_custkey end as value, (c_custkey // 64)::bigint as bits from customer")
def integers_of_texts(spark, d):
    n, low = F.col(K), F.lower(F.lpad(F.hex(K), 8, "0"))
    written = cases(F.col("s"), F.concat(F.lit("0x"), low), F.concat(F.lit(" 0X"), F.hex(K)), F.concat(F.lit("v"), "s"), F.concat_ws(":", *(F.substring(low, p, 2) for p in (1, 3, 5, 7))), F.concat("s", F.lit(" ")))
    return customers(spark, d).select(K, S.integer_of(written).alias("value"), S.bit_string(n, 10, 2).alias("bits"))


@query("select c_custkey, case when c_custkey % 6 < 3 then '10.0.0.1,10.0.0.' || (2 + c_custkey % 6) || '#' || c_custkey else '10.0.0.1,10.0.0.' || (2 + c_custkey % 6) end || '/' || c_custkey || case when c_custkey % 4 > 0 then '@' || (c_custkey % 4 + 1) else '' end as value from customer")
def scoped_keys(spark, d):
    other = F.concat(F.lit("10.0.0."), F.col("v") + 2)
    scope = S.connection_scope(F.when(F.col("v") % 2 == 0, other).otherwise("10.0.0.1"), F.when(F.col("v") % 2 == 0, F.lit("10.0.0.1")).otherwise(other), F.when(F.col("v") < 3, F.col(K)))
    return customers(spark, d).select(K, S.episodic(S.key("gtp_teid", F.col(K), scope)["value"], F.col(K) % 4).alias("value"))


@query("select c_custkey, case c_custkey % 6 when 0 then 'supi' when 1 then 'impu' when 2 then 'msisdn' when 3 then 'ran_ue_ngap_id' end kind, case c_custkey % 6 when 0 then '1' || c_custkey when 1 then 'sip:a' when 2 then '+' || c_custkey when 3 then 's/' || c_custkey end as value from customer")
def subscriber_titles(spark, d):
    k = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    c, lit = F.concat, F.lit
    keys = cases(
        F.array(k("impu", lit("sip:z")), k("supi", c(lit("2"), "s")), k("supi", c(lit("1"), "s"))), F.array(k("impu", lit("sip:b")), k("impu", lit("sip:a")), k("msisdn", F.col("s"))), F.array(k("ran_ue_ngap_id", F.col("s")), k("msisdn", c(lit("+"), "s"))),
        F.array(k("pfcp_seid", F.col("s")), k("ran_ue_ngap_id", c(lit("s/"), "s"))), F.array(k("pfcp_seid", F.col("s"))), F.array(k("sbi_stream", F.col("s"))),
    )
    best = S.subscriber_identity(keys)
    return customers(spark, d).select(K, best["kind"].alias("kind"), best["value"].alias("value"))


@query("select c_custkey, ['vowifi', 'vonr', 'volte', 'vowifi', 'volte', null][c_custkey % 6 + 1] access, ['nudm-sdm', null, 'nsmf-pdusession', null, 'namf-comm', null][c_custkey % 6 + 1] service, case when c_custkey % 6 in (1, 3) then c_custkey % 6 * 100 + 83 end status, ['Update-Location', 'Update-Location', 'AA', 'Location-Info', 'Notify', 'Push'][c_custkey % 6 + 1] command, ['a', 'b', 'a', 'b', 'a', 'b'][c_custkey % 6 + 1] own from customer")
def labels_and_tokens(spark, d):
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("v") + 1).cast("int"))
    access = pick("IEEE-802.11ac", "3gpp-nr-fdd", "3GPP-E-UTRAN-FDD", "wlan", "LTE", "DOCSIS")
    path = pick("/nudm-sdm/v2/imsi-1", "/x/y", "nsmf-pdusession/v1", "/nudm", "/namf-comm", "")
    label = pick("INVITE", "183 Session Progress", "x 200", "383", "7000 no", "99 no")
    command = pick("3GPP-Update-Location", "ETSI-Update-Location", "AA", "3GPP-Location-Info", "12:Notify", "Push")
    own = pick("a + b", "b", "a", "b + a + a", "a + ", "b")
    return customers(spark, d).select(K, S.access_kind(access).alias("access"), S.service_from_path(path).alias("service"), S.sip_status(label).alias("status"), S.command_name(command).alias("command"), S.own_label(own).alias("own"))


@query("select capture_id, frame, case protocol when 'sip' then 'IMS' when 'diameter' then 'EPC' else '5GC' end as domain, protocol = 'nas-5gs' or (protocol = 'ngap' and k % 2 = 0) nas, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%fZ') iso, 'r' || (k % 3) as role from m")
def message_marks(spark, d):
    """Domain, whether NAS is inside, ISO time, and the role that a hint gives an address."""
    rows = messages(spark, d).withColumn("k", F.try_element_at("detail", F.lit("seqno")).cast("int"))
    stack = F.when((F.col("protocol") == "ngap") & (F.col("k") % 2 == 0), F.map_concat("detail", F.create_map(F.lit("protocols"), F.lit("ngap, nas-5gs")))).otherwise(F.col("detail"))
    hint = F.concat(F.lit("10.0.0.9=x;10.0.0.1=r"), F.col("k") % 3)
    return rows.select("capture_id", "frame", S.domain_of(F.col("protocol")).alias("domain"), S.is_nas(F.col("protocol"), stack).alias("nas"), S.iso_micros(F.col("ts")).alias("iso"), F.try_element_at(S.hints(hint), F.lit("10.0.0.1")).alias("role"))
