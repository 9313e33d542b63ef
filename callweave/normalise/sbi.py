"""Service-based interface over HTTP/2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.scalars import host_of
from callweave.normalise.core import blocks, details, key, messages, number, scoped, text, texts, tunnels

HEADERS, FAILURE = 1, 400
#: Which way a message that carries N2 information points.
N2 = {"PDU_RES_SETUP_RSP": "reported", "HANDOVER_REQ_ACK": "reported", "PDU_RES_SETUP_REQ": "forwarded"}


def sbi(frames: DataFrame) -> DataFrame:
    """HEADERS frames only: label is method and path, or the status."""
    h = lambda n: text(f"http2_http2_headers_{n}")
    rows = blocks(frames, "http2").where(number("http2_http2_type") == HEADERS).withColumns({"method": h("method"), "path": h("path"), "status": number("http2_http2_headers_status"), "location": h("location"), "authority": h("authority")})
    path, status = F.col("path"), F.col("status")
    label = F.when(F.col("method").isNotNull() & path.isNotNull(), F.concat_ws(" ", "method", "path")).when(status.isNotNull(), status.cast("string"))
    members = F.coalesce(texts("json_json_member_with_value"), F.array().cast("array<string>"))
    pair = lambda m: F.struct(F.element_at(F.split(F.substring_index(m, ":", 1), "/"), -1).alias("name"), F.trim(F.regexp_extract(m, ":(.*)$", 1)).alias("value"))
    rows = rows.withColumn("members", F.transform(members, pair))
    in_path = F.transform(F.regexp_extract_all(F.coalesce(path, F.lit("")), F.lit("imsi-([0-9]{5,15})"), 1), lambda v: F.struct(F.lit("supi").alias("kind"), v.alias("value")))
    in_body = F.transform(F.filter("members", lambda m: (m["name"] == "supi") & m["value"].rlike("^imsi-[0-9]{5,15}$")), lambda m: F.struct(F.lit("supi").alias("kind"), F.substring(m["value"], 6, 20).alias("value")))
    ref = lambda url, host: F.struct(F.lit("sm_context_ref").alias("kind"), F.concat_ws("/", host, F.regexp_extract(url, r"/sm-contexts/([^/?]+)", 1)).alias("value"))
    held = r"/sm-contexts/[^/?]+"
    refs = F.array_compact(F.array(F.when(path.rlike(held) & F.col("authority").isNotNull(), ref(path, F.col("authority"))), F.when(F.col("location").rlike(held), ref(F.col("location"), F.regexp_extract("location", "//([^/]+)", 1)))))
    keys = F.concat(F.array(scoped("sbi_stream", number("http2_http2_streamid"))), in_path, in_body, refs)
    names, values = texts("http2_http2_header_name"), texts("http2_http2_header_value")
    target = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.lower(x["n"]) == "3gpp-sbi-target-apiroot")
    member = lambda n: F.get(F.transform(F.filter("members", lambda m: m["name"] == n), lambda m: m["value"]), F.lit(0))
    detail = details(path=path, service=F.nullif(F.regexp_extract(path, "^/([^/?]+)", 1), F.lit("")), user_agent=h("user_agent"), relay_target=host_of(F.get(target, F.lit(0))["v"]), declared_nf_type=F.when(F.col("method") == "PUT", member("nfType")), callback_uris=F.nullif(F.array_join(F.transform(F.filter("members", lambda m: F.lower(m["name"]).contains("uri") & m["value"].rlike("^https?://")), lambda m: m["value"]), " "), F.lit("")), dnn=member("dnn"), pdu_session_id=member("pduSessionId"))
    return messages(rows, "sbi", label, keys, status >= FAILURE, detail, quotes=_quotes())


def _quotes():
    """Tunnels of carried N2 information, if all its declared types point one way; digit runs of path parts as embedded numbers."""
    types = F.array_distinct(F.transform(F.filter("members", lambda m: m["name"].isin("n2SmInfoType", "ngapIeType")), lambda m: m["value"]))
    ways = F.array_distinct(F.transform(types, lambda t: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in N2.items() for x in kv)), t), F.lit("?"))))
    way = F.when((F.size(ways) == 1) & ~F.array_contains(ways, "?"), F.get(ways, F.lit(0)))
    ends = tunnels("gtp_teid", texts("ngap_ngap_gTP_TEID"), texts("ngap_ngap_TransportLayerAddressIPv4"))
    quoted = F.when(way.isNotNull(), F.transform(ends, lambda t: F.struct(t["kind"].alias("kind"), t["value"].alias("value"), way.alias("looks"))))
    digits = F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.coalesce("path", F.lit("")), "imsi-[0-9]+", ""), F.lit("(?<![0-9])([0-9]{10,15})(?![0-9])"), 1))
    embedded = F.transform(digits, lambda v: F.struct(F.lit("supi").alias("kind"), v.alias("value"), F.lit("embedded").alias("looks")))
    return F.concat(F.coalesce(quoted, F.array().cast("array<struct<kind:string,value:string,looks:string>>")), embedded)


def exchange(frames: DataFrame) -> DataFrame:
    """Body blocks that came after their headers: capture, key, source, and what they state."""
    rows = blocks(frames, "http2").where(number("http2_http2_type") == 0)
    stream = key("sbi_stream", number("http2_http2_streamid"), F.col("scope"))
    return rows.where(stream.isNotNull()).select("capture_id", "frame", F.lit("sbi").alias("protocol"), stream["value"].alias("key"), "src_ip", "src_port", texts("json_json_member_with_value").alias("members"))
