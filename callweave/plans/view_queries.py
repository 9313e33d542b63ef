"""Queries of the views: overview, subscribers, ladders, parties, calls, set conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import correlate as C
from callweave.operators import links as L
from callweave.operators import pairing as P
from callweave.operators import procedures as X
from callweave.operators import rollups as R
from callweave.operators import sequences as Q
from callweave.operators import views as V
from callweave.plans import queries as base
from callweave.plans.registry import query, table
from callweave.plans.standins import messages


@query(base.FINISHED + base.EVENTS + ", su as (select capture_id, flow_id::int % 10 g, min(case light when 'red' then 0 when 'amber' then 1 else 2 end) w from ls where flow_id::int % 10 > 0 group by 1, 2), pe as (select capture_id, count(*) filter (w = 0) red, count(*) filter (w = 1) amber, count(*) filter (w = 2) green, min(w) worst from su group by 1), tt as (select capture_id, count(*) sessions, sum(messages)::bigint messages, sum(failures)::bigint failures, sum(retransmissions)::bigint retransmissions, 0::bigint unanswered from ls group by 1), oc as (select capture_id, count(*) filter (outcome = 'success') success, count(*) filter (outcome = 'failure') failure, count(*) filter (outcome = 'incomplete') incomplete, 0::bigint cancelled from p group by 1) select capture_id, ['red', 'amber', 'green'][worst + 1] verdict, red, amber, green, sessions, messages, failures, retransmissions, unanswered, success, failure, incomplete, cancelled from pe join tt using (capture_id) join oc using (capture_id)")
def overviews(spark, d):
    rows = messages(spark, d)
    procedures = X.finish(rows, X.segment_procedures(rows, 3600.0, base.EVENT_OPENERS), base.EVENT_OPENERS)
    return V.overview(rows, base._sessions(spark, d), base.subscribers(spark, d), procedures)


@query(", p as (select distinct capture_id, flow_id, supi from m where supi is not null), t as (select capture_id, flow_id, count(*) n, count(*) filter (is_failure) f, count(distinct tac) pdu from m group by 1, 2) select capture_id, supi, count(*) flows, sum(n)::bigint messages, sum(f)::bigint failures, 1::bigint aliases, sum(pdu)::bigint pdu_sessions from p join t using (capture_id, flow_id) group by 1, 2")
def subscriber_summaries(spark, d):
    """The tracking area stands for the PDU session's number."""
    pdu = F.when(Q.detail("tac").isNotNull(), F.map_concat("detail", F.create_map(F.lit("pdu-session-id"), Q.detail("tac")))).otherwise(F.col("detail"))
    return V.subscriber_summary(messages(spark, d).withColumn("detail", pdu))


@query(", k as (select capture_id, flow_id, count(*) n, max(case when k % 97 = 0 then supi end) supi from m group by 1, 2) select capture_id, 'amf_ue_ngap_id' kind, 'cap/' || flow_id as value, n messages from k where supi is null")
def identities_without_supi(spark, d):
    few = F.filter("keys", lambda k: (k["kind"] != "supi") | (Q.detail("seqno").cast("int") % 97 == 0))
    return V.unlinked_identities(messages(spark, d).withColumn("keys", few))


LADDER = base.SEGMENTED + ", x as (select *, (epoch_us(event_time) - lag(epoch_us(event_time)) over (partition by capture_id, flow_id order by ts, frame)) / 1e6 gap from m where user_id = 42) "


@query(LADDER + "select x.capture_id, x.frame, x.label, g.segment, g.kind as procedure, round(x.gap, 6) delta, case x.protocol when 'sip' then 'IMS' when 'diameter' then 'EPC' else '5GC' end as domain, case when x.protocol = 'pfcp' and x.k % 2 = 0 then 'N4' end as interface from x left join g on g.capture_id = x.capture_id and g.frame = x.frame and g.seq = x.seq")
def ladders(spark, d):
    """The ladder of one subscriber, by a key of theirs."""
    rows = messages(spark, d)
    even = Q.detail("seqno").cast("int") % 2 == 0
    ends = rows.withColumns({"src": F.col("src").withField("role", F.when(even, "SMF")), "dst": F.col("dst").withField("role", F.when(even, "UPF"))})
    points = spark.createDataFrame([("pfcp", "UPF", "SMF", "N4")], "protocol string, role_a string, role_b string, interface string")
    made = V.ladder(ends, "amf_ue_ngap_id", "cap/42", X.segment_procedures(rows, 3600.0, base.EVENT_OPENERS), points)
    return made.select("capture_id", "frame", "label", "segment", "procedure", "delta", "domain", "interface")


@query(", r as (select capture_id, flow_id, user_id % 50 g, protocol from m), h as (select capture_id, flow_id, any_value(g) g, list_distinct(list(case protocol when 'sip' then 'IMS' when 'diameter' then 'EPC' else '5GC' end)) here from r where protocol <> 'sip' or flow_id::int % 2 = 0 group by 1, 2), a as (select capture_id, g, list_distinct(flatten(list(here))) every from h group by 1, 2) select capture_id, flow_id, list_sort(list_filter(every, lambda x: not list_contains(here, x))) elsewhere from h join a using (capture_id, g)")
def domains_of_other_flows(spark, d):
    """Users with the same remainder are one subscriber; every other user's SIP is left out."""
    user = F.col("flow_id").cast("int")
    rows = messages(spark, d).where((F.col("protocol") != "sip") | (user % 2 == 0))
    return V.domains_elsewhere(rows.withColumn("keys", F.array(F.struct(F.lit("supi").alias("kind"), (user % 50).cast("string").alias("value")))))


@query("select capture_id, capture_id = 'cap0' as only_n2 from m where capture_id <> 'cap0' or protocol in ('ngap', 'nas-5gs') group by 1, 2")
def captures_of_n2_alone(spark, d):
    return V.only_n2(messages(spark, d).where((F.col("capture_id") != "cap0") | F.col("protocol").isin(*V.N2_ONLY)))


@query("select capture_id, frame as number, label as info from m where user_id % 10 = 2 and contains(label, 'i') and user_id = 42")
def packets_by_both(spark, d):
    rows = messages(spark, d)
    packets = rows.where(F.col("flow_id").cast("int") % 10 == 2).select("capture_id", F.col("frame").alias("number"), F.col("label").alias("info"), F.lit("P").alias("protocol"), F.lit("").alias("src"), F.lit("").alias("dst"))
    return V.packets_of(packets, rows, "I", ("amf_ue_ngap_id", "cap/42")).select("capture_id", "number", "info")


@query(", s as (select capture_id, k as call, ts, frame, label, user_id, case when label = 'view' then 'INVITE' when label = 'click' then '180' end l from m where protocol = 'sip'), i as (select capture_id, call, arg_min(user_id, (ts, frame)) u, arg_min(user_id, (ts, frame)) filter (user_id % 2 = 0) asserted from s where l = 'INVITE' group by 1, 2), c as (select distinct capture_id, call from s), a as (select capture_id, call, count(*) n from s where l = '180' group by 1, 2) select c.capture_id, c.call::varchar as call, coalesce('sip:+1555' || lpad(asserted::varchar, 7, '0') || '@x', 'sip:user' || u || '@x') caller, 'tel:+44' || lpad(u::varchar, 7, '0') callee, '+1555' || lpad(asserted::varchar, 7, '0') caller_number, case when asserted is not null then 'asserted' end caller_source, '+44' || lpad(u::varchar, 7, '0') callee_number, case when u is not null then 'id' end privacy, case when u is not null then 'volte' end caller_access, case when a.n > 0 then 'vowifi' end callee_access from c left join i using (capture_id, call) left join a using (capture_id, call)")
def parties_of_calls(spark, d):
    user = F.lpad("flow_id", 7, "0")
    even = F.col("flow_id").cast("int") % 2 == 0
    label = F.when(F.col("label") == "view", "INVITE").when(F.col("label") == "click", "180 Ringing").otherwise(F.col("label"))
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    held = F.array(
        entry("P-Asserted-Identity", F.when(even, F.concat(F.lit("sip:+1555"), user, F.lit("@x")))),
        entry("From", F.concat(F.lit("sip:user"), "flow_id", F.lit("@x"))),
        entry("Request-URI", F.concat(F.lit("tel:+44"), user)),
        entry("Privacy", F.lit("id")),
        entry("access-type", F.when(F.col("label") == "view", "3GPP-E-UTRAN-FDD").when(F.col("label") == "click", "IEEE-802.11")),
    )
    rows = messages(spark, d).withColumn("call", Q.detail("seqno"))
    rows = rows.withColumns({"detail": F.map_from_entries(F.filter(held, lambda e: e["value"].isNotNull())), "label": label})
    return V.call_parties(rows)


@query(", s as (select capture_id, e2e session, max(case when k % 10 = 3 then 'i' || (k % 4) end) icid from m where protocol = 'diameter' group by 1, 2) select m.capture_id, m.frame, 'call' || substr(icid, 2) as call from m join s on m.capture_id = s.capture_id and m.e2e = s.session where protocol = 'diameter' and icid is not null")
def charged_messages(spark, d):
    entry = F.create_map(F.lit("session-id"), Q.detail("end-to-end-id"))
    k = Q.detail("seqno").cast("int")
    icid = F.when(k % 10 == 3, F.create_map(F.lit("icid"), F.concat(F.lit("i"), k % 4))).otherwise(F.create_map().cast("map<string,string>"))
    rows = messages(spark, d).withColumn("detail", F.map_concat(entry, icid))
    calls = rows.select("capture_id").distinct().withColumn("n", F.explode(F.array(*map(F.lit, range(4))))).select("capture_id", F.concat(F.lit("call"), "n").alias("call"), F.concat(F.lit("i"), "n").alias("icid"))
    return L.charged_messages(rows, calls).select("capture_id", "frame", "call")


@query(base.SEGMENTED + "select capture_id, flow_id, segment, arg_min(k % 5, frame) connection from g where segment is not null group by 1, 2, 3")
def first_connections(spark, d):
    rows = messages(spark, d)
    members = X.segment_procedures(rows, 3600.0, base.EVENT_OPENERS).where("segment is not null")
    return L.first_connection(members, rows.select("capture_id", "frame", "seq", (Q.detail("seqno").cast("int") % 5).alias("connection")))


@query("select capture_id, frame, case when k % 5 = 0 then null when k % 2 = 0 then 'SMF' else 'AMF' end as producer from m where k % 5 > 0")
def callback_producers(spark, d):
    k = Q.detail("seqno").cast("int")
    rows = messages(spark, d)
    path = F.when(k % 5 == 0, F.concat(F.lit("/other/"), k)).when(k % 2 == 0, F.concat(F.lit("/cb/smf/"), k, F.lit("/x"))).otherwise(F.lit("/cb"))
    given = rows.select("capture_id").distinct().withColumn("p", F.explode(F.array(F.struct(F.lit("/cb/").alias("path"), F.lit("AMF").alias("producer")), F.struct(F.lit("/cb/smf").alias("path"), F.lit("SMF").alias("producer")), F.struct(F.lit("/other").alias("path"), F.lit("A").alias("producer")), F.struct(F.lit("/other").alias("path"), F.lit("B").alias("producer"))))).select("capture_id", "p.*")
    return P.callback_match(rows.select("capture_id", "frame", path.alias("path")), given).select("capture_id", "frame", "producer")


@query(", f as (select capture_id, flow_id, min((ts, frame)) t from m group by 1, 2) select capture_id, flow_id, row_number() over (partition by capture_id order by t, flow_id)::int place from f")
def flows_in_order(spark, d):
    return C.flow_order(messages(spark, d))


@query("with recursive l as (select distinct l_suppkey a, l_partkey % 300 + 100000 b from lineitem where l_orderkey % 40 = 0), e as (select a, b from l union select b, a from l), r as (select distinct l_suppkey::bigint as call, l_suppkey as key from lineitem where l_suppkey <= 3 union select r.call, e.b from r join e on r.key = e.a) select call, key from r")
def media_closure(spark, d):
    items = table(spark, d, "lineitem")
    links = items.where("l_orderkey % 40 = 0").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 300 + 100000).alias("b"))
    return C.closure(items.where("l_suppkey <= 3").select(F.col("l_suppkey").alias("call"), F.col("l_suppkey").alias("key")), links)


@query("select capture_id, flow_id, messages from (select capture_id, flow_id, count(*) messages from m group by 1, 2) where (capture_id, flow_id) in (select (capture_id, flow_id) from m where event_time between timestamp '2024-01-05' and timestamp '2024-01-06')")
def sessions_in_window(spark, d):
    from callweave.operators.coverage import sessions_in_window as chosen

    rows = chosen(messages(spark, d), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-06").cast("timestamp"))
    return rows.groupBy("capture_id", "flow_id").agg(F.count("*").alias("messages"))


@query(", v as (select capture_id, src_ip address, case when user_id % 3 = 0 then k % 2 else 0 end port, case when user_id % 3 = 0 then ['gNB', 'AMF'][k % 2 + 1] else 'gNB' end as role from m group by all), w as (select capture_id, address, count(distinct role) n from v group by 1, 2) select v.capture_id, case when n > 1 then address || ':' || port else address end address, role from v join w using (capture_id, address) group by all")
def roles_by_port(spark, d):
    """Addresses that play two roles at two ports are split by port."""
    from callweave.operators.roles import resolve_roles

    k, third = Q.detail("seqno").cast("int"), F.col("flow_id").cast("int") % 3 == 0
    votes = messages(spark, d).select("capture_id", F.col("src.ip").alias("address"), F.when(third, k % 2).otherwise(0).alias("port"), F.when(third & (k % 2 == 1), "AMF").otherwise("gNB").alias("role"), F.lit("ngap-dir").alias("basis")).distinct()
    return resolve_roles(votes).select("capture_id", "address", "role")


@query(", v as (select capture_id, src_ip address, ['gNB', 'AMF'][k % 2 + 1] as role, ['a', 'b', 'c'][k % 3 + 1] basis from m) select capture_id, address, list_sort(list(distinct role || '=' || basis)) evidence from v group by 1, 2")
def role_evidence(spark, d):
    from callweave.operators.roles import role_basis

    k = Q.detail("seqno").cast("int")
    return role_basis(messages(spark, d).select("capture_id", F.col("src.ip").alias("address"), F.element_at(F.array(F.lit("gNB"), F.lit("AMF")), k % 2 + 1).alias("role"), F.element_at(F.array(*map(F.lit, "abc")), k % 3 + 1).alias("basis")))
