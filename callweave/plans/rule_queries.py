"""Queries of the rules over segments, quotes, relays, hosts and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import coverage as V
from callweave.operators import links as L
from callweave.operators import procedures as X
from callweave.operators import records as D
from callweave.operators import roles as O
from callweave.operators import sequences as Q
from callweave.plans import queries as base
from callweave.plans.registry import query, table
from callweave.plans.standins import messages


def k():
    return Q.detail("seqno").cast("int")


def with_detail(rows, **values):
    """rows with further detail entries; null ones are left out."""
    pairs = F.array(*(F.struct(F.lit(n.replace("_", "-")).alias("key"), v.cast("string").alias("value")) for n, v in values.items()))
    return rows.withColumn("detail", F.map_concat("detail", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))))


@query(base.SEGMENTED + ", f as (select capture_id, flow_id, segment, any_value(kind) kind, min(n) a, max(n) b from g where segment is not null group by 1, 2, 3), l as (select *, lag(segment) over w ps, lag(b) over w pb, lag(kind) over w pk from f window w as (partition by capture_id, flow_id order by a)) select capture_id, flow_id, segment, case when kind = 'order' and pb + 1 = a and pk <> 'order' then ps end folded_into from l")
def folded_releases(spark, d):
    """Orders stand for releases: one that directly follows a visit is its child."""
    rows = messages(spark, d)
    segments = X.segment_procedures(rows, 3600.0, base.EVENT_OPENERS)
    renamed = F.when(F.col("kind") == "order", X.RELEASES[0]).otherwise(F.col("kind"))
    made = segments.where("segment is not null").select("capture_id", "flow_id", "segment", renamed.alias("kind")).distinct()
    return X.fold_releases(made, X.segment_positions(rows, segments)).select("capture_id", "flow_id", "segment", "folded_into")


@query(", f as (select capture_id, flow_id, string_agg((k % 4)::varchar, ',' order by ts, frame) seen from m where is_failure group by 1, 2) select capture_id, flow_id, case when contains(',' || seen || ',', ',1,2,3,') then 'three' when contains(',' || seen || ',', ',1,2,') then 'two' end says from f where contains(',' || seen || ',', ',1,2,')")
def failure_sequences(spark, d):
    rows = messages(spark, d).where("is_failure").withColumn("cause", F.struct(F.lit("t").alias("table"), (k() % 4).alias("value")))
    rules = spark.createDataFrame([("t", [1, 2], "two"), ("t", [1, 2, 3], "three"), ("u", [1, 2], "other")], "table string, values array<int>, says string")
    return Q.match_sequences(rows, rules, ["capture_id", "flow_id"]).select("capture_id", "flow_id", "says")


@query(", s as (select capture_id, k::varchar as call, ts, frame, label, row_number() over (partition by capture_id, k order by ts, frame) n, user_id from m where protocol = 'sip'), r as (select capture_id, call, arg_min(label, n) filter (label in ('view', 'purchase')) first, min(frame) start_frame, min(ts) \"start\", max(ts) \"end\", count(*) messages, min(ts) filter (label = 'click') ring, min(ts) filter (label = 'signup') answer, arg_min(ts, n) filter (label = 'purchase') bye, arg_min(user_id % 2, n) filter (label = 'purchase') bye_tag, arg_min(user_id % 2, n) filter (label in ('view', 'purchase')) caller_tag, arg_min(case label when 'signup' then 200 else 486 end, n) filter (label in ('signup', 'error')) final_status, bool_or(label = 'error') failed from s group by 1, 2) select capture_id, call, case first when 'view' then 'invite' when 'purchase' then 'bye' end kind, start_frame, \"start\", \"end\", messages, final_status::int final_status, round(ring - \"start\", 6) ring_s, round(answer - \"start\", 6) answer_s, round(bye - answer, 6) talk_s, case when bye is not null then case when bye_tag = caller_tag then 'caller' else 'callee' end end released_by, case when answer is not null then 'success' when failed then 'failure' else 'incomplete' end outcome from r")
def sip_calls(spark, d):
    label = F.when(F.col("label") == "view", "INVITE").when(F.col("label") == "click", "180 Ringing").when(F.col("label") == "signup", "200 OK").when(F.col("label") == "purchase", "BYE").otherwise("486 Busy Here")
    tag = (F.col("flow_id").cast("int") % 2).cast("string")
    rows = with_detail(messages(spark, d), cseq_method=F.lit("INVITE"), from_tag=tag).withColumns({"label": label, "keys": F.array(F.struct(F.lit("sip_call_id").alias("kind"), k().cast("string").alias("value")))})
    return X.sip_segments(rows)


@query(", s as (select *, row_number() over (partition by capture_id, flow_id, e2e, label, case when is_failure then k end order by frame, ts) c from m where protocol = 'diameter'), o as (select * from s where c = 1 and k % 4 > 0) select capture_id, 's' || (k % 4) || '-' || user_id as session, 'hss-x-update' kind, min(frame) start_frame, count(*) messages, case when bool_or(is_failure and user_id % 2 = 0) then 'failure' when bool_or(label = 'click' and user_id % 2 = 0) then 'success' else 'incomplete' end outcome from o group by 1, 2")
def stray_diameter(spark, d):
    """Users with odd numbers are redirected, which settles nothing."""
    user = F.col("flow_id").cast("int")
    rows = with_detail(messages(spark, d), session_id=F.when(k() % 4 > 0, F.concat(F.lit("s"), k() % 4, F.lit("-"), "flow_id")), redirect_host=F.when(user % 2 == 1, F.lit("h")))
    label = F.when(F.col("label") == "click", "X-Update Answer").when(F.col("label") == "view", "X-Update Request").otherwise(F.concat(F.lit("X-Update "), F.when(F.col("label") == "signup", "Request").otherwise("Request ")))
    # Labels stay as different as the event types are, so that relay copies are told apart as before.
    once = Q.distinct_observed(rows.where("protocol = 'diameter'")).withColumn("label", F.rtrim(label))
    return X.diameter_segments(once.withColumn("detail", F.map_filter("detail", lambda n, _: n != "end-to-end-id")))


@query(base.FINISHED + "select capture_id, flow_id, segment, 'session' category, duration > case kind when 'visit' then 600 else 60 end slow from p")
def slow_procedures(spark, d):
    rows = messages(spark, d)
    made = X.finish(rows, X.segment_procedures(rows, 3600.0, base.EVENT_OPENERS), base.EVENT_OPENERS)
    return X.behaviours(made, {"visit": 600.0, "order": 60.0}).select("capture_id", "flow_id", "segment", "category", "slow")


@query("select capture_id, src_ip address, count(distinct k % (1 + user_id % 3)) origins, case when count(distinct k % (1 + user_id % 3)) = 1 then 'h' || min(k % (1 + user_id % 3)) end host from m where protocol = 'diameter' group by 1, 2")
def hosts_of_addresses(spark, d):
    origin = F.concat(F.lit("h"), k() % (1 + F.col("flow_id").cast("int") % 3))
    return D.diameter_hosts(with_detail(messages(spark, d), origin_host=origin))


@query(", t as (select capture_id, '00101' || user_id supi, k from m where protocol = 'ngap' and label = 'view' group by all), g as (select capture_id, k - 2 k from m where protocol = 'pfcp') select t.capture_id, supi, '1' pdu_id, 'upf' side, count(*) packets from (select capture_id, supi, min(k) k from t group by 1, 2) t join g on g.capture_id = t.capture_id and g.k = t.k group by 1, 2")
def tunnel_packets(spark, d):
    rows = messages(spark, d)
    one = lambda c: F.struct(c.cast("string").alias("value"))
    held = rows.where("protocol = 'ngap' and label = 'view'").groupBy("capture_id", F.concat(F.lit("00101"), "flow_id").alias("supi")).agg(F.min(k()).alias("k"))
    sessions = held.select("capture_id", "supi", F.lit("1").alias("pdu_id"), one(F.lit("a")).alias("gtp_address"), one(F.col("k")).alias("gtp_teid"), one(F.lit(None)).alias("gtp_teid_owner"))
    gtp = with_detail(rows.where("protocol = 'pfcp'"), teid=k() - 2).withColumn("dst", F.col("dst").withField("ip", F.lit("a")))
    return D.tunnel_packets(sessions, gtp)


@query("select capture_id, protocol as transport, count(*) frames from m where user_id % 9 > 3 group by 1, 2")
def left_out_by_transport(spark, d):
    frames = messages(spark, d).select("capture_id", F.col("frame").alias("number"), F.col("protocol").alias("transport"), "flow_id")
    return V.narrow_excluded(frames, frames.where(F.col("flow_id").cast("int") % 9 <= 3))


@query("select capture_id, frame, (['registration', null, 'handover', 'service-request', 'tau'])[k % 5 + 1] kind from m")
def opened_kinds(spark, d):
    """Own labels before the joiner: exact rules, contained ones, none; the first in the list wins."""
    labels = F.array(*map(F.lit, ("Registration request + x", "Registration reject", "PathSwitchRequest", "Service request + Registration request", "Tracking area update request")))
    held = messages(spark, d).withColumn("label", F.element_at(labels, k() % 5 + 1))
    names = F.array(*(F.lit(o[0]) for o in X.OPENERS))
    return held.select("capture_id", "frame", F.get(names, X.opener(F.col("label"))).alias("kind"))


@query(", r as (select user_id, frame, ts, row_number() over (partition by user_id order by ts, frame) n from m where protocol = 'sip' and k % 4 = 0) select 'cap' || (user_id % 3) capture_id, '10.0.' || (user_id % 7) || '.' || user_id as address, 'SIP proxy' as role from r group by user_id having count(*) > 0")
def noted_relays(spark, d):
    """Senders with a route record."""
    rows = with_detail(messages(spark, d).where("protocol = 'sip'"), relay_record=F.when(k() % 4 == 0, F.lit("r")))
    return O.find_relays(rows)


@query("select c_custkey, c_nationkey % 3 as rank, row_number() over (partition by 'c' || (c_nationkey % 2) order by case c_nationkey % 3 when 2 then 2 else c_nationkey % 3 end, 'n' || c_custkey)::int place from customer")
def ladder_places(spark, d):
    role = F.element_at(F.array(F.lit("UE"), F.lit("gNB"), F.lit("zz")), F.col("c_nationkey") % 3 + 1)
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_nationkey") % 2).alias("capture_id"), role.alias("role"), F.concat(F.lit("n"), "c_custkey").alias("label"))
    return O.participants(rows, ["UE", "gNB"]).select("c_custkey", "rank", "place")


@query(", s as (select capture_id, src_ip, dst_ip, k from m where protocol = 'nas-5gs'), g as (select distinct capture_id, src_ip a, dst_ip b from m where protocol = 'sip' and capture_id = 'cap0'), e as (select capture_id, a x, b y from g union select capture_id, b, a from g), h as (select capture_id, x address from e group by 1, 2 having count(distinct y) >= 2), c as (select * from m where protocol = 'sip' and capture_id not in (select capture_id from h)) select capture_id, src_ip address, case k % 4 when 0 then 'AUSF' when 1 then 'AMF' else 'SMF' end as role, case k % 4 when 1 then 'resource-consumer' else 'service-consumer' end basis from s where k % 4 <> 2 union select capture_id, dst_ip, case when k % 4 = 3 then 'PCF' else 'UDM' end, 'service' from s union select capture_id, address, 'P-CSCF', 'ipsec-fanout' from h union select capture_id, y, 'UE', 'ipsec-fanout' from e where (capture_id, x) in (select capture_id, address from h) and (capture_id, y) not in (select capture_id, address from h) union select capture_id, src_ip, 'UE', 'contact' from c union select capture_id, dst_ip, 'P-CSCF', 'contact' from c")
def consumer_and_access_votes(spark, d):
    """Consumers by service and resource; protected SIP in one capture, Contact headers in all."""
    rows, k = messages(spark, d).where("protocol in ('nas-5gs', 'sip')"), Q.detail("seqno").cast("int")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), k % 4 + 1)
    asked = F.map_from_arrays(F.array(F.lit("service"), F.lit("path")), F.array(pick("nudm-ueau", "nudm-sdm", "nudm-sdm", "npcf-smpolicycontrol"), pick("/nudm-ueau/v1/x", "/nudm-sdm/v2/x/am-data", "/nudm-sdm/v2/x/sms-data", "/npcf-smpolicycontrol/v1/sm-policies")))
    claim = F.create_map(F.lit("fallback-role-hints"), F.concat("src.ip", F.lit("=UE;"), "dst.ip", F.lit("=P-CSCF")))
    access = F.when(F.col("capture_id") == "cap0", F.map_concat(claim, F.create_map(F.lit("ipsec-roles"), F.lit("UE|P-CSCF")))).otherwise(claim)
    sbi = F.col("protocol") == "nas-5gs"
    held = rows.withColumns({"detail": F.when(sbi, asked).otherwise(access), "protocol": F.when(sbi, "sbi").otherwise(F.col("protocol"))})
    return O.role_votes(held).select("capture_id", "address", "role", "basis")
