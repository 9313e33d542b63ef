"""Queries of ordered merging, valid time, cascades, assembled calls, latency and pseudonyms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import calls as A
from callweave.operators import correlate as C
from callweave.operators import latency as T
from callweave.operators import links as L
from callweave.operators import pairing as P
from callweave.operators import privacy as PR
from callweave.operators import quotes as W
from callweave.operators import sequences as Q
from callweave.plans.registry import query, table
from callweave.plans.standins import SQL, messages
from callweave.schema import ROW

KEY = b"test key"


def _recursive(sql: str) -> str:
    return SQL.replace("with raw", "with recursive raw", 1) + sql


#: Quotes among the hundred flows of a user, replayed one by one; some flows name one of three subscribers.
REPLAY = _recursive("""
, q as (select frame, user_id g, k a, (k * 7 + frame % 5 + 1) % 100 b, row_number() over (partition by user_id order by frame) i from m),
f as (select g, list(struct_pack(flow := k, label := k, supi := case when k % 4 = 0 then k % 3 end) order by k) flows from (select g, a k from q union select g, b from q) group by g),
step(g, i, frame, a, b, verdict, flows) as (
  select g, 0::bigint, null::bigint, null::int, null::bigint, null::varchar, flows from f
  union all
  select g, i, frame, a, b, verdict, list_transform(flows, lambda x: struct_pack(flow := x.flow, label := case when verdict = 'joined' and x.label in (la, lb) then least(la, lb) else x.label end, supi := x.supi)) from (
    select *, case when la = lb then 'already joined' when len(sa) > 0 and len(sb) > 0 and len(list_distinct(list_concat(sa, sb))) > 1 then 'refused' else 'joined' end verdict from (
      select *, list_distinct(list_filter(list_transform(list_filter(flows, lambda x: x.label = la), lambda x: x.supi), lambda v: v is not null)) sa, list_distinct(list_filter(list_transform(list_filter(flows, lambda x: x.label = lb), lambda x: x.supi), lambda v: v is not null)) sb from (
        select q.g, q.i, q.frame, q.a, q.b, s.flows, list_filter(s.flows, lambda x: x.flow = q.a)[1].label la, list_filter(s.flows, lambda x: x.flow = q.b)[1].label lb from step s join q on q.g = s.g and q.i = s.i + 1)))),
last as (select g, arg_max(flows, i) flows from step group by g)
""")


def _bridged(spark, d):
    k = Q.detail("seqno").cast("int")
    rows = messages(spark, d).select("frame", "flow_id", k.alias("k"), ((k * 7 + F.col("frame") % 5 + 1) % 100).cast("int").alias("other"))
    name = lambda n: F.concat_ws("-", "flow_id", F.lpad(F.col(n).cast("string"), 2, "0"))
    ends = rows.select("flow_id", "k").union(rows.select("flow_id", "other")).distinct()
    people = ends.where("k % 4 = 0").select(name("k").alias("flow_id"), F.array(F.concat(F.lit("s"), F.col("k") % 3)).alias("supis"))
    return W.apply_quotes(rows.select("frame", name("k").alias("a"), name("other").alias("b")), people)


@query(REPLAY + "select frame, s.g || '-' || lpad(a::varchar, 2, '0') a, verdict, s.g || '-' || lpad(list_filter(l.flows, lambda x: x.flow = s.a)[1].label::varchar, 2, '0') a_flow, s.g || '-' || lpad(list_filter(l.flows, lambda x: x.flow = s.b)[1].label::varchar, 2, '0') b_flow from step s join last l on l.g = s.g where s.i > 0")
def bridged_quotes(spark, d):
    return _bridged(spark, d).select("frame", "a", "verdict", "a_flow", "b_flow")


@query(REPLAY + "select verdict, count(*) n from step where i > 0 group by 1")
def quote_verdicts(spark, d):
    return L.inferred_joins(_bridged(spark, d))


#: Keys in order of frames: a release ends the episode of all that met the key since theirs began. `grp` is what has met; then the components of the keys.
EPISODES = _recursive("""
, given as (select capture_id, frame, label, supi, row_number() over (partition by capture_id order by frame) i, list_filter(['amf_ue_ngap_id=cap/' || user_id, case when seid is not null then 'pfcp_seid=' || seid end], lambda x: x is not null) ks from m),
pool as (select capture_id, list(struct_pack(k := k, grp := k, ep := 0) order by k) st from (select distinct capture_id, unnest(ks) k from given) group by 1),
run(capture_id, i, frame, supi, used, st) as (
  select capture_id, 0::bigint, null::bigint, null::varchar, null::varchar[], st from pool
  union all
  select capture_id, i, frame, supi, used, case when label = 'purchase' then list_transform(met, lambda x: case when x.grp = here then struct_pack(k := x.k, grp := x.k, ep := x.ep + 1) else x end) else met end from (
    select *, list_transform(st, lambda x: case when list_contains(groups, x.grp) then struct_pack(k := x.k, grp := here, ep := x.ep) else x end) met from (
      select *, list_min(groups) here from (
        select g.capture_id, g.i, g.frame, g.label, g.supi, r.st, list_transform(list_filter(r.st, lambda x: list_contains(g.ks, x.k)), lambda x: x.grp) groups,
          list_transform(list_filter(r.st, lambda x: list_contains(g.ks, x.k)), lambda x: x.k || case when x.ep > 0 then '@' || (x.ep + 1) else '' end) used
        from run r join given g on g.capture_id = r.capture_id and g.i = r.i + 1)))),
keyed as (select capture_id, frame, list_transform(list_concat(used, case when supi is not null then ['supi=' || supi] else [] end), lambda x: capture_id || '|' || x) ks from run where i > 0),
edge as (select distinct list_min(ks) a, unnest(ks) b from keyed), both_ways as (select a, b from edge union select b, a from edge),
least_of as (select a node, min(b) low from both_ways group by 1),
walk as (select node, least(node, low) label, 0 n from least_of union all select w.node, min(o.label), w.n + 1 from (select x.node, x.n, unnest(list_concat([x.node], e.others)) other from walk x join (select a, list(b) others from both_ways group by 1) e on e.a = x.node where x.n < 40) w join walk o on o.node = w.other group by 1, 3)
""")


def _episodes(spark, d):
    freed = F.when(F.col("label") == "purchase", F.filter("keys", lambda k: k["kind"] == "amf_ue_ngap_id")).otherwise(F.col("releases"))
    return C.assign_episodes(messages(spark, d).select(*ROW, "ts", "keys", freed.alias("releases")))


@query(EPISODES + "select capture_id, frame, list_sort(list_transform(ks, lambda x: substr(x, instr(x, '|') + 1))) ks from keyed")
def key_episodes(spark, d):
    """H4 on all messages: every key with its episode."""
    return _episodes(spark, d).select("capture_id", "frame", F.array_sort(F.transform("keys", lambda k: F.concat_ws("=", k["kind"], k["value"]))).alias("ks"))


@query()
def episodes_and_flows(spark, d):
    return C.correlate(_episodes(spark, d)).select("capture_id", "frame", "flow_id")


@query(""", r as (select capture_id, frame, label in ('view', 'click') asks, case when src_ip < dst_ip then src_ip || '|' || dst_ip else dst_ip || '|' || src_ip end peers, case when k % 2 = 0 then 'h' || (k % 6) end hop, case when k % 3 > 0 then 'e' || (k % 4) end ende from m where protocol = 'diameter'),
h as (select *, row_number() over (partition by capture_id, peers, hop, asks order by frame) n from r where hop is not null),
hp as (select q.frame rf, a.frame af from (select * from h where asks) q join (select * from h where not asks) a on q.capture_id = a.capture_id and q.peers = a.peers and q.hop = a.hop and q.n = a.n),
left1 as (select * from r where frame not in (select rf from hp) and frame not in (select af from hp)),
e as (select *, row_number() over (partition by capture_id, peers, ende, asks order by frame) n from left1 where ende is not null),
ep as (select q.frame rf, a.frame af from (select * from e where asks) q join (select * from e where not asks) a on q.capture_id = a.capture_id and q.peers = a.peers and q.ende = a.ende and q.n = a.n),
pairs as (select rf, af, 'hop' stage from hp union all select rf, af, 'end' from ep union all select case when asks then frame end, case when not asks then frame end, 'loose' from left1 where frame not in (select rf from ep) and frame not in (select af from ep))
select x.capture_id, rf request_frame, af answer_frame, coalesce(x.hop, y.hop) hop, coalesce(x.ende, y.ende) as "end", stage from pairs left join r y on y.frame = af join r x on x.frame = coalesce(rf, af)""")
def diameter_legs(spark, d):
    k = Q.detail("seqno").cast("int")
    made = F.map_from_entries(F.array_compact(F.array(F.when(k % 2 == 0, F.struct(F.lit("hop-by-hop-id").alias("key"), F.concat(F.lit("h"), k % 6).alias("value"))), F.when(k % 3 > 0, F.struct(F.lit("end-to-end-id").alias("key"), F.concat(F.lit("e"), k % 4).alias("value"))))))
    rows = messages(spark, d).withColumns({"label": F.when(F.col("label").isin("view", "click"), "Update-Location Request").otherwise("Update-Location Answer"), "detail": made})
    return P.diameter_legs(rows)


@query(""", s as (select capture_id, 'a' || (k % 25) address, supi, ts, frame, label = 'purchase' released from m where supi is not null),
n as (select *, case when lag(supi) over w is null or lag(supi) over w <> supi or lag(released) over w then 1 else 0 end fresh from s window w as (partition by capture_id, address order by ts, frame)),
i as (select *, sum(fresh) over (partition by capture_id, address order by ts, frame) island from n),
g as (select capture_id, address, island, any_value(supi) supi, min(ts) valid_from, max(case when released then ts end) ended from i group by 1, 2, 3),
v as (select *, coalesce(ended, lead(valid_from) over (partition by capture_id, address order by island)) valid_to from g)
select m.capture_id, m.frame, case when v.valid_to is null or m.ts <= v.valid_to then v.supi end supi from m asof left join v on m.capture_id = v.capture_id and 'a' || (m.k % 25) = v.address and m.ts >= v.valid_from""")
def subscribers_of_addresses(spark, d):
    """D19 with the UE's address: whose it was when a packet of that address came."""
    address = F.concat(F.lit("a"), Q.detail("seqno").cast("int") % 25)
    rows = messages(spark, d).withColumns({"detail": F.create_map(F.lit("ue-ipv4"), address), "label": F.when(F.col("label") == "purchase", "Session release").otherwise(F.col("label"))})
    return L.subscriber_of_address(rows.select("capture_id", "frame", F.col("detail")["ue-ipv4"].alias("address"), "ts"), rows).select("capture_id", "frame", "supi")


@query(""", s as (select capture_id, ts, frame, supi, (k % 7)::varchar pdu_id, 't/' || (k % 8) tunnel from m where supi is not null and protocol in ('ngap', 'nas-5gs')),
n as (select *, case when lag(supi || pdu_id) over w is null or lag(supi || '|' || pdu_id) over w <> supi || '|' || pdu_id then 1 else 0 end fresh from s window w as (partition by capture_id, tunnel order by ts, frame)),
i as (select *, sum(fresh) over (partition by capture_id, tunnel order by ts, frame) island from n),
g as (select capture_id, tunnel, island, any_value(supi) supi, any_value(pdu_id) pdu_id, min(ts) valid_from from i group by 1, 2, 3)
select m.capture_id, g.supi, g.pdu_id, m.frame, m.protocol, 'upf' side from m asof join g on m.capture_id = g.capture_id and 't/' || (m.k % 8) = g.tunnel and m.ts >= g.valid_from where protocol = 'pfcp'""")
def messages_of_sessions(spark, d):
    """D10: PFCP messages on the tunnels of each PDU session, while the session had them."""
    k = Q.detail("seqno").cast("int")
    tunnel = F.struct(F.lit("gtp_teid").alias("kind"), F.concat(F.lit("t/"), k % 8).alias("value"))
    rows = messages(spark, d).withColumns({"keys": F.when(F.col("protocol").isin("ngap", "nas-5gs", "pfcp"), F.concat("keys", F.array(tunnel))).otherwise(F.col("keys")), "detail": F.when(F.col("protocol").isin("ngap", "nas-5gs"), F.create_map(F.lit("pdu-session-id"), (k % 7).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))})
    rows = rows.withColumn("keys", F.when(F.col("protocol") == "pfcp", F.filter("keys", lambda x: x["kind"] != "supi")).otherwise(F.col("keys")))
    return L.session_messages(rows).select("capture_id", "supi", "pdu_id", "frame", "protocol", "side")


CALLS = _recursive("""
, b as (select *, user_id || '-' || strftime(event_time, '%d') cid from m),
sip as (select * from b where protocol = 'sip'), spans as (select capture_id, cid call, min(ts) start, max(ts) stop from sip group by 1, 2),
mega as (select capture_id, frame, 'e' || user_id || '-' || (k + 2) e, 'x' || user_id || '-' || (k // 25) x from b where protocol = 'pfcp'),
link as (select capture_id, e a, x b from mega union select capture_id, x, e from mega),
reach as (select distinct capture_id, cid call, 'e' || user_id || '-' || k as key from sip union select r.capture_id, r.call, l.b from reach r join link l on l.capture_id = r.capture_id and l.a = r.key),
dia as (select capture_id, frame, ts, e2e, cid, k, 'f' || cid flow, case when k % 10 = 3 then cid end icid, '+15550001' || lpad((user_id % 40)::varchar, 3, '0') number from b where protocol = 'diameter'),
enu as (select capture_id, frame, ts, 'f' || cid flow from b where protocol = 'nas-5gs'),
sess as (select distinct d.capture_id, d.e2e, s.call from dia d join spans s on s.capture_id = d.capture_id and s.call = d.icid),
owner as (select distinct capture_id, flow, number from dia where k % 3 = 0),
caller as (select distinct s.capture_id, s.cid call, '+15550001' || lpad((user_id % 40)::varchar, 3, '0') number from sip s where label = 'view'),
wanted as (select distinct c.capture_id, c.call, o.flow, start, stop from caller c join owner o using (capture_id, number) join spans using (capture_id, call)),
asked as (select capture_id, frame, ts, flow from dia union all select * from enu),
every as (select capture_id, cid call, frame, 0 r from sip
  union all select distinct r.capture_id, r.call, g.frame, 1 from reach r join mega g on g.capture_id = r.capture_id and r.key in (g.e, g.x)
  union all select d.capture_id, s.call, d.frame, 2 from dia d join sess s on s.capture_id = d.capture_id and s.e2e = d.e2e
  union all select w.capture_id, w.call, a.frame, 3 from wanted w join asked a on a.capture_id = w.capture_id and a.flow = w.flow and a.ts between w.start and w.stop),
ways as (select capture_id, call, frame, ['signalling', 'media', 'charging', 'number'][min(r) + 1] way from every group by 1, 2, 3),
lone as (select d.* from dia d where not exists (select 1 from owner o where o.capture_id = d.capture_id and o.flow = d.flow))
""")


def _calls(spark, d):
    """events as SIP, H.248, Diameter and ENUM of calls: a call and a flow per user and day."""
    k, user, p = Q.detail("seqno").cast("int"), F.col("flow_id"), F.col("protocol")
    rows = messages(spark, d).withColumns({"k": k, "cid": F.concat_ws("-", "flow_id", F.date_format("event_time", "dd"))})
    number = F.concat(F.lit("+15550001"), F.lpad((user.cast("int") % 40).cast("string"), 3, "0"))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    part = lambda *x: F.concat_ws("-", *x)
    media = F.array(key("media_endpoint", F.concat(F.lit("e"), part(user, F.when(p == "pfcp", F.col("k") + 2).otherwise(F.col("k"))))))
    keys = F.when(p == "sip", media).when(p == "pfcp", F.concat(media, F.array(key("h248_context", F.concat(F.lit("x"), part(user, F.floor(F.col("k") / 25))))))).when((p == "diameter") & (F.col("k") % 3 == 0), F.array(key("msisdn", number))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    entry = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))
    facts = F.array_compact(F.array(entry("session-id", F.when(p == "diameter", Q.detail("end-to-end-id"))), entry("icid", F.when((p == "sip") | ((p == "diameter") & (F.col("k") % 10 == 3)), F.col("cid"))), entry("P-Asserted-Identity", F.when(p == "sip", F.concat(F.lit("sip:"), number, F.lit("@x"))))))
    name = F.when(p == "pfcp", "megaco").when(p == "nas-5gs", "enum").otherwise(p)
    return rows.withColumns({"keys": keys, "detail": F.map_from_entries(facts), "label": F.when((p == "sip") & (F.col("label") == "view"), "INVITE").otherwise(F.col("label")), "call": F.when(p == "sip", F.col("cid")), "flow_id": F.concat(F.lit("f"), "cid"), "protocol": name})


@query(CALLS + "select capture_id, call, frame, way from ways")
def messages_of_calls(spark, d):
    """H8 put together from media closure, charging sessions and numbers in the time of the call."""
    return A.messages_of_calls(_calls(spark, d), 3600.0).select("capture_id", "call", "frame", "way")


@query(CALLS + "select s.capture_id, s.call, count(l.frame) - count(w.frame) as unattributed from spans s left join lone l on l.capture_id = s.capture_id and l.ts between s.start and s.stop left join ways w on w.capture_id = s.capture_id and w.call = s.call and w.frame = l.frame group by 1, 2")
def unattributed_of_calls(spark, d):
    return A.unattributed_of_calls(_calls(spark, d))


@query("""with items as (select *, l_shipdate::timestamp + to_days((l_linenumber * 3 + l_partkey % 11)::int) l_end from lineitem), p as (select o_orderkey, o_orderdate::timestamp a, greatest(max(l_end), o_orderdate::timestamp) z from orders join items on l_orderkey = o_orderkey group by 1, 2), i as (select l_orderkey, l_returnflag || '/' || l_linenumber leg, greatest(l_shipdate::timestamp, a) s, least(l_end, z) e from items join p on l_orderkey = o_orderkey),
t as (select o_orderkey, a t from p union select o_orderkey, z from p union select l_orderkey, s from i where s < e union select l_orderkey, e from i where s < e),
c as (select o_orderkey, t, lead(t) over (partition by o_orderkey order by t) u from t),
o as (select c.o_orderkey, c.t, any_value(u) u, coalesce(first(leg order by s desc, e, leg) filter (leg is not null), 'between requests') leg from c left join i on i.l_orderkey = c.o_orderkey and s <= c.t and e >= c.u and s < e where u is not null group by 1, 2)
select o.o_orderkey, leg, sum(epoch_us(u) - epoch_us(t))::bigint micros, sum(epoch_us(u) - epoch_us(t)) / (epoch_us(any_value(z)) - epoch_us(any_value(a))) as share from o join p using (o_orderkey) group by 1, 2""")
def latency_of_legs(spark, d):
    """an order's time from its date to its last arrival, given to the shipment that was innermost on its way."""
    items = table(spark, d, "lineitem")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    items = items.select("l_orderkey", "l_returnflag", "l_linenumber", micros("l_shipdate").alias("start_us"), (micros("l_shipdate") + (F.col("l_linenumber") * 3 + F.col("l_partkey") % 11) * 86_400_000_000).alias("stop_us"))
    last = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("stop_us").alias("last"))
    orders = table(spark, d, "orders").join(last, "o_orderkey").select("o_orderkey", micros("o_orderdate").alias("start_us"), F.greatest("last", micros("o_orderdate")).alias("stop_us"))
    legs = items.select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws("/", "l_returnflag", "l_linenumber").alias("leg"), "start_us", "stop_us")
    return T.latency_slices(orders, legs, ["o_orderkey"])


@query("select c_custkey, true as own, true as same_shape, true as agree from customer")
def subscriber_pseudonyms(spark, d):
    """P1: no two customers share a pseudonym, shapes stay, and IMSI, SUCI and network name agree on the network and the number in it."""
    n = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    mnc = F.lpad((F.col("c_custkey") % 90 + 10).cast("string"), 2, "0")
    form = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("value"))
    forms = F.array(form("imsi", "466", mnc, n), form("suci", "suci-0-466-", mnc, "-0-0-0-", n), form("fqdn", "ims.mnc0", mnc, ".mcc466.3gppnetwork.org"), form("number", "886", n))
    rows = table(spark, d, "customer").select("c_custkey", F.explode(forms).alias("f")).select("c_custkey", "f.kind", "f.value")
    made = rows.join(PR.pseudonyms(rows, KEY), ["kind", "value"])
    shape = lambda c: F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[a-z]", "a")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("pseudonym")))
    held = made.groupBy("c_custkey").agg(F.min(~F.col("collides") & (F.col("pseudonym") != F.col("value"))).alias("own"), F.min(shape("value") == shape("pseudonym")).alias("same_shape"), of("imsi").alias("i"), of("suci").alias("s"), of("fqdn").alias("f"))
    mcc, code, number = F.substring("i", 1, 3), F.substring("i", 4, 2), F.substring("i", 6, 10)
    agree = (F.col("s") == F.concat(F.lit("suci-0-"), mcc, F.lit("-"), code, F.lit("-0-0-0-"), number)) & (F.col("f") == F.concat(F.lit("ims.mnc0"), code, F.lit(".mcc"), mcc, F.lit(".3gppnetwork.org")))
    return held.select("c_custkey", "own", "same_shape", agree.alias("agree"))


@query("""with v as (select distinct unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+)@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+', 1)) as v from documents) select 'email' as kind, count(*) originals, 0 as leaked, count(*) control, count(*) = 0 as blind from v having count(*) > 0""")
def leaked_addresses(spark, d):
    """P3 over mail addresses: none is left in the scrubbed texts, all are found in the given ones."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = PR.originals(docs, "doc_id", "text").where("kind = 'email'")
    return PR.leak_scan(found, docs, PR.scrub(docs, "text", KEY), "doc_id", "text")
