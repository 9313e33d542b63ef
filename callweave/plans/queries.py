"""Registered queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.functions import scalars as S
from callweave.operators import correlate as C
from callweave.operators import pairing as P
from callweave.operators import procedures as X
from callweave.operators import rollups as R
from callweave.operators import sequences as Q
from callweave.plans.registry import ORACLE_SQL, QUERIES, query, table  # noqa: F401
from callweave.plans.standins import SQL, causes, messages

def explained(spark, d):
    return R.with_causes(messages(spark, d), causes(spark))


FAILED = ", x as (select m.*, coalesce(c.name, 'not catalogued') as cause_name from m left join causes c on m.k = c.value where is_failure and coalesce(c.outcome, '') <> 'user') "


@query(FAILED + "select capture_id, cause_name, count(*) n, min(frame) first_frame, count(distinct supi) subscribers from x group by all")
def cause_rollup(spark, d):
    return R.cause_rollup(explained(spark, d))


@query(FAILED + "select capture_id, frame, seq, protocol, label, 'nas_5gmm' cause_table, k cause_value, cause_name from x")
def failures(spark, d):
    return R.failures(explained(spark, d))


@query("select capture_id, dimension, value, count(*) failures, count(distinct supi) subscribers from (select capture_id, supi, unnest(['tac','dnn','core']) dimension, unnest([tac, dnn, dst_ip]) as value from m where is_failure) group by all")
def blast_radius(spark, d):
    return R.blast_radius(messages(spark, d), {"tac": Q.detail("tac"), "dnn": Q.detail("dnn"), "core": F.col("dst.ip")})


KEYS = ", keys as (select capture_id, frame, flow_id, is_failure, unnest(['supi','amf_ue_ngap_id','pfcp_seid']) kind, unnest([supi, 'cap/' || user_id, seid]) as value from m) "


@query(KEYS + ", kf as (select distinct capture_id, flow_id, kind, value from keys where value is not null), t as (select capture_id, flow_id, count(*) n, count(*) filter (is_failure) f, max(supi) supi from m group by 1, 2) select capture_id, kind, value, sum(n)::bigint messages, count(*) flows, sum(f)::bigint failures, count(distinct supi) supis, case when contains(value, '/') then split_part(value, '/', 1) end as scope from kf join t using (capture_id, flow_id) group by capture_id, kind, value")
def identities(spark, d):
    return R.identities(messages(spark, d))


@query(KEYS + "select distinct capture_id, frame, kind, value from keys join m using (capture_id, frame) where value is not null")
def frame_owners(spark, d):
    return R.frame_owners(messages(spark, d))


@query(KEYS + "select capture_id, kind, count(distinct value) as values, count(*) messages from keys join m using (capture_id, frame) where value is not null group by all")
def key_availability(spark, d):
    return R.availability(messages(spark, d))


@query("select capture_id, address, count(*) messages, count(distinct port) ports, list_sort(list(distinct role)) roles from (select capture_id, src_ip address, k % 5 port, 'r' || (k % 2) as role from m union all select capture_id, dst_ip, 80, 'core' from m) group by all")
def network_elements(spark, d):
    k = Q.detail("seqno").cast("int")
    src = F.col("src").withField("port", k % 5).withField("role", F.concat(F.lit("r"), k % 2))
    dst = F.col("dst").withField("port", F.lit(80)).withField("role", F.lit("core"))
    return R.network_elements(messages(spark, d).withColumns({"src": src, "dst": dst}))


@query("select capture_id, count(distinct frame) frames, round(max(ts) - min(ts), 6) span, min(event_time) started_at, list_sort(list(distinct protocol)) protocols from m group by all")
def capture_facts(spark, d):
    return R.capture_facts(messages(spark, d)).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


GAPS = ", g as (select *, (epoch_us(event_time) - lag(epoch_us(event_time)) over w) / 1e6 gap, lag(label) over w prev_label, lag(frame) over w prev_frame from m window w as (partition by capture_id, flow_id order by ts, frame)) "


@query(GAPS + "select capture_id, frame, round(gap, 6) delta, coalesce(gap > 3600, false) slow from g join m using (capture_id, frame)")
def message_deltas(spark, d):
    return Q.deltas(messages(spark, d), slow=3600.0).select("capture_id", "frame", "delta", "slow")


@query("select capture_id, frame from (select *, row_number() over (partition by capture_id, flow_id, e2e, label, case when is_failure then k end order by frame) n from m) where n = 1")
def relay_dedupe(spark, d):
    return Q.distinct_observed(messages(spark, d)).select("capture_id", "frame")


@query(GAPS + "select capture_id, flow_id, prev_frame, frame, round(gap, 6) gap, 'T1' timer from g join m using (capture_id, frame, flow_id) where g.is_failure and gap between 21600 * 0.85 and 21600 * 1.15 and prev_label in ('click', 'view') and (['ngap','nas-5gs','pfcp','diameter','sip'])[(select k from m p where p.frame = prev_frame) % 5 + 1] = 'nas-5gs'")
def timer_hints(spark, d):
    return Q.timer_hints(messages(spark, d), timers=(("T1", 21600.0, "nas-5gs", ("click", "view")),))


@query(", r as (select *, case when ts - lag(ts) over w <= 86400 then 0 else 1 end as fresh from m where protocol = 'nas-5gs' window w as (partition by capture_id, flow_id, src_ip, dst_ip, label, supi, seid order by ts, frame)), i as (select *, sum(fresh) over (partition by capture_id, flow_id, src_ip, dst_ip, label, supi, seid order by ts, frame rows unbounded preceding) run from r) select capture_id, flow_id, src_ip, dst_ip, label, count(*) n, min(frame) first_frame, max(frame) last_frame, round(max(ts) - min(ts), 6) span from i group by capture_id, flow_id, src_ip, dst_ip, label, supi, seid, run having count(*) >= 2")
def nas_retransmissions(spark, d):
    return Q.nas_retransmissions(messages(spark, d), window=86400.0).drop("key_set", "run")


@query("select capture_id, src_ip, dst_ip, label, cast(k as varchar) id, count(*) n, min(frame) first_frame, min(flow_id) flow_id, false flagged from m where protocol = 'pfcp' group by all having count(*) > 1")
def pfcp_retransmissions(spark, d):
    return Q.confirmed_retransmissions(messages(spark, d), "pfcp", "seqno")


@query("select capture_id, src_ip, dst_ip, e2e id, count(*) n, min(frame) first_frame, min(flow_id) flow_id, false flagged from m where protocol = 'diameter' group by all having count(*) > 1")
def diameter_retransmissions(spark, d):
    return Q.confirmed_retransmissions(messages(spark, d), "diameter", "end-to-end-id")


@query("select capture_id, frame, e - ts <= 3600 near_end from m join (select capture_id, max(ts) e from m group by 1) using (capture_id)")
def tail_notes(spark, d):
    return Q.tail_note(messages(spark, d), 3600.0).select("capture_id", "frame", "near_end")


@query(", s as (select *, sum(case when label = 'signup' then 1 else 0 end) over (partition by capture_id, flow_id order by ts, frame rows unbounded preceding) connection from m), t as (select *, min(case when label = 'purchase' then frame end) over (partition by capture_id, flow_id, connection) rf from s where connection > 0), u as (select capture_id, flow_id, connection::bigint connection, min(frame) start_frame, min(ts) \"start\", coalesce(any_value(rf), max(frame)) end_frame, count(*) messages from t group by 1, 2, 3) select u.*, m.ts as \"end\", round(m.ts - u.\"start\", 6) duration from u join m on m.frame = u.end_frame")
def radio_connections(spark, d):
    return Q.radio_connections(messages(spark, d), F.col("label") == "signup", F.col("label") == "purchase")


@query("select capture_id, flow_id, frame, shown, total from (select *, row_number() over (partition by capture_id, flow_id order by ts, frame)::int shown, count(*) over (partition by capture_id, flow_id) total from m) where shown <= 5")
def ladder_truncated(spark, d):
    return Q.truncate_ladder(messages(spark, d), 5).select("capture_id", "flow_id", "frame", "shown", "total")


@query("select capture_id, flow_id, (frame // 4) frame, src_ip, min(ts) ts, string_agg(label, ' + ' order by ts, seq, label, protocol) label, bool_or(is_failure) is_failure from m group by 1, 2, 3, 4, dst_ip")
def collapsed_frames(spark, d):
    rows = messages(spark, d).withColumn("frame", F.floor(F.col("frame") / 4))
    return Q.collapse_frames(rows).select("capture_id", "flow_id", "frame", "src_ip", "ts", "label", "is_failure")


EVENTS = ", ev as (select capture_id, flow_id, count(*) filter (is_failure) f from m group by all), re as (select capture_id, flow_id, count(*) r from (select capture_id, min(flow_id) flow_id from m where protocol = 'pfcp' group by capture_id, src_ip, dst_ip, label, k having count(*) > 1) group by all), ss as (select capture_id, flow_id, min(ts) \"start\", max(ts) \"end\", round(max(ts) - min(ts), 6) duration, count(*) messages, list_sort(list(distinct protocol)) protocols, any_value(f) failures, coalesce(any_value(r), 0) retransmissions, 0::bigint unanswered from m join ev using (capture_id, flow_id) left join re using (capture_id, flow_id) group by all), ls as (select *, case when failures > 0 then 'red' when retransmissions > 0 then 'amber' else 'green' end light from ss) "


def _sessions(spark, d):
    rows = messages(spark, d)
    events = Q.status_events(rows, Q.confirmed_retransmissions(rows, "pfcp", "seqno"), rows.where("false"))
    return R.sessions(rows, events)


@query(EVENTS + "select * from ls")
def sessions(spark, d):
    return _sessions(spark, d)


@query(EVENTS + "select capture_id, case when flow_id::int % 10 > 0 then 'group' || (flow_id::int % 10) end subscriber, count(*) sessions, sum(messages)::bigint messages, sum(failures)::bigint failures, min(\"start\") \"start\", max(\"end\") \"end\", case min(case light when 'red' then 0 when 'amber' then 1 else 2 end) when 0 then 'red' when 1 then 'amber' else 'green' end light from ls group by 1, 2")
def subscribers(spark, d):
    s = _sessions(spark, d)
    groups = s.select("capture_id", "flow_id", (F.col("flow_id").cast("int") % 10).alias("g")).where("g > 0").select("capture_id", "flow_id", F.concat(F.lit("group"), "g").alias("subscriber"))
    return R.subscribers(s, groups)


@query("select a.capture_id, a.frame, cast(b.frame as varchar) bound from (select * from m where label = 'click') a asof left join (select * from m where label = 'view') b on a.user_id = b.user_id and a.ts > b.ts")
def late_body_attach(spark, d):
    rows = messages(spark, d)
    left = rows.where("label = 'click'").select("capture_id", "flow_id", "frame", "ts")
    right = rows.where("label = 'view'").select("capture_id", "flow_id", "ts", F.col("frame").cast("string").alias("bound"))
    return P.asof_backward(left, right, ["capture_id", "flow_id"], "ts", ["bound"]).select("capture_id", "frame", "bound")


QUOTED = ", q as (select capture_id, flow_id, frame, ts, case when k % 2 = 0 then 'forwarded' else 'reported' end looks from m where label = 'click'), s as (select capture_id, flow_id, frame, ts, label = 'purchase' releases from m where label in ('view', 'purchase')), b as (select q.*, p.frame pf, p.ts pt, p.releases pr from q asof left join s p on q.capture_id = p.capture_id and q.flow_id = p.flow_id and q.frame > p.frame), n as (select b.*, x.frame nf, x.ts nt from b asof left join s x on b.capture_id = x.capture_id and b.flow_id = x.flow_id and b.frame < x.frame) "


@query(QUOTED + "select capture_id, 'flow' kind, flow_id as value, frame, looks, cast(case when not pr and (looks = 'forwarded' or ts - pt <= 7200) then pf when looks = 'forwarded' and nt - ts <= 3600 then nf end as varchar) bound_frame from n")
def quote_binding(spark, d):
    rows = messages(spark, d).select("capture_id", F.lit("flow").alias("kind"), F.col("flow_id").alias("value"), "frame", "ts", "label", F.when(Q.detail("seqno").cast("int") % 2 == 0, "forwarded").otherwise("reported").alias("looks"))
    seen = rows.where("label in ('view', 'purchase')").withColumn("releases", F.col("label") == "purchase")
    return P.bind_quotes(rows.where("label = 'click'"), seen, 7200.0, 3600.0).withColumn("bound_frame", F.col("bound_frame").cast("string"))


@query("select coalesce(r.k, a.k) order_key, coalesce(r.n, a.n)::int n, r.t request_at, a.t answer_at from (select o_orderkey k, o_orderdate t, 1 n from orders) r full join (select l_orderkey k, l_shipdate t, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber) n from lineitem) a on r.k = a.k and r.n = a.n")
def request_answer_pairs(spark, d):
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").alias("at"), F.lit(0).alias("line"))
    answers = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("line"))
    return P.pair_hops(requests, answers, ["order_key"], ["at", "line"]).select("order_key", "n", F.col("request.at").alias("request_at"), F.col("answer.at").alias("answer_at"))


@query("select o_orderkey order_key, o_orderdate as \"at\" from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def unanswered_requests(spark, d):
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").alias("at"))
    return P.unanswered(requests, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key")), ["order_key"])


@query("select o_orderkey order_key, min(case when l_shipdate >= o_orderdate then epoch_us(l_shipdate) / 1e6 end) answered_at, round(min(case when l_shipdate >= o_orderdate then epoch_us(l_shipdate) / 1e6 end) - epoch_us(o_orderdate) / 1e6, 6) delay from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderdate")
def first_answer_delay(spark, d):
    at = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1e6).alias("at")
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), at("o_orderdate"))
    answers = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), at("l_shipdate"))
    return P.first_answer_after(requests, answers, ["order_key"], "at").select("order_key", "answered_at", "delay")


# Flows of the test table: users of one capture that share a session key, directly or through others. Named by the least key.
FLOWS = "with recursive " + SQL[5:] + ", n as (select distinct capture_id || '|amf_ue_ngap_id=cap/' || user_id u, capture_id || '|pfcp_seid=' || seid v from m where seid is not null), e as (select u a, v b from n union select v, u from n), w as (select a node, a root from e union select e.b, w.root from w join e on w.node = e.a), c as (select node, min(root) root from w group by 1), fl as (select m.*, coalesce(c.root, capture_id || '|amf_ue_ngap_id=cap/' || user_id) flow from m left join c on c.node = capture_id || '|amf_ue_ngap_id=cap/' || user_id) "


@query(FLOWS + "select capture_id, frame, flow as flow_id from fl")
def correlated_flows(spark, d):
    return C.correlate(messages(spark, d).drop("flow_id")).select("capture_id", "frame", "flow_id")


@query(FLOWS + "select flow as flow_id, count(distinct supi) supis, count(distinct supi) parts from fl group by 1 having count(distinct supi) > 1")
def supi_bridge_audit(spark, d):
    """The shared session key stands for a kind that bridges by reuse; users are apart without it."""
    bridge = F.transform("keys", lambda k: F.when(k["kind"] == "pfcp_seid", k.withField("kind", F.lit("s_tmsi"))).otherwise(k))
    return C.supi_bridges(C.correlate(messages(spark, d).drop("flow_id").withColumn("keys", bridge)))


@query(", k as (select distinct capture_id, flow_id, case when supi is not null then user_id % 50 end g from m), p as (select capture_id, g, min(flow_id) least from k where g is not null group by 1, 2) select capture_id, flow_id, coalesce(min(least), flow_id) subscriber from k left join p using (capture_id, g) group by 1, 2")
def subscriber_groups(spark, d):
    """Users with the same remainder share their SUPI."""
    shared = F.transform("keys", lambda k: F.when(k["kind"] == "supi", k.withField("value", (F.col("flow_id").cast("long") % 50).cast("string"))).otherwise(k))
    return C.subscriber_groups(messages(spark, d).withColumn("keys", shared))


@query("with legs as (select 'cap' as capture_id, l_orderkey || '-' || l_linenumber leg, 's' || l_suppkey icid, epoch_us(l_shipdate) / 1e6 as \"start\", epoch_us(l_shipdate) / 1e6 + 86400 * l_quantity / 10 as \"end\" from lineitem), r as (select *, case when \"start\" <= max(\"end\") over (partition by icid order by \"start\", \"end\", leg rows between unbounded preceding and 1 preceding) then 0 else 1 end fresh from legs), i as (select *, sum(fresh) over (partition by icid order by \"start\", \"end\", leg rows unbounded preceding)::bigint isl from r) select capture_id, leg, icid || '#' || isl as call from i")
def call_legs(spark, d):
    start = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6
    legs = table(spark, d, "lineitem").select(F.lit("cap").alias("capture_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("leg"), F.concat(F.lit("s"), "l_suppkey").alias("icid"), start.alias("start"), (start + 86400 * F.col("l_quantity") / 10).alias("end"))
    return C.merge_legs(legs).select("capture_id", "leg", "call")


EVENT_OPENERS = (("visit", "view", True, ("click",)), ("order", "signup", True, ("purchase",)))
# The rules of segmentation as a walk over each flow, message by message.
SEGMENTED = (
    "with recursive " + SQL[5:] + ", s as (select capture_id, flow_id, frame, seq, ts, label, is_failure, k, supi, dnn, row_number() over (partition by capture_id, flow_id order by ts, frame) n from m where protocol <> 'sip')"
    ", w as (select distinct capture_id, flow_id, 0::bigint n, null::bigint frame, 0::bigint num, null::varchar kind, 0.0::double last, false failed, false outcome from s"
    " union all select capture_id, flow_id, n, frame, num, kind, case when kind is null then last else ts end, coalesce(failed, false) or (kind is not null and is_failure),"
    " outcome or coalesce((kind = 'visit' and label = 'click') or (kind = 'order' and label = 'purchase'), false)"
    " from (select capture_id, flow_id, n, frame, ts, label, is_failure, last, num + fresh::int num, case when fresh then opened else k0 end kind, failed and not fresh failed, outcome and not fresh outcome"
    " from (select *, opened is not null and not coalesce(k0 = opened and not failed and not outcome, false) fresh"
    " from (select s.capture_id, s.flow_id, s.n, s.frame, s.ts, s.label, s.is_failure, w.last, w.num, w.failed, w.outcome, case when w.kind is not null and w.outcome and s.ts - w.last > 3600 then null else w.kind end k0,"
    " case s.label when 'view' then 'visit' when 'signup' then 'order' end opened from w join s on s.capture_id = w.capture_id and s.flow_id = w.flow_id and s.n = w.n + 1))))"
    ", g as (select s.*, case when w.kind is not null then w.num end segment, w.kind from s join w using (capture_id, flow_id, n)) "
)


@query(SEGMENTED + "select capture_id, flow_id, frame, seq, segment, kind from g")
def procedure_segments(spark, d):
    return X.segment_procedures(messages(spark, d), 3600.0, EVENT_OPENERS)


FINISHED = (
    SEGMENTED + ", f as (select capture_id, flow_id, segment, kind, min(frame) start_frame, max(frame) end_frame, min(ts) \"start\", max(ts) \"end\", round(max(ts) - min(ts), 6) duration, count(*) messages,"
    " max(n) filter ((kind = 'visit' and label = 'click') or (kind = 'order' and label = 'purchase')) s, max(n) filter (is_failure) f,"
    " arg_max('nas_5gmm ' || k, n) filter (is_failure) cause, arg_min('nas_5gmm ' || k, n) filter (is_failure) first_cause, case when min(dnn) = max(dnn) then min(dnn) end dnn, min(supi) supi"
    " from g where segment is not null group by 1, 2, 3, 4)"
    ", p as (select *, case when s is not null and (f is null or s > f) then 'success' when f is not null then 'failure' else 'incomplete' end outcome, case when cause <> first_cause then first_cause end first_failure from f) "
)


@query(FINISHED + "select capture_id, flow_id, segment, kind, outcome, cause, first_failure, start_frame, end_frame, \"start\", \"end\", duration, messages, null::varchar as trigger, null::varchar handover_type, null::varchar pdu_session_id, dnn, null::varchar initiator, null::double prep_s, null::double exec_s, supi from p")
def procedures(spark, d):
    rows = messages(spark, d)
    return X.finish(rows, X.segment_procedures(rows, 3600.0, EVENT_OPENERS), EVENT_OPENERS).drop("first_pos", "last_pos", "direction", "family")


@query(SEGMENTED + "select capture_id, count(*) messages, count(segment) assigned, count(*) filter (segment is null) unassigned from g group by 1")
def xdr_totals(spark, d):
    rows = messages(spark, d)
    return X.xdr_totals(rows, X.segment_procedures(rows, 3600.0, EVENT_OPENERS))


@query("select page_id, lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/:?#]+)', 1)) host, regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) as path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page from pages")
def url_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", S.host_of(url).alias("host"), S.path_of(url).alias("path"), F.try_element_at(S.query_parameters(url), F.lit("page")).alias("page"))


from callweave.operators import coverage as V  # noqa: E402
from callweave.operators import privacy as PR  # noqa: E402
from callweave.operators import records as D  # noqa: E402
from callweave.operators import roles as O  # noqa: E402


def packets(spark, d):
    """lineitem as packets: chains from flags, ports from parts, pieces from line numbers."""
    li = table(spark, d, "lineitem")
    chain = F.concat_ws(":", F.lit("eth"), F.when(F.col("l_linestatus") == "F", "ip").otherwise("ipv6"), F.element_at(F.array(*map(F.lit, ("tcp", "udp", "sctp"))), (F.col("l_partkey") % 3 + 1).cast("int")), F.when(F.col("l_returnflag") == "R", F.lit("ngap")))
    return li.select(
        F.concat(F.lit("cap"), F.col("l_suppkey") % 4).alias("capture_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number"), F.concat(F.lit("10.1.0."), F.col("l_suppkey") % 50).alias("src"), F.concat(F.lit("10.2.0."), F.col("l_partkey") % 40).alias("dst"),
        (1000 + F.col("l_partkey") % 25).cast("int").alias("src_port"), (2000 + F.col("l_suppkey") % 9).cast("int").alias("dst_port"), chain.alias("protocols"), F.element_at(F.split(chain, ":"), -1).alias("protocol"), F.col("l_linestatus").alias("info"), F.when(F.col("l_linenumber") == 7, F.col("l_orderkey") * 10 + 1).alias("reassembled_in"),
        F.when(F.col("l_linenumber") == 5, F.array(F.col("l_orderkey") * 10 + 2, F.col("l_orderkey") * 10 + 3)).otherwise(F.array().cast("array<long>")).alias("fragments"), (F.col("l_suppkey") % 30).alias("stream"),
    )


PACKETS = "with p as (select distinct 'cap' || (l_suppkey % 4) capture_id, l_orderkey * 10 + l_linenumber number, '10.1.0.' || (l_suppkey % 50) src, '10.2.0.' || (l_partkey % 40) dst, (1000 + l_partkey % 25)::int src_port, (2000 + l_suppkey % 9)::int dst_port, 'eth:' || (case when l_linestatus = 'F' then 'ip' else 'ipv6' end) || ':' || (['tcp','udp','sctp'])[l_partkey % 3 + 1] || (case when l_returnflag = 'R' then ':ngap' else '' end) protocols, case when l_linenumber = 7 then l_orderkey * 10 + 1 end reassembled_in, case when l_linenumber = 5 then [l_orderkey * 10 + 2, l_orderkey * 10 + 3] else [] end fragments, l_suppkey % 30 stream, l_returnflag = 'R' decoded, l_linestatus info from lineitem), p2 as (select *, string_split(protocols, ':')[-1] leaf from p) "


def _packets(spark, d):
    return packets(spark, d).distinct()


def _decoded(p):
    return p.where("protocol = 'ngap'").select("capture_id", F.col("number").alias("frame"))


@query(PACKETS + ", d as (select distinct capture_id, number from p2 where decoded) select capture_id, leaf, left(protocols, length(protocols) - length(leaf) - 1) as chain, least(src_port, dst_port) as port, count(*) frames, min(number) first_frame from p2 anti join d using (capture_id, number) group by all")
def coverage_census(spark, d):
    p = _packets(spark, d)
    return V.census(p, _decoded(p))


@query(PACKETS + ", d as (select distinct capture_id, number, true parsed from p2 where decoded), f as (select distinct capture_id, unnest(fragments) number, true piece from p2), k as (select capture_id, case when parsed then 'p' when piece then 'f' when reassembled_in is not null then 's' else 'm' end kind from p2 left join d using (capture_id, number) left join f using (capture_id, number)) select capture_id, count(*) total, count(*) filter (kind = 'p') parsed, count(*) filter (kind = 'f') fragments, count(*) filter (kind = 's') segments, count(*) filter (kind = 'm') missed, round(1 - count(*) filter (kind = 'm') / count(*), 6) ratio from k group by 1")
def coverage_totals(spark, d):
    p = _packets(spark, d)
    return V.coverage(p, _decoded(p))


@query(PACKETS + "select capture_id, count(distinct case when src < dst then src || '|' || dst else dst || '|' || src end) pairs from p2 where leaf = 'ngap' group by 1")
def address_pairs(spark, d):
    return V.address_pairs(_packets(spark, d), "ngap")


@query(PACKETS + ", d as (select distinct capture_id, number from p2 where decoded), c as (select capture_id, least(src_port, dst_port) as port, count(*) frames from p2 anti join d using (capture_id, number) group by 1, 2 having count(*) >= 10) select capture_id, port, frames from (select *, row_number() over (partition by capture_id order by frames desc, port in (1003, 1007) desc, port) n from c) where n = 1")
def suggested_port(spark, d):
    p = _packets(spark, d)
    return V.suggest_port(V.census(p, _decoded(p)), [1003, 1007])


@query(PACKETS + "select capture_id, dst_port server_port, count(*) frames from p2 where leaf <> 'ngap' group by 1, 2 having count(*) >= 2 qualify row_number() over (partition by capture_id order by count(*) desc, dst_port) <= 8")
def unclaimed_ports(spark, d):
    return V.unclaimed_ports(_packets(spark, d).where("protocol <> 'ngap'").withColumnRenamed("dst_port", "server_port"))


@query(PACKETS + "select capture_id, dst_port server_port, count(distinct stream) streams, case when min(leaf) = max(leaf) then min(leaf) end protocol, min(leaf) <> max(leaf) mixed from p2 group by 1, 2")
def port_protocols(spark, d):
    return V.port_protocols(_packets(spark, d).withColumnRenamed("dst_port", "server_port"))


@query(PACKETS + ", b as (select capture_id, leaf, count(*) n from p2 where number % 3 > 0 group by 1, 2), a as (select capture_id, leaf, count(*) n from p2 group by 1, 2) select capture_id, sum(coalesce(b.n, 0))::bigint as before, sum(coalesce(a.n, 0))::bigint as after, bool_and(coalesce(a.n, 0) >= coalesce(b.n, 0)) and sum(coalesce(a.n, 0)) > sum(coalesce(b.n, 0)) accepted from b full join a using (capture_id, leaf) group by 1")
def accepted_rerun(spark, d):
    p = _packets(spark, d)
    return V.accept_rerun(p.where("number % 3 > 0"), p)


@query(PACKETS + ", h as (select distinct capture_id, stream from p2 where contains(number::varchar, '12345')) select capture_id, count(*) frames from p2 join h using (capture_id, stream) group by 1")
def narrowed_conversations(spark, d):
    p = _packets(spark, d).withColumn("transport", F.lit("tcp"))
    return V.narrow(p, F.col("number").cast("string"), "12345").groupBy("capture_id").agg(F.count("*").alias("frames"))


@query(PACKETS + "select capture_id, number from p2 where contains(leaf, 'tcp') or contains(src, 'tcp') or contains(dst, 'tcp') or contains(lower(info), 'tcp')")
def packet_search(spark, d):
    return V.search(_packets(spark, d), "TCP").select("capture_id", "number")


@query(PACKETS + ", f as (select distinct capture_id, unnest(fragments) frame from p2) select * from f anti join (select distinct capture_id, number frame from p2 where decoded) using (capture_id, frame)")
def piece_frames(spark, d):
    p = _packets(spark, d)
    return V.piece_frames(p, _decoded(p))


@query(PACKETS + ", f as (select capture_id, number whole, unnest(fragments) fragment from p2) select f.*, p2.number is not null present from f left join p2 on f.capture_id = p2.capture_id and f.fragment = p2.number")
def fragment_links(spark, d):
    return P.fragments_of(_packets(spark, d))


@query("select capture_id, frame from m where ts between 1704100000.0 and 1705100000.0")
def time_window(spark, d):
    return V.time_window(messages(spark, d), 1704100000.0, 1705100000.0).select("capture_id", "frame")


@query("select capture_id, frame from m where flow_id in (select flow_id from m where supi = '001010000000042')")
def identity_selection(spark, d):
    return V.select_identity(messages(spark, d), "supi", "001010000000042").select("capture_id", "frame")


@query("select capture_id, address, role, 'wire-hint' basis, [role] roles from (select distinct 'net' as capture_id, 's' || s_nationkey address, 'AMF' as role from supplier where s_nationkey not in (select c_nationkey from customer where c_nationkey % 2 = 0) union select distinct 'net', 's' || c_nationkey, 'gNB' from customer where c_nationkey % 2 = 0 and c_nationkey not in (select s_nationkey from supplier)) union all select distinct 'net', 's' || s_nationkey, null, 'wire-hint', ['AMF', 'gNB'] from supplier where s_nationkey in (select c_nationkey from customer where c_nationkey % 2 = 0)")
def resolved_roles(spark, d):
    return O.resolve_roles(_votes(spark, d))


def _votes(spark, d):
    vote = lambda df, c, role, basis: df.select(F.lit("net").alias("capture_id"), F.concat(F.lit("s"), c).alias("address"), F.lit(None).cast("int").alias("port"), F.lit(role).alias("role"), F.lit(basis).alias("basis")).distinct()
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    strong = vote(s, "s_nationkey", "AMF", "wire-hint").unionByName(vote(c.where("c_nationkey % 2 = 0"), "c_nationkey", "gNB", "wire-hint"))
    return strong.unionByName(vote(c, "c_nationkey", "SMF", "user-agent").join(strong.select("address").distinct(), "address", "left_semi"))


@query("select distinct 'net' as capture_id, 's' || s_nationkey address, ['AMF', 'gNB'] roles from supplier where s_nationkey in (select c_nationkey from customer where c_nationkey % 2 = 0)")
def role_contradictions(spark, d):
    return O.role_contradictions(O.resolve_roles(_votes(spark, d)))


@query(", h as (select capture_id, e2e id, case when src_ip < dst_ip then src_ip || '|' || dst_ip else dst_ip || '|' || src_ip end peers, min(frame) first_frame, min(case when label = 'purchase' then frame end) af, count(*) messages from m where protocol = 'diameter' group by 1, 2, 3) select capture_id, id, count(*) hops, count(*) > 1 relayed, min(first_frame) first_frame, sum(messages)::bigint messages, case when count(af) > 0 then 'Update-Answer' end answer, case when count(af) > 0 then 'success' else 'unanswered' end outcome from h group by 1, 2")
def diameter_transactions(spark, d):
    rows = messages(spark, d).withColumn("label", F.when(F.col("label") == "purchase", "Update-Answer").otherwise("Update-Request"))
    return D.diameter_transactions(rows)


@query("select capture_id, case when src_ip < dst_ip then src_ip || '|' || dst_ip else dst_ip || '|' || src_ip end as session, list_sort(list(distinct label)) commands, 1::bigint hops, count(*) messages, count(*) filter (is_failure) failures, min(frame) first_frame, round(max(ts) - min(ts), 6) duration from m where protocol = 'diameter' group by 1, 2")
def diameter_flows(spark, d):
    return D.diameter_flows(messages(spark, d))


@query("select capture_id, supi, tac pdu_id, first_frame, messages, f.dnn, f.frame dnn_frame from (select capture_id, supi, tac, min(frame) first_frame, count(*) messages, min_by({'dnn': dnn, 'frame': frame}, frame) filter (dnn is not null) f from m where supi is not null and tac is not null group by 1, 2, 3) where f is not null")
def pdu_sessions(spark, d):
    rows = messages(spark, d).withColumn("detail", F.map_concat("detail", F.when(Q.detail("tac").isNotNull(), F.create_map(F.lit("pdu-session-id"), Q.detail("tac"))).otherwise(F.create_map().cast("map<string,string>"))))
    return D.pdu_sessions(rows).where("dnn is not null").select("capture_id", "supi", "pdu_id", "first_frame", "messages", F.col("dnn.value").alias("dnn"), F.col("dnn.frame").alias("dnn_frame"))


@query()
def summary_documents(spark, d):
    rows = messages(spark, d)
    return D.summary_table(R.capture_facts(rows), R.cause_rollup(explained(spark, d)), blast_radius(spark, d), R.network_elements(rows))


KEY = b"test key"


@query(r"with f as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) as v from documents) select doc_id as id, count(*) n from f group by 1")
def found_addresses(spark, d):
    return PR.originals(table(spark, d, "documents"), "doc_id", "text").where("kind = 'email'").groupBy("id").agg(F.count("*").alias("n"))


ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


@query("select doc_id, length(text) as length, len(regexp_extract_all(text, '" + ADDRESS + "')) as addresses, 0 as addresses_left from documents")
def scrubbed_lengths(spark, d):
    """A scrubbed text is as long as before and holds none of the addresses that it held."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = F.regexp_extract_all("text", F.lit(ADDRESS), 0)
    both = docs.select("doc_id", found.alias("before")).join(PR.scrub(docs, "text", KEY).select("doc_id", "text"), "doc_id")
    left = F.size(F.filter("before", lambda a: F.col("text").contains(a)))
    return both.select("doc_id", F.length("text").cast("long").alias("length"), F.size("before").cast("long").alias("addresses"), left.alias("addresses_left"))


@query()
def leak_scan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return PR.leak_scan(PR.originals(docs, "doc_id", "text"), docs, PR.scrub(docs, "text", KEY), "doc_id", "text")


@query()
def pseudonym_table(spark, d):
    return PR.pseudonyms(PR.originals(table(spark, d, "documents"), "doc_id", "text"), KEY)


@query("select capture_id, frame, event_time - t0 + timestamp '2000-01-01' as event_time from m join (select capture_id, min(event_time) t0 from m group by 1) using (capture_id)")
def shifted_clocks(spark, d):
    return PR.shift_clock(messages(spark, d)).select("capture_id", "frame", F.col("event_time").cast("timestamp_ntz"))


from callweave import normalise as N  # noqa: E402
from callweave.sources import readers as RD  # noqa: E402


def _frames(spark, d):
    """events written as dissected lines and read back as frames: PFCP session messages."""
    rows = messages(spark, d)
    k = Q.detail("seqno").cast("int")
    block = F.struct(
        F.when(F.col("label") == "view", "50").when(F.col("label") == "click", "51").when(F.col("label") == "purchase", "55").otherwise("57").alias("pfcp_pfcp_msg_type"),
        F.array(F.concat(F.lit("0x"), F.lower(F.hex(F.col("flow_id").cast("int")))), F.lit("0x0")).alias("pfcp_pfcp_seid"),
        k.cast("string").alias("pfcp_pfcp_seqno"), F.when(F.col("is_failure"), F.lit("64")).otherwise("1").alias("pfcp_pfcp_cause"),
    )
    layers = F.struct(F.struct(F.col("frame").cast("string").alias("frame_frame_number")).alias("frame"), F.struct(F.col("src.ip").alias("ip_ip_src"), F.col("dst.ip").alias("ip_ip_dst")).alias("ip"), block.alias("pfcp"))
    lines = rows.select("capture_id", F.to_json(F.struct((F.col("ts") * 1000).cast("decimal(20,3)").cast("string").alias("timestamp"), layers.alias("layers"))).alias("value"))
    noise = rows.where("frame % 7 = 0").select("capture_id", F.element_at(F.array(F.lit("{broken"), F.lit(""), F.lit('{"index": {}}')), (F.col("frame") % 3 + 1).cast("int")).alias("value"))
    return lines.unionByName(noise)


@query("select capture_id, case (frame % 3) when 0 then 'malformed' when 1 then 'blank' else 'index' end reason, count(*) n from m where frame % 7 = 0 group by 1, 2")
def bad_lines(spark, d):
    return RD.bad_lines(_frames(spark, d))


@query("select capture_id, frame, src_ip, dst_ip from m")
def parsed_frames(spark, d):
    return RD.with_endpoints(RD.parse_frames(_frames(spark, d))).select("capture_id", "frame", "src_ip", "dst_ip")


@query("select capture_id, frame, case label when 'view' then 'Session Establishment Request' when 'click' then 'Session Establishment Response' when 'purchase' then 'Session Deletion Response' else 'Session Report Response' end label, is_failure, case when user_id > 0 then (case when src_ip < dst_ip then src_ip || ',' || dst_ip else dst_ip || ',' || src_ip end) || '/' || user_id end seid, case when label = 'purchase' and user_id > 0 then 1 else 0 end::int releases from m")
def normalised_pfcp(spark, d):
    rows = N.normalise(RD.with_endpoints(RD.parse_frames(_frames(spark, d))), ["pfcp"])
    return rows.select("capture_id", "frame", "label", "is_failure", F.get("keys.value", F.lit(0)).alias("seid"), F.size("releases").alias("releases"))


VOTES = ", v as (select capture_id, frame, k, src_ip, dst_ip, protocol, case when protocol = 'pfcp' and label = 'view' then 'smf' when protocol = 'ngap' and label = 'view' then 'amf-answer' when protocol = 'ngap' and label = 'click' then 'n2' when protocol = 'diameter' and label = 'view' then 'air' end as what from m), u as (select capture_id, src_ip address, case what when 'smf' then 'SMF' when 'amf-answer' then 'AMF' when 'air' then 'MME' end as role, case what when 'smf' then 'pfcp-dir' when 'air' then 'diameter-dir' else 'ngap-dir' end basis, frame, null::int port from v union all select capture_id, dst_ip, case what when 'smf' then 'UPF' when 'amf-answer' then 'gNB' when 'air' then 'HSS' when 'n2' then 'AMF' end, case what when 'smf' then 'pfcp-dir' when 'air' then 'diameter-dir' when 'n2' then 'n2-port' else 'ngap-dir' end, frame, case when what = 'n2' then 38412 end from v) "


@query(VOTES + "select capture_id, address, port::int port, role, arg_min(basis, frame) basis from u where role is not null group by 1, 2, 3, 4")
def role_votes(spark, d):
    rows, p = messages(spark, d), F.col("protocol")
    view, click = F.col("label") == "view", F.col("label") == "click"
    label = F.when((p == "pfcp") & view, "Session Establishment Request").when((p == "ngap") & view, "InitialUEMessageResponse").when((p == "diameter") & view, "3GPP-Authentication-Information Request").otherwise(F.col("label"))
    asked = F.create_map(F.lit("application-id"), F.lit("16777251"), F.lit("command-code"), F.lit("318"))
    dst = F.when((p == "ngap") & click, F.col("dst").withField("port", F.lit(38412))).otherwise(F.col("dst"))
    return O.role_votes(rows.withColumns({"label": label, "dst": dst, "detail": F.when((p == "diameter") & view, F.map_concat("detail", asked)).otherwise(F.col("detail"))}))


@query(", c as (select distinct capture_id, src_ip a, dst_ip b from m), e as (select capture_id, a x, b y from c union select capture_id, b, a from c), h as (select capture_id, x address from e group by 1, 2 having count(distinct y) >= 2) select capture_id, address, 'P-CSCF' as role, 'ipsec-fanout' basis from h union all select distinct capture_id, y, 'UE', 'ipsec-fanout' from e where (capture_id, x) in (select capture_id, address from h) and (capture_id, y) not in (select capture_id, address from h)")
def fanout_votes(spark, d):
    return O.fanout_votes(messages(spark, d).select("capture_id", F.col("src.ip").alias("a"), F.col("dst.ip").alias("b")))


CHAINS = ", x as (select capture_id, flow_id, ts, frame, seq, label, is_failure, '10.0.0.' || (k % 3) as ip, row_number() over (partition by capture_id, flow_id order by ts, frame) n from m), f as (select capture_id, flow_id, min(n) filter (is_failure) f, max(n) filter (is_failure) l from x group by 1, 2 having count(*) filter (is_failure) > 0), p as (select f.*, (select ip from x where x.capture_id = f.capture_id and x.flow_id = f.flow_id and x.n = f.f) fip from f), o as (select p.capture_id, p.flow_id, max(x.n) n from p join x using (capture_id, flow_id) where x.n < p.f and x.ip <> p.fip group by 1, 2), st as (select capture_id, flow_id, 1::bigint n, 'origin' step from f union all select capture_id, flow_id, n, 'sender' from o union all select capture_id, flow_id, f, 'first failure' from f union all select capture_id, flow_id, l, 'last failure' from f) "


@query(CHAINS + "select capture_id, flow_id, step, frame, ip, label from st join x using (capture_id, flow_id, n)")
def causal_chains(spark, d):
    rows = messages(spark, d).withColumn("src", F.col("src").withField("ip", F.concat(F.lit("10.0.0."), Q.detail("seqno").cast("int") % 3)))
    chain = Q.causal_chain(rows, ["capture_id", "flow_id"])
    return chain.select("capture_id", "flow_id", F.explode(chain.columns[-1]).alias("x")).select("capture_id", "flow_id", "x.step", "x.frame", "x.ip", "x.label")


@query(", o as (select capture_id, frame, case when label = 'view' then 'a' else 'b' end kind, case when is_failure then 'failure' when k % 4 = 0 then 'incomplete' else 'success' end outcome, case when is_failure then 'c' || (k % 3) end cause from m), t as (select capture_id, kind, arg_min(cause, (-n, cause)) top_cause from (select capture_id, kind, cause, count(*) n from o where cause is not null group by 1, 2, 3) group by 1, 2), r as (select capture_id, kind, count(*) filter (outcome = 'success') success, count(*) filter (outcome = 'failure') failure, count(*) filter (outcome = 'incomplete') incomplete, count(*) total, coalesce(min(frame) filter (outcome = 'failure'), min(frame)) sample_frame from o group by 1, 2) select *, row_number() over (partition by capture_id order by failure desc, incomplete desc, total desc, kind)::int place from r left join t using (capture_id, kind)")
def kind_totals(spark, d):
    k, bad = Q.detail("seqno").cast("int"), F.col("is_failure")
    rows = messages(spark, d).select("capture_id", F.when(F.col("label") == "view", "a").otherwise("b").alias("kind"), F.when(bad, "failure").when(k % 4 == 0, "incomplete").otherwise("success").alias("outcome"), F.col("frame").alias("start_frame"), F.when(bad, F.concat(F.lit("c"), k % 3)).alias("cause"))
    return R.scenario_breakdown(rows)


@query(FAILED + ", once as (select *, row_number() over (partition by capture_id, flow_id, e2e, label, k order by frame) n from x), o as (select capture_id, cause_name card, count(distinct frame) n from once where n = 1 group by 1, 2), a as (select capture_id, cause_name card, count(distinct frame) frames, min(frame) first_frame, count(distinct case when src_ip < dst_ip then src_ip || dst_ip else dst_ip || src_ip end) peers from x group by 1, 2) select *, row_number() over (partition by capture_id order by n desc, first_frame, card)::int place from o join a using (capture_id, card)")
def cause_cards(spark, d):
    rows = explained(spark, d)
    return R.cause_cards(Q.distinct_observed(rows), rows)


@query(KEYS + ", kf as (select distinct capture_id, flow_id, kind, value from keys where value is not null), t as (select capture_id, flow_id, count(*) n, count(*) filter (is_failure) f, max(supi) supi from m group by 1, 2) select capture_id, kind, value, sum(n)::bigint messages, count(*) flows, sum(f)::bigint failures, count(distinct supi) supis, case when contains(value, '/') then split_part(value, '/', 1) end as scope from kf join t using (capture_id, flow_id) where contains(lower(value), '42') group by capture_id, kind, value")
def message_search_identities(spark, d):
    return V.lookup(R.identities(messages(spark, d)), "42")


ROLES = ", r as (select capture_id, src_ip address, case when user_id % 2 = 0 then 'gNB' else 'AMF' end as role from m group by all union all select capture_id, dst_ip, 'AMF' from m group by all) "


def _roles(rows):
    user = F.col("flow_id").cast("int")
    a = rows.select("capture_id", F.col("src.ip").alias("address"), F.when(user % 2 == 0, "gNB").otherwise("AMF").alias("role"))
    return a.unionByName(rows.select("capture_id", F.col("dst.ip").alias("address"), F.lit("AMF").alias("role"))).distinct()


@query(ROLES + "select m.capture_id, frame, s.role src_role, t.role dst_role from m join r s on s.capture_id = m.capture_id and s.address = src_ip join r t on t.capture_id = m.capture_id and t.address = dst_ip")
def applied_roles(spark, d):
    rows = messages(spark, d)
    return P.apply_roles(rows, _roles(rows)).select("capture_id", "frame", F.col("src.role").alias("src_role"), F.col("dst.role").alias("dst_role"))


@query("select capture_id, case when user_id % 2 = 0 and protocol = 'ngap' then 'N2' when user_id % 2 = 0 and protocol = 'nas-5gs' then 'N1' else 'none' end interface, count(*) messages from m group by 1, 2")
def reference_points(spark, d):
    rows = messages(spark, d)
    points = spark.createDataFrame([("ngap", "AMF", "gNB", "N2"), ("nas-5gs", "gNB", "AMF", "N1")], "protocol string, role_a string, role_b string, interface string")
    return P.reference_points(P.apply_roles(rows, _roles(rows)), points).groupBy("capture_id", F.coalesce("interface", F.lit("none")).alias("interface")).agg(F.count("*").alias("messages"))


@query("select s_suppkey supplier, coalesce(case when s_suppkey % 10 = 0 then s_name end, case when o.lo = o.hi then o.lo end, '-') host from supplier left join (select s_nationkey n, min(case when s_acctbal > 3000 then s_name end) lo, max(case when s_acctbal > 3000 then s_name end) hi from supplier group by 1) o on s_nationkey = o.n")
def filled_hosts(spark, d):
    s = table(spark, d, "supplier")
    ends = s.select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("transaction"), F.lit(None).cast("string").alias("host"), F.when(F.col("s_suppkey") % 10 == 0, F.col("s_name")).alias("hint"), F.when(F.col("s_acctbal") > 3000, F.col("s_name")).alias("origin"))
    return P.fill_hosts(ends, ["transaction"]).select("supplier", F.coalesce("host", F.lit("-")).alias("host"))


@query(PACKETS + "select capture_id, stream % 7 esp_spi, count(*) packets, stream % 7 < 4 declared from p2 group by all")
def declared_associations(spark, d):
    p = _packets(spark, d).withColumn("esp_spi", F.col("stream") % 7)
    held = p.where("esp_spi < 4").select("capture_id", F.col("esp_spi").alias("spi"), F.lit(True).alias("readable")).distinct()
    return P.declared_spis(p, held).select("capture_id", "esp_spi", "packets", "declared")


@query(PACKETS + "select capture_id, stream, src_port, count(*) frames from p2 group by all having count(*) >= 4 and count(distinct case when stream < 15 then 1 else number % 2 end) = 1")
def synthetic_sequences(spark, d):
    p = _packets(spark, d).withColumns({"payload": F.lit(1), "seq_raw": F.when(F.col("stream") < 15, 1).otherwise(F.col("number") % 2)})
    return V.synthetic_sequences(p)


@query(PACKETS + ", u as (select capture_id, port, count(distinct stream) n from (select capture_id, stream, src_port as port from p2 union all select capture_id, stream, dst_port from p2) group by 1, 2), e as (select capture_id, stream, min(src_port) a, max(src_port) b, min_by(dst_port, number) pay from p2 group by 1, 2) select e.capture_id, stream, case when ua.n > ub.n then a when ub.n > ua.n then b else pay end server_port from e join u ua on ua.capture_id = e.capture_id and ua.port = a join u ub on ub.capture_id = e.capture_id and ub.port = b")
def server_ports(spark, d):
    p = _packets(spark, d).withColumns({"payload": F.lit(1), "syn": F.lit(False), "ack": F.lit(False)})
    return V.server_ports(p)


@query("with r as (select 'net' as capture_id, 's' || s_suppkey address, case when s_nationkey % 3 = 0 then null when s_nationkey % 3 = 1 then 'UE' else 'R' || s_nationkey end as role from supplier), b as (select *, coalesce(role, address) base from r where role is null or role <> 'UE') select capture_id, address, case when count(*) over (partition by base) > 1 then base || ' (' || address || ')' else base end lane from b")
def lanes(spark, d):
    s = table(spark, d, "supplier")
    n = F.col("s_nationkey") % 3
    resolved = s.select(F.lit("net").alias("capture_id"), F.concat(F.lit("s"), "s_suppkey").alias("address"), F.when(n == 1, "UE").when(n == 2, F.concat(F.lit("R"), "s_nationkey")).alias("role"))
    return O.lanes(resolved)


@query("with o as (select 'cap' as capture_id, o_custkey spi, o_orderstatus receiver, o_orderkey frame, case when o_orderkey % 3 = 0 then 'null' else 'aes' end cipher from orders) select capture_id, spi, receiver, min(frame) frame, min_by(cipher, frame) cipher, min_by(cipher, frame) = 'null' readable from o group by 1, 2, 3")
def security_associations(spark, d):
    o = table(spark, d, "orders").select(F.lit("cap").alias("capture_id"), F.col("o_custkey").alias("spi"), F.col("o_orderstatus").alias("receiver"), F.col("o_orderkey").alias("frame"), F.when(F.col("o_orderkey") % 3 == 0, "null").otherwise("aes").alias("cipher"))
    return D.security_associations(o)


@query("select m.capture_id, m.flow_id, user_id % 5 connection, arg_min(label, frame) intent, case min(case when is_failure then 0 when label = 'view' then 1 else 2 end) when 0 then 'failure' when 1 then 'incomplete' else 'success' end outcome, arg_min('nas_5gmm ' || k, frame) filter (is_failure) cause, round(max(ts) - min(ts), 6) duration from m group by 1, 2, 3")
def connection_summaries(spark, d):
    rows = messages(spark, d).select("capture_id", "flow_id", (F.col("flow_id").cast("long") % 5).alias("connection"), F.col("frame").alias("start_frame"), F.col("label").alias("kind"), F.when(F.col("is_failure"), "failure").when(F.col("label") == "view", "incomplete").otherwise("success").alias("outcome"), F.when(F.col("is_failure"), F.concat_ws(" ", "cause.table", "cause.value")).alias("cause"), F.col("ts").alias("start"), F.col("ts").alias("end"))
    return Q.connection_summary(rows)


@query("select a.o_orderkey order_a, b.c_custkey customer from orders a join customer b on a.o_custkey = b.c_custkey union select a.o_orderkey, b.c_custkey from orders a join customer b on a.o_orderkey = b.c_custkey")
def calls_of_subscribers(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("flow"), F.col("o_orderkey").alias("number"))
    b = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("flow"), F.col("c_custkey").alias("number"))
    return P.by_either(a, b, ["flow", "number"], [F.col("o_orderkey").alias("order_a"), F.col("c_custkey").alias("customer")])


@query("with legs as (select 'cap' as capture_id, l_suppkey c, l_orderkey || '-' || l_linenumber leg from lineitem), n as (select capture_id, c, count(*) n from legs group by 1, 2) select capture_id, count(*) calls, sum(n)::bigint legs, count(*) filter (n > 1) merged from n group by 1")
def call_totals(spark, d):
    return C.call_totals(table(spark, d, "lineitem").select(F.lit("cap").alias("capture_id"), F.col("l_suppkey").alias("call")))


from callweave.operators import links as L  # noqa: E402


@query(", o as (select capture_id, frame, 'group' || (user_id % 10) subscriber, is_failure from m where k % 2 = 0) select m.capture_id, m.frame as number, o.subscriber, case when o.is_failure then 'ERROR' when o.is_failure is not null then 'SUCCESS' end status from m left join o on m.capture_id = o.capture_id and m.frame = o.frame")
def packet_status(spark, d):
    rows = messages(spark, d)
    owners = rows.select("capture_id", "flow_id", F.concat(F.lit("group"), F.col("flow_id").cast("int") % 10).alias("subscriber")).distinct()
    return L.packet_status(rows.select("capture_id", F.col("frame").alias("number")), rows.where(Q.detail("seqno").cast("int") % 2 == 0), owners)


@query(", p as (select distinct capture_id, flow_id, supi from m where supi is not null), t as (select distinct capture_id, flow_id, seid as value from m where seid is not null) select capture_id, value, case when min(supi) = max(supi) then min(supi) end supi from t join p using (capture_id, flow_id) group by 1, 2")
def target_subscribers(spark, d):
    rows = messages(spark, d)
    targets = rows.select(F.explode("keys").alias("k")).where("k.kind = 'pfcp_seid'").select(F.col("k.value").alias("value")).distinct()
    return L.subscriber_of(targets, rows)


@query("select capture_id, kind, case when kind = 'error' then 0 else count(*) filter (label = kind) end::bigint n from m, (values ('view'), ('error'), ('click')) v(kind) group by 1, 2")
def not_visible(spark, d):
    rows = messages(spark, d)
    spots = rows.where("label <> 'error'").select("capture_id", F.col("label").alias("kind"), F.lit(1).cast("long").alias("n"))
    return L.not_visible(rows, spots, ["view", "error", "click"])


@query(SEGMENTED + "select m.capture_id, m.frame, g.segment, g.kind as procedure from m left join g using (capture_id, frame, seq)")
def message_owners(spark, d):
    rows = messages(spark, d)
    return L.with_owner(rows, X.segment_procedures(rows, 3600.0, EVENT_OPENERS)).select("capture_id", "frame", "segment", "procedure")


from callweave.plans import outcome_queries, protocol_queries, rule_queries, scalar_queries, time_queries, view_queries  # noqa: E402, F401
