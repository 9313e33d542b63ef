"""Queries of Diameter flows and their ends, attributes of procedures, scenarios, explained failures and the summary, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import coverage as V
from callweave.operators import diameter_paths as D
from callweave.operators import links as L
from callweave.operators import procedures as X
from callweave.operators import rollups as R
from callweave.operators import sequences as Q
from callweave.operators import summary as Y
from callweave.plans import queries as base
from callweave.plans.registry import ORACLE_SQL, query
from callweave.plans.standins import causes, messages

COMMANDS = {"view": "Update-Location Request", "click": "Device-Watchdog Request", "signup": "Purge-UE Request", "purchase": "Update-Location Answer", "error": "Purge-UE Answer"}


def _by_label(names: dict):
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("label")]


def _diameter(spark, d):
    """Diameter of the stand-in as requests and answers between peers: every other user in sessions that several users share, so that legs relay."""
    user, k, answer = F.col("flow_id").cast("long"), Q.detail("seqno").cast("int"), F.col("label").isin("purchase", "error")
    more = F.map_from_entries(F.array_compact(F.array(*(
        F.when(when, F.struct(F.lit(name).alias("key"), value.alias("value")))
        for name, when, value in (("hop-by-hop-id", k % 10 == 3, F.concat(F.lit("h"), k)), ("session-id", user % 2 == 0, F.concat(F.lit("s"), user % 20)), ("reference_point", k % 4 > 0, F.lit("S6a")), ("redirect-host", (F.col("label") == "error") & (k % 3 == 0), F.lit("far")))
    ))))
    rows = messages(spark, d).withColumn("detail", F.map_concat("detail", more))
    return rows.withColumns({"src": F.when(answer, F.col("dst")).otherwise(F.col("src")), "dst": F.when(answer, F.col("src")).otherwise(F.col("dst")), "label": _by_label(COMMANDS)})


LEGS = """
, d as (select capture_id, case when user_id % 2 = 0 then 'session' else 'peer' end kind, src_ip || '|' || dst_ip peers, case when user_id % 2 = 0 then 's' || (user_id % 20) else src_ip || '|' || dst_ip end as session, label in ('purchase', 'error') ans, frame, ts, is_failure,
  case when label in ('purchase', 'error') then dst_ip else src_ip end src, case when label in ('purchase', 'error') then src_ip else dst_ip end dst, case when k % 10 = 3 then 'h' || k end hop, e2e, case when k % 4 > 0 then 'S6a' end interface, label = 'error' and k % 3 = 0 redirect,
  case when label = 'error' then 'nas_5gmm ' || k end cause, case when label in ('view', 'purchase') then 'Update-Location' when label = 'click' then 'Device-Watchdog' else 'Purge-UE' end command from m where protocol = 'diameter'),
o1 as (select *, row_number() over (partition by capture_id, kind, session, peers, hop, ans order by frame) n from d where hop is not null),
b1 as (select r.frame rf, a.frame af from o1 r join o1 a on not r.ans and a.ans and (r.capture_id, r.kind, r.session, r.peers, r.hop, r.n) = (a.capture_id, a.kind, a.session, a.peers, a.hop, a.n)),
o2 as (select *, row_number() over (partition by capture_id, kind, session, peers, e2e, ans order by frame) n from d where frame not in (select rf from b1 union select af from b1)),
b2 as (select r.frame rf, a.frame af from o2 r join o2 a on not r.ans and a.ans and (r.capture_id, r.kind, r.session, r.peers, r.e2e, r.n) = (a.capture_id, a.kind, a.session, a.peers, a.e2e, a.n)),
b as (select * from b1 union all select * from b2), used as (select rf f from b union all select af from b),
legs0 as (select * from b union all select case when not ans then frame end, case when ans then frame end from d where frame not in (select f from used)),
legs as (select coalesce(r.capture_id, a.capture_id) capture_id, coalesce(r.kind, a.kind) kind, coalesce(r.session, a.session) as session, coalesce(r.e2e, a.e2e) tx, least(coalesce(rf, af), coalesce(af, rf)) ff, coalesce(r.src, a.dst) "from", coalesce(r.dst, a.src) "to", rf, af, a.is_failure bad, a.cause cause from legs0 left join d r on rf = r.frame left join d a on af = a.frame),
tx as (select capture_id, kind, session, tx, count(*) hops, min(ff) ff, count(*) filter (rf is not null and af is null) unanswered, arg_min(bad, ff) filter (af is not null) bad, arg_min(cause, ff) filter (af is not null) cause from legs group by 1, 2, 3, 4)
"""


@query(LEGS + """, said as (select capture_id, kind, session, arg_min(struct_pack(v := interface), frame).v interface, count(*) messages, list_sort(list(distinct command)) commands, count(distinct e2e || command || cause) filter (is_failure) failures, bool_or(is_failure and not redirect) failed, bool_or(ans and not is_failure and not redirect) settled, min(frame) first_frame, max(frame) last_frame, round(max(ts) - min(ts), 6) duration from d group by 1, 2, 3),
done as (select capture_id, kind, session, count(*) transactions, max(hops) hops, max(hops) > 1 relayed, sum(unanswered)::bigint unanswered, arg_max(cause, ff) filter (bad) cause from tx group by 1, 2, 3),
whole as (select capture_id, kind, session, count(*) filter (af is null) open, bool_or(coalesce(bad, false)) refused from legs group by 1, 2, 3)
select capture_id, kind, session, interface, messages, commands, failures, first_frame, last_frame, duration, transactions, hops, relayed, unanswered, cause, case when kind = 'session' then case when failed then 'failure' when settled then 'success' else 'incomplete' end when refused then 'failure' when open = 0 then 'success' else 'incomplete' end outcome from said join done using (capture_id, kind, session) join whole using (capture_id, kind, session)""")  # fmt: skip
def diameter_flow_outcomes(spark, d):
    return D.flow_outcomes(_diameter(spark, d))[0]


@query(LEGS + """, l as (select capture_id, kind, session, arg_min(tx, ff) tx from legs group by 1, 2, 3), p as (select *, row_number() over (partition by capture_id, kind, session order by ff) place from legs join l using (capture_id, kind, session, tx))
select capture_id, kind, session, 0 place, "from" address from p where place = 1 union all select capture_id, kind, session, place::int, "to" from p""")  # fmt: skip
def diameter_flow_paths(spark, d):
    return D.flow_outcomes(_diameter(spark, d))[1]


KINDS = ("handover", "context-transfer", "tau", "service-request")


def _moves(spark, d):
    """Messages of moves between the systems, and each user's days as segments."""
    user, k = F.col("flow_id").cast("long"), Q.detail("seqno").cast("int")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    label = (
        F.when(F.col("label") == "view", "HandoverPreparation").when(F.col("label") == "click", F.when(k % 2 == 0, "HandoverPreparationResponse").otherwise("HandoverResourceAllocationResponse"))
        .when(F.col("label") == "signup", "HandoverNotification").when(F.col("label") == "purchase", F.when(k % 3 > 0, "Context Request").otherwise("Paging")).otherwise(F.when(k % 2 == 1, "HandoverCancel").otherwise("Context Acknowledge"))
    )
    protocol = F.when(user % 2 == 0, pick(("ngap", "pfcp"), k % 2)).otherwise(pick(("s1ap", "gtpv2", "diameter"), k % 3))
    ways = F.map_concat("detail", F.create_map(F.lit("handover-type"), pick(("intra5gs", "fivegs-to-eps", "eps-to-5gs"), user % 3)))
    rows = messages(spark, d).withColumns({"label": label, "protocol": protocol, "detail": ways, "src": F.col("src").withField("role", pick(("MME", "AMF", "gNB"), k % 3))})
    return rows, rows.select("capture_id", "flow_id", "frame", "seq", F.floor(F.col("ts") / 86400).alias("segment"), pick(KINDS, user % 4).alias("kind"))


MOVES = """
, l as (select *, floor(ts / 86400)::bigint segment, (['handover','context-transfer','tau','service-request'])[user_id % 4 + 1] kind, (['MME','AMF','gNB'])[k % 3 + 1] as role, (['intra5gs','fivegs-to-eps','eps-to-5gs'])[user_id % 3 + 1] ht,
  case when user_id % 2 = 0 then (['ngap','pfcp'])[k % 2 + 1] else (['s1ap','gtpv2','diameter'])[k % 3 + 1] end pr,
  case label when 'view' then 'HandoverPreparation' when 'click' then case when k % 2 = 0 then 'HandoverPreparationResponse' else 'HandoverResourceAllocationResponse' end when 'signup' then 'HandoverNotification' when 'purchase' then case when k % 3 > 0 then 'Context Request' else 'Paging' end else case when k % 2 = 1 then 'HandoverCancel' else 'Context Acknowledge' end end lb from m),
g as (select *, row_number() over (partition by flow_id, segment order by ts, frame) n from l),
s as (select capture_id, flow_id, segment, kind, min(frame) start_frame, min(ts) t0, arg_min(role, n) initiator, any_value(ht) handover_type, bool_or(lb = 'Paging') network, bool_or(lb = 'Context Request') fetched, bool_or(lb = 'HandoverCancel') cancelled, bool_or(pr = 'ngap') five, bool_or(pr in ('s1ap', 'gtpv2')) four,
  coalesce(min(ts) filter (lb = 'HandoverPreparationResponse'), min(ts) filter (lb = 'HandoverResourceAllocationResponse')) ready, min(ts) filter (lb = 'HandoverNotification') notify,
  max(n) filter ((kind = 'handover' and lb = 'HandoverNotification') or (kind = 'context-transfer' and lb = 'Context Acknowledge')) s, max(n) filter (is_failure) f, arg_max('nas_5gmm ' || k, n) filter (is_failure) cause from g group by 1, 2, 3, 4),
a as (select capture_id, flow_id, segment, kind, start_frame, initiator, handover_type, cause, round(ready - t0, 6) prep_s, round(notify - ready, 6) exec_s, case when kind = 'service-request' then case when network then 'network' else 'ue' end end as trigger,
  case when kind = 'handover' and ht2 then case handover_type when 'fivegs-to-eps' then '5gs-to-eps' else handover_type end when kind = 'context-transfer' then case initiator when 'MME' then '5gs-to-eps' when 'AMF' then 'eps-to-5gs' end when kind = 'tau' and fetched then '5gs-to-eps' end direction,
  case when five then '5g' when four then '4g' else 'other' end family, case when s is not null and (f is null or s > f) then 'success' when kind = 'handover' and cancelled then 'cancelled' when f is not null then 'failure' else 'incomplete' end outcome from (select *, handover_type <> 'intra5gs' ht2 from s))
"""


@query(MOVES + "select * from a")
def procedure_attributes(spark, d):
    made = X.finish(*_moves(spark, d))
    return made.select("capture_id", "flow_id", "segment", "kind", "start_frame", "initiator", "handover_type", "cause", "prep_s", "exec_s", "trigger", "direction", "family", "outcome")


@query(MOVES + """, c as (select capture_id, family, kind, direction, trigger, cause, count(*) n from a where cause is not null group by all), t as (select capture_id, family, kind, coalesce(direction, '') dd, coalesce(trigger, '') tt, min_by(cause, (-n, cause)) top_cause from c group by all),
r as (select capture_id, family, kind, direction, trigger, count(*) filter (outcome = 'success') success, count(*) filter (outcome = 'failure') failure, count(*) filter (outcome = 'incomplete') incomplete, count(*) filter (outcome = 'cancelled') cancelled, count(*) total, coalesce(min(start_frame) filter (outcome = 'failure'), min(start_frame)) sample_frame from a group by 1, 2, 3, 4, 5)
select r.*, top_cause, row_number() over (partition by r.capture_id order by failure desc, incomplete desc, total desc, r.family, r.kind, direction nulls first, trigger nulls first)::int place from r left join t on (r.capture_id, r.family, r.kind, coalesce(direction, ''), coalesce(trigger, '')) = (t.capture_id, t.family, t.kind, dd, tt)""")  # fmt: skip
def scenario_details(spark, d):
    return Y.scenario_details(X.finish(*_moves(spark, d)))


def _guide(spark):
    return causes(spark).select("table", "value", "name", F.lit("TS 24.501").alias("spec"), F.lit("9.11.3.2").alias("clause"), F.concat(F.lit("The network says: "), "name").alias("plain"), F.array("name").alias("common_causes"))


def _failures(spark, d):
    return Y.failure_records(R.failures(base.explained(spark, d)), _guide(spark))


EXPLAINED = base.FAILED + "select capture_id, frame, seq, protocol, label, 'nas_5gmm' cause_table, k cause_value, cause_name, case when c.name is not null then 'TS 24.501' end spec, case when c.name is not null then '9.11.3.2' end clause, 'The network says: ' || c.name explanation, case when c.name is not null then [c.name] end common_causes, c.name is not null known from x left join causes c on k = c.value"


@query(EXPLAINED)
def failure_records(spark, d):
    return _failures(spark, d)


def _summary_sql() -> str:
    part = lambda name, sql, frame, key, record: f"select capture_id, '{name}' section, {frame}::bigint at_frame, {key} at_key, to_json(struct_pack({record}))::varchar record from ({sql})"
    same = lambda names: ", ".join(f'"{n}" := "{n}"' for n in names.split())
    texts = lambda *c: " || '/' || ".join(f"coalesce({x}::varchar, '')" for x in c)
    o = ORACLE_SQL
    hidden = base.SQL + ", w as (select distinct capture_id, unnest(['no-subscriber', 'ciphered']) kind from m), n as (select capture_id, count(*) n from m where supi is null group by 1) select w.capture_id, kind, coalesce(case when kind = 'no-subscriber' then n end, 0) n from w left join n using (capture_id)"
    return "with z as (" + " union all ".join([
        part("capture", o["capture_facts"], "null", "''", "frames := frames, span_us := round(span * 1000000)::bigint, protocols := protocols"),
        part("not_visible", hidden, "null", texts("kind"), same("kind n")),
        part("network_elements", o["network_elements"], "null", texts("address"), same("address messages ports")),
        part("subscribers", f"select * from ({o['identities']}) where kind = 'supi'", "null", texts("value"), 'supi := "value", ' + same("messages flows failures")),
        part("procedures", o["procedures"], "start_frame", texts("flow_id", "segment"), same("flow_id segment kind outcome cause first_failure start_frame end_frame") + ", duration_us := round(duration * 1000000)::bigint, messages := messages, trigger := trigger, direction := null::varchar, " + same("dnn supi")),
        part("failures", EXPLAINED if EXPLAINED.startswith("with") else base.SQL + EXPLAINED, "frame", texts("protocol", "label"), same("frame protocol label cause_table cause_value cause_name known explanation common_causes")),
        part("cause_rollup", o["cause_rollup"], "first_frame", texts("cause_name"), same("cause_name n first_frame subscribers")),
        part("blast_radius", o["blast_radius"], "null", texts("dimension", '"value"'), same("dimension value failures subscribers")),
    ]) + ") select * from z"


@query(_summary_sql())
def summary_sections(spark, d):
    rows = messages(spark, d)
    hidden = L.not_visible(rows, rows.where("not exists(keys, k -> k.kind = 'supi')").select("capture_id", F.lit("no-subscriber").alias("kind"), F.lit(1).alias("n")), ["no-subscriber", "ciphered"])
    made = X.finish(rows, X.segment_procedures(rows, 3600.0, base.EVENT_OPENERS), base.EVENT_OPENERS)
    return Y.summary_sections(R.capture_facts(rows), hidden, base.network_elements(spark, d), R.identities(rows), made, _failures(spark, d), R.cause_rollup(base.explained(spark, d)), base.blast_radius(spark, d))


@query(base.KEYS + ", i as (select distinct capture_id, kind, value from keys where value is not null and (kind <> 'supi' or capture_id = 'cap0')), h as (select capture_id, count(*) filter (contains(value, '00101') or kind || '=' || value = '00101') hits, count(*) filter (kind = 'supi') supis from i group by 1), b as (select capture_id, count(*) n from m where k >= 95 group by 1) select c.capture_id, coalesce(hits, 0) hits, coalesce(supis, 0) supis, case when hits > 0 then null when n > 0 and c.capture_id <> 'cap2' then case when supis > 0 then 'some-protected' else 'all-protected' end when supis > 0 then 'no-match' when n > 0 then 'ciphered' else 'no-identity' end reason from (select distinct capture_id from m) c left join h using (capture_id) left join b using (capture_id)")
def search_reasons(spark, d):
    """SUPIs are known in one capture only; in one of the others they are concealed, in the other the NAS can't be read."""
    rows = messages(spark, d)
    spots = rows.where(Q.detail("seqno").cast("int") >= 95).select("capture_id", F.when(F.col("capture_id") == "cap2", "ciphered").otherwise("protected").alias("kind"), F.lit(1).alias("n"))
    return V.search_reasons(rows, R.identities(rows).where("kind <> 'supi' or capture_id = 'cap0'"), spots, "00101")
