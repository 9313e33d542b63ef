import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from callweave.functions import scalars as S
from callweave.operators import correlate as C
from callweave.operators import coverage as V
from callweave.operators import pairing as P
from callweave.operators import privacy as PR
from callweave.operators import procedures as X
from callweave.operators import roles as O
from callweave.operators import rollups as R
from callweave.operators import sequences as Q
from callweave.operators.components import connected_components
from callweave.schema import MESSAGES
from callweave.streaming import live


def message(frame, ts, label, protocol="ngap", flow="f", keys=(), releases=(), failed=False, cause=None, src="10.0.0.1", dst="10.0.0.2", detail=None, capture="cap", port=None, role=None):
    end = lambda ip, r=None, p=None: {"ip": ip, "port": p, "host": None, "role": r, "lane": None}
    key = lambda ks: [{"kind": k, "value": v} for k, v in ks]
    return {"capture_id": capture, "frame": frame, "seq": 0, "ts": float(ts), "event_time": datetime.fromtimestamp(1_700_000_000 + ts, UTC), "protocol": protocol, "label": label, "src": end(src, role), "dst": end(dst, None, port), "keys": key(keys), "releases": key(releases), "quotes": [], "cause": cause and {"table": cause[0], "value": cause[1]}, "is_failure": failed, "detail": detail or {}, "flow_id": flow}


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame(rows, MESSAGES + ", flow_id string")


def segments(table, rows):
    got = X.segment_procedures(table(rows)).collect()
    return [(r.segment, r.kind) for r in sorted(got, key=lambda r: r.frame)]


def test_a_retry_after_a_reject_is_a_new_segment(table):
    rows = [message(1, 0, "Registration request"), message(2, 0.1, "Registration reject", failed=True, cause=("nas_5gmm", 21)), message(3, 0.2, "Registration request"), message(4, 0.3, "Registration accept"), message(5, 0.4, "UplinkNASTransport"), message(6, 9, "UplinkNASTransport")]
    assert segments(table, rows) == [(1, "registration"), (1, "registration"), (2, "registration"), (2, "registration"), (2, "registration"), (None, None)]
    done = {r.segment: r for r in X.finish(table(rows), X.segment_procedures(table(rows))).collect()}
    assert (done[1].outcome, done[2].outcome) == ("failure", "success") and done[1].cause == "nas_5gmm 21"
    totals = X.xdr_totals(table(rows), X.segment_procedures(table(rows))).first()
    assert totals.messages == totals.assigned + totals.unassigned == 6


def test_an_opener_again_merges_and_a_quiet_gap_needs_an_outcome(table):
    assert segments(table, [message(1, 0, "Attach request"), message(2, 5, "Attach request"), message(3, 9, "x")]) == [(1, "attach")] * 3
    assert segments(table, [message(1, 0, "Attach request"), message(2, 1, "Context Request"), message(3, 2, "Detach request")]) == [(1, "attach"), (1, "attach"), (2, "detach")]
    assert segments(table, [message(1, 0, "Extended service request")]) == [(1, "csfb")]
    assert segments(table, [message(1, 0, "HandoverPreparationResponse")]) == [(None, None)]


def test_releases_fold_only_into_what_is_just_before(table):
    rows = [message(1, 0, "Registration request"), message(2, 0.5, "Registration accept"), message(3, 3, "UEContextReleaseRequest"), message(4, 3.1, "UEContextReleaseComplete"), message(5, 6, "UEContextReleaseCommand"), message(6, 6.1, "UEContextReleaseComplete")]
    m = table(rows)
    s = X.segment_procedures(m)
    got = X.fold_releases(X.finish(m, s), X.segment_positions(m, s)).orderBy("segment").collect()
    assert [(r.kind, r.folded_into) for r in got] == [("registration", None), ("ue-context-release", 1), ("ue-context-release", None)]


def test_sip_and_diameter_segments(table):
    call = [("sip_call_id", "c1")]
    rows = [message(1, 0, "INVITE", "sip", keys=call, detail={"cseq-method": "INVITE", "from-tag": "a"}), message(2, 1, "180 Ringing", "sip", keys=call, detail={"cseq-method": "INVITE"}), message(3, 4, "200 OK", "sip", keys=call, detail={"cseq-method": "INVITE"}), message(4, 9, "BYE", "sip", keys=call, detail={"cseq-method": "BYE", "from-tag": "b"})]
    r = X.sip_segments(table(rows)).first()
    assert (r.kind, r.ring_s, r.answer_s, r.talk_s, r.released_by, r.final_status, r.outcome) == ("invite", 1.0, 4.0, 5.0, "callee", 200, "success")
    rows = [message(1, 0, "User-Data Request", "diameter", detail={"session-id": "s", "end-to-end-id": "1"}), message(2, 0, "User-Data Request", "diameter", detail={"session-id": "s", "end-to-end-id": "1"}), message(3, 1, "User-Data Answer", "diameter", detail={"session-id": "s", "end-to-end-id": "1"})]
    r = X.diameter_segments(table(rows)).first()
    assert (r.kind, r.messages, r.outcome) == ("hss-user-data", 2, "success")


def test_flows_join_by_shared_keys_and_exchange_keys_make_none(table):
    rows = [message(1, 0, "a", keys=[("supi", "1"), ("amf_ue_ngap_id", "x/1")]), message(2, 1, "b", keys=[("amf_ue_ngap_id", "x/1"), ("pfcp_seid", "9")]), message(3, 2, "c", keys=[("pfcp_seid", "9")]), message(4, 3, "d", keys=[("amf_ue_ngap_id", "y/1")]), message(5, 4, "e", keys=[("sbi_stream", "1")]), message(6, 5, "f"), message(1, 0, "a", keys=[("supi", "1")], capture="other")]
    flows = {(r.capture_id, r.frame): r.flow_id for r in C.correlate(table(rows).drop("flow_id")).collect()}
    assert flows["cap", 1] == flows["cap", 2] == flows["cap", 3] != flows["cap", 4] and flows["cap", 5] is flows["cap", 6] is None
    assert flows["other", 1] not in (flows["cap", 1], None) and len(flows) == 7


def test_episodes_split_only_after_an_observed_release(table):
    k = [("amf_ue_ngap_id", "x/1"), ("ran_ue_ngap_id", "x/2")]
    rows = [message(1, 0, "a", keys=k), message(2, 1, "release", keys=k[:1], releases=k[:1]), message(3, 2, "b", keys=k), message(4, 3, "c", keys=[("amf_ue_ngap_id", "z/1")]), message(5, 4, "t", keys=[("gtpv2_transaction", "q")], releases=[("gtpv2_transaction", "q")]), message(6, 5, "t", keys=[("gtpv2_transaction", "q")])]
    got = {r.frame: [x.value for x in r.keys] for r in C.assign_episodes(table(rows)).collect()}
    assert got == {1: ["x/1", "x/2"], 2: ["x/1"], 3: ["x/1@2", "x/2@2"], 4: ["z/1"], 5: ["q"], 6: ["q@2"]}
    kept = table(rows[:1] + rows[3:4])
    assert C.assign_episodes(kept) is kept


def test_quotes_never_put_two_people_together(spark):
    quotes = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "a", "c"), (4, "c", "d"), (9, "x", "y")], "frame long, a string, b string")
    people = spark.createDataFrame([("a", ["1"]), ("c", ["2"]), ("x", [])], "flow_id string, supis array<string>")
    got = {r.frame: r.verdict for r in C.apply_quotes(quotes, people).collect()}
    assert got == {1: "joined", 2: "refused", 3: "refused", 4: "joined", 9: "joined"}


def test_quote_binding_bounds(spark):
    seen = spark.createDataFrame([("cap", "k", "v", 10, 100.0, False), ("cap", "k", "w", 10, 100.0, True), ("cap", "k", "n", 30, 200.0, False)], "capture_id string, kind string, value string, frame long, ts double, releases boolean")
    q = [("v", "reported", 20, 150.0), ("v", "reported", 21, 170.0), ("v", "forwarded", 22, 900.0), ("w", "forwarded", 20, 101.0), ("n", "forwarded", 20, 191.0), ("n", "forwarded", 21, 180.0), ("n", "reported", 22, 199.0), ("v", "forwarded", 10, 100.0)]
    quotes = spark.createDataFrame([("cap", "k", v, looks, f, t) for v, looks, f, t in q], "capture_id string, kind string, value string, looks string, frame long, ts double")
    got = {(r.value, r.frame): r.bound_frame for r in P.bind_quotes(quotes, seen).collect()}
    assert got == {("v", 20): 10, ("v", 21): None, ("v", 22): 10, ("w", 20): None, ("n", 20): 30, ("n", 21): None, ("n", 22): None, ("v", 10): None}


def test_components_equal_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 360)] + [(900, k) for k in range(901, 960)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize(("gap", "hit"), [(5.0, False), (5.2, True), (6.0, True), (6.8, True), (7.0, False)])
def test_timer_tolerance(table, gap, hit):
    rows = [message(1, 0, "Authentication request", "nas-5gs"), message(2, gap, "UEContextReleaseCommand", detail={"release-initiator": "core"})]
    assert [r.timer for r in Q.timer_hints(table(rows)).collect()] == (["T3560"] if hit else [])


def test_failure_sequences(spark, table):
    rules = spark.createDataFrame([("nas_5gmm", [21, 111], "keys differ"), ("nas_5gmm", [21], "synch")], "table string, values array<int>, says string")
    rows = [message(1, 0, "x", failed=True, cause=("nas_5gmm", 21)), message(2, 1, "x", failed=True, cause=("nas_5gmm", 111)), message(3, 2, "x", failed=True, cause=("nas_5gmm", 1)), message(4, 0, "x", flow="g", failed=True, cause=("nas_5gmm", 210))]
    assert [(r.flow_id, r.says) for r in Q.match_sequences(table(rows), rules, ["capture_id", "flow_id"]).collect()] == [("f", "keys differ")]


def test_roles_strongest_tier_families_ports_and_relays(spark, table):
    votes = [("a", None, "AMF", "n2-port"), ("a", None, "SMF", "user-agent"), ("b", None, "PGW", "pfcp-dir"), ("b", None, "PCEF", "diameter-dir"), ("c", 1, "AMF", "service"), ("c", 2, "SMF", "service"), ("d", 1, "AMF", "service"), ("d", 1, "SMF", "service")]
    frame = spark.createDataFrame([("cap", *v) for v in votes], "capture_id string, address string, port int, role string, basis string")
    got = {r.address: r.role for r in O.resolve_roles(frame).collect()}
    assert got == {"a": "AMF", "b": "PGW", "c:1": "AMF", "c:2": "SMF", "d": None}
    path = lambda f, s, d, p: message(f, f, "GET", "sbi", src=s, dst=d, detail={"path": p})
    rows = [path(1, "x", "scp", "/a"), path(2, "scp", "y", "/a"), path(3, "x", "scp", "/b"), path(4, "scp", "y", "/b"), path(5, "x", "z", "/c"), path(6, "z", "y", "/c"), message(7, 7, "R", "diameter", src="dra", detail={"relay-record": "h"})]
    assert {(r.address, r.role) for r in O.find_relays(table(rows)).collect()} == {("scp", "SCP"), ("dra", "DRA")}


def test_blast_radius_sums_to_the_failures(table):
    rows = [message(k, k, "x", failed=k % 2 == 0, keys=[("supi", str(k % 3))], detail={"tac": str(k % 4)} if k % 4 else {}) for k in range(20)]
    got = R.blast_radius(table(rows), {"tac": Q.detail("tac"), "core": F.col("dst.ip")}).collect()
    assert {d: sum(r.failures for r in got if r.dimension == d) for d in ("tac", "core")} == {"tac": 10, "core": 10}
    assert any(r.value is None for r in got)


def test_radio_connections_and_collapse(table):
    rows = [message(1, 0, "start"), message(2, 1, "x"), message(3, 2, "done"), message(4, 3, "late"), message(5, 4, "start"), message(6, 5, "y")]
    got = Q.radio_connections(table(rows), F.col("label") == "start", F.col("label") == "done").orderBy("connection").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == [(1, 3), (5, 6)]
    pair = [dict(message(1, 0, "outer", detail={"a": "1", "b": "1"}), seq=0), dict(message(1, 0, "inner", failed=True, cause=("t", 3), detail={"a": "2"}), seq=1)]
    r = Q.collapse_frames(table(pair)).first()
    assert r.label == "outer + inner" and r.is_failure and r.cause.value == 3 and r.detail == {"a": "2", "b": "1"}


def test_callbacks_match_by_path_prefix(spark):
    requests = spark.createDataFrame([("cap", 1, "/cb/1/notify"), ("cap", 2, "/cb/1"), ("cap", 3, "/cb/12"), ("cap", 4, "/two/x")], "capture_id string, frame long, path string")
    registered = spark.createDataFrame([("cap", "/cb/1", "UDM"), ("cap", "/two", "A"), ("cap", "/two", "B")], "capture_id string, path string, producer string")
    assert {(r.frame, r.producer) for r in P.callback_match(requests, registered).collect()} == {(1, "UDM"), (2, "UDM")}


def test_media_closure(spark):
    start = spark.createDataFrame([("c1", "m1"), ("c2", "m9")], "call string, key string")
    links = spark.createDataFrame([("m1", "ctx"), ("ctx", "t1"), ("t1", "m2"), ("m8", "m7")], "a string, b string")
    got = C.closure(start, links).collect()
    assert {(r.call, r.key) for r in got} == {("c1", "m1"), ("c1", "ctx"), ("c1", "t1"), ("c1", "m2"), ("c2", "m9")}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(S.msisdn_of(lit("tel:+12025550123"))) == "+12025550123" and one(S.msisdn_of(lit("sip:alice@x"))) is None and one(S.msisdn_of(lit("sip:123@x"))) is None
    assert one(S.international_msisdn(lit("sip:+12025550123@x;user=phone"))) == "+12025550123" and one(S.international_msisdn(lit("tel:5550123"))) is None
    assert one(S.msisdn_from_tbcd(lit("2143f5"))) == "12345" and one(S.msisdn_from_enum_name(lit("3.2.1.0.5.5.5.2.0.2.1.e164.arpa"))) == "+12025550123"
    assert one(S.imsi_from_ims_identity(lit("sip:001010000000001@ims.mnc001.mcc001.3gppnetwork.org"))) == "001010000000001"
    assert one(S.supi_from_identifier(lit("imsi-001010000000001"))) == "001010000000001" and one(S.supi_from_identifier(lit("suci-0-001-01-0-0-0-0000000001"))) == "001010000000001" and one(S.supi_from_identifier(lit("suci-0-001-01-0-1-0-ff"))) is None
    assert [one(S.integer_of(lit(x))) for x in ("12", "0x1f", "00:10", "zz")] == [12, 31, 16, None]
    assert one(S.iso_micros(lit(0.0))) is None and one(S.iso_micros(lit(1.5))) == "1970-01-01T00:00:01.500000Z"
    assert one(S.connection_scope(lit("b"), lit("a"), lit(3))) == "a,b#3" and one(S.connection_scope(lit("b"), lit("a"), lit(None).cast("long"))) == "a,b"
    keys = F.array(*(F.struct(lit(k).alias("kind"), lit(v).alias("value")) for k, v in (("impi", "z"), ("supi", "2"), ("supi", "1"), ("sbi_stream", "0"))))
    assert one(S.subscriber_identity(keys)).value == "1" and one(S.sip_status(lit("486 Busy"))) == 486 and one(S.domain_of(lit("sip"))) == "IMS"
    assert one(S.query_parameters(lit("http://h/p?a=1&b=2&a=3"))) == {"a": "1", "b": "2"} and one(S.service_from_path(lit("/nudm-sdm/v2/x"))) == "nudm-sdm"


def test_privacy_keeps_shape_and_leaks_nothing(spark):
    texts = [(1, "mail ann.lee@example.com from 10.20.30.40 imsi-001010000000001 call +12025550123 id 123456789012345 end"), (2, None), (3, "no findings, 1.2.3")]
    df = spark.createDataFrame(texts, "id long, text string")
    found, out = PR.originals(df, "id", "text"), PR.scrub(df, "text", b"k")
    got = {r.id: r.text for r in out.collect()}
    assert len(got[1]) == len(texts[0][1]) and got[2] is None and got[3] == texts[2][1]
    assert {r.kind for r in found.collect()} == {"email", "ipv4", "imsi", "number", "digits"}
    for r in PR.leak_scan(found, df, out, "id", "text").collect():
        assert r.leaked == 0 and r.control == r.originals and not r.blind
    assert PR.pseudonym(b"k", "x", "aB3-") == PR.pseudonym(b"k", "x", "aB3-") != PR.pseudonym(b"j", "x", "aB3-")


def test_narrowing(spark):
    frames = spark.createDataFrame([("cap", 1, "tcp", 1, "x 123456 y"), ("cap", 2, "tcp", 1, "z"), ("cap", 3, "tcp", 2, "z")], "capture_id string, number long, transport string, stream long, text string")
    assert sorted(r.number for r in V.narrow(frames, F.col("text"), "123456").collect()) == [1, 2]
    assert V.narrow(frames, F.col("text"), "999999").count() == 3
    with pytest.raises(ValueError):
        V.narrow(frames, F.col("text"), "12a")


def test_stream_segments_equal_batch(spark, table, tmp_path):
    r = random.Random(4)
    labels = ["Registration request", "Registration accept", "Registration reject", "Service request", "Service accept", "x", "UEContextReleaseRequest", "UEContextReleaseComplete"]
    rows = [message(k, k * 0.4, (x := r.choice(labels)), flow=f"f{k % 3}", failed="reject" in x) for k in range(90)]
    batch = table(rows)
    # Each file holds rows that are earlier than some of the file before; the last one moves the watermark past all.
    files = [[] for _ in range(3)]
    for k in range(90):
        files[min(2, max(0, (k + r.randint(-12, 12)) // 30))].append(k)
    for n, held in enumerate(files):
        batch.where(F.col("frame").isin(held)).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    table([message(999, 90_000.0, "x", flow="end")]).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = live.segment_stream(stream).writeStream.format("memory").queryName("segments").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((x.frame, x.segment, x.kind) for x in spark.table("segments").collect() if x.segment)
    want = sorted((x.frame, x.segment, x.kind) for x in X.segment_procedures(batch).collect() if x.segment)
    assert got == want and len(want) > 50


def test_stream_windows_equal_batch(spark, table, tmp_path):
    rows = [message(k, k * 7, "x", failed=k % 3 == 0) for k in range(60)] + [message(99, 100_000, "end")]
    table(rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table(rows).schema).parquet(f"{tmp_path}/in")
    q = live.failure_rate(stream, "1 minute").writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    want = table(rows).groupBy(F.window("event_time", "1 minute").alias("w")).agg(F.count("*").alias("messages"), F.count_if("is_failure").alias("failures"))
    assert sorted(map(tuple, spark.table("rates").select("start", "messages", "failures").collect())) == sorted(map(tuple, want.select("w.start", "messages", "failures").collect()))


def test_links(spark, table):
    from callweave.operators import links as L

    rows = [message(1, 0, "AA Request", "diameter", detail={"session-id": "s1", "icid": "i"}), message(2, 1, "AA Answer", "diameter", detail={"session-id": "s1"}), message(3, 2, "AA Request", "diameter", detail={"session-id": "s2"})]
    calls = spark.createDataFrame([("cap", "call", "i", "f", "+123456789")], "capture_id string, call string, icid string, flow_id string, number string")
    assert sorted((r.frame, r.call) for r in L.charged_messages(table(rows), calls).collect()) == [(1, "call"), (2, "call")]
    people = spark.createDataFrame([("cap", "g", "+123456789", "s1"), ("cap", "f", None, "s2"), ("cap", "h", "+1", "s3")], "capture_id string, flow_id string, number string, subscriber string")
    assert sorted(r.subscriber for r in L.numbers_in_calls(calls, people).collect()) == ["s1", "s2"]
    members = spark.createDataFrame([("cap", 1, 0, "f", 1), ("cap", 2, 0, "f", 1)], "capture_id string, frame long, seq int, flow_id string, segment long")
    connections = spark.createDataFrame([("cap", 1, 0, 4), ("cap", 2, 0, 3)], "capture_id string, frame long, seq int, connection long")
    assert L.first_connection(members, connections).first().connection == 4
    verdicts = spark.createDataFrame([("joined",), ("joined",), ("refused",)], "verdict string")
    assert {tuple(r) for r in L.inferred_joins(verdicts).collect()} == {("joined", 2), ("refused", 1)}


def test_causal_chain(table):
    rows = [message(1, 0, "a", src="10.0.0.1", role="ran"), message(2, 1, "b", src="10.0.0.2"), message(3, 2, "c", src="10.0.0.3", failed=True), message(4, 3, "d", src="10.0.0.4", failed=True)]
    chain = Q.causal_chain(table(rows), ["capture_id", "flow_id"]).first().chain
    assert [(c.step, c.ip) for c in chain] == [("origin", "10.0.0.1"), ("sender", "10.0.0.2"), ("first failure", "10.0.0.3"), ("last failure", "10.0.0.4")]
