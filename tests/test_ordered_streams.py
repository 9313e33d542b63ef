"""Streams that need the order of time equal their batch rules, whatever order rows come in; state goes when it isn't needed."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from callweave.operators import correlate, pairing, sequences
from callweave.schema import MESSAGES
from callweave.streaming import live, ordered

at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, UTC)
END = ("1.1.1.1", None, None, None, None)


def message(frame, ts, capture="c", label="x", protocol="ngap", keys=(), releases=(), quotes=(), failed=False, detail=None):
    return (capture, frame, 0, float(ts), at(ts), protocol, label, END, END, list(keys), list(releases), list(quotes), None, failed, detail or {})


@pytest.fixture
def fed(spark, tmp_path):
    """Feeds rows in batches to a stream made by `of`, and gives back the result and how many rows its state holds at the end."""

    def run(batches, schema, of, name, partitions=2):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{k:03}")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
        q = of(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck-{name}").start()
        try:
            q.processAllAvailable()
            state = q.lastProgress.stateOperators
        finally:
            q.stop()
            spark.conf.set("spark.sql.shuffle.partitions", before)
        return spark.table(name).collect(), sum(s.numRowsTotal for s in state)

    return run


def scattered(rows, r, spread=20, size=9):
    """Rows in batches of `size`, each row at most about `spread` seconds late."""
    held = sorted(rows, key=lambda x: x[3] + r.uniform(0, spread))
    return [held[k : k + size] for k in range(0, len(held), size)]


def test_episodes(spark, fed):
    r = random.Random(3)
    pool = [("ran_ue_ngap_id", f"r{k}") for k in range(3)] + [("amf_ue_ngap_id", f"a{k}") for k in range(3)] + [("pfcp_seid", "p"), ("sip_call_id", "call"), ("gtpv2_transaction", "t"), ("supi", "1"), ("media_endpoint", "m=1")]
    rows = []
    for k in range(60):
        keys = r.sample(pool, r.randint(0, 3))
        rows.append(message(k, 4 * k + r.random(), r.choice("cd"), keys=keys, releases=[x for x in keys if r.random() < 0.2], detail={"n": str(k)}))
    want = correlate.assign_episodes(spark.createDataFrame(rows, MESSAGES))
    flush = [message(900, 90_000, "z")], [message(901, 90_001, "z")], [message(902, 200_000, "z")], [message(903, 200_001, "z")]
    got, left = fed([*scattered(rows, r), *flush], MESSAGES, ordered.episodes_stream, "episodes")
    shown = lambda x: (x.capture_id, x.frame, [(k.kind, k.value) for k in x["keys"]], x.ts, x.event_time, x.detail, x.src.ip)
    assert sorted(shown(x) for x in got if x.frame < 900) == sorted(map(shown, want.collect()))
    assert any("@" in k.value for x in got for k in x["keys"])
    assert left <= 2, "only what the last rows left behind"


def test_quotes(spark, fed):
    r = random.Random(4)
    schema = "capture_id string, kind string, value string, ts double, frame long, event_time timestamp, looks string, releases boolean, quote boolean"
    rows = []
    for k in range(150):
        ts = round(5 * k + r.random(), 3)
        q = r.random() < 0.4
        rows.append(("c", "k", r.choice("uv"), ts, k, at(ts), r.choice(["reported", "forwarded"]) if q else None, None if q else r.random() < 0.3, q))
    table = spark.createDataFrame(rows, schema)
    want = pairing.bind_quotes(table.where("quote"), table.where("not quote"), 30.0, 10.0)
    flush = [[("c", "k", "z", float(t), 900 + i, at(t), None, False, False)] for i, t in enumerate((90_000, 90_001, 200_000, 200_001))]
    got, left = fed([*scattered(rows, r), *flush], schema, lambda s: ordered.quotes_stream(s, 30.0, 10.0), "quotes")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    frames = {(x.frame, x.bound_frame) for x in got}
    assert any(b is None for _, b in frames) and any(b and b < f for f, b in frames) and any(b and b > f for f, b in frames)
    assert left <= 2


def test_quotes_of_messages(spark):
    rows = [message(1, 1, keys=[("gtp_teid", "t")], releases=[("gtp_teid", "t")]), message(2, 2, keys=[("supi", "1")], quotes=[("gtp_teid", "t", "forwarded")])]
    got = ordered.quote_rows(spark.createDataFrame(rows, MESSAGES)).select("kind", "value", "frame", "looks", "releases", "quote").collect()
    assert sorted(map(tuple, got), key=str) == [("gtp_teid", "t", 1, None, True, False), ("gtp_teid", "t", 2, "forwarded", None, True), ("supi", "1", 2, None, False, False)]


def test_timers(spark, fed):
    r = random.Random(5)
    schema = MESSAGES + ", flow_id string"
    rows, t = [], 0.0
    for k in range(120):
        t += r.choice([0.5, 5.5, 6.0, 6.5, 20.0])
        rows.append((*message(k, round(t, 3), label=r.choice(["Authentication request", "Registration accept + x", "Other"]), protocol=r.choice(["nas-5gs", "nas-5gs", "nas-eps"]), failed=r.random() < 0.5), r.choice(["f", "g", None])))
    want = sequences.timer_hints(spark.createDataFrame([x for x in rows if x[-1]], schema))
    last = [(*message(500, t + 1, label="Authentication request", protocol="nas-5gs"), "lone")]
    flush = [[(*message(900 + i, s, "z"), "z")] for i, s in enumerate((90_000, 90_001, 200_000, 200_001))]
    got, left = fed([*scattered(rows, r), last, *flush], schema, ordered.timers_stream, "timers")
    ended = [x for x in got if x.state == "ended"]
    assert sorted(tuple(x)[:6] for x in ended) == sorted(map(tuple, want.select("capture_id", "flow_id", "prev_frame", "frame", "gap", "timer").collect())) and ended
    gone = {x.prev_frame: (x.timer, x.frame) for x in got if x.state == "expired"}
    assert gone[500] == ("T3560", None)
    nxt = {}
    for flow in ("f", "g"):
        mine = [x for x in rows if x[-1] == flow]
        nxt |= {a[1]: b for a, b in zip(mine, mine[1:])}
    assert all(k not in nxt or nxt[k][3] - rows[k][3] > 6.9 for k in gone if k < 500), "a message that came in time cancels the alarm"
    assert left <= 3


def test_each_row_is_late_or_in_time(spark, fed, tmp_path):
    schema = "frame long, event_time timestamp, capture_id string, note string"
    batches = [[(1, at(0), "c", "a"), (2, at(500), "c", None)], [(3, at(490), "c", "é\n"), (4, at(300), "c", "late"), (5, None, "c", "no clock")], [(6, at(439), "d", "late by a second"), (7, at(441), "c", "just in time")]]
    got, _ = fed(batches, schema, ordered.marked_late, "late")
    assert {x.frame: x.late for x in got} == {1: False, 2: False, 3: False, 4: True, 5: False, 6: True, 7: False}
    assert {x.frame: (x.event_time and x.event_time.timestamp(), x.note) for x in got} == {x[0]: (x[1] and x[1].timestamp(), x[3]) for b in batches for x in b}
    counts = ordered.late_counts(spark.createDataFrame(got)).collect()
    assert sorted(map(tuple, counts)) == [("c", "late", 1), ("d", "late", 1)]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/late")
    q = live.write_with_late_rows(stream, f"{tmp_path}/out", f"{tmp_path}/behind", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    frames = lambda p: sorted(x.frame for x in spark.read.option("recursiveFileLookup", "true").parquet(p).collect())
    assert frames(f"{tmp_path}/out") == [1, 2, 3, 5, 7] and frames(f"{tmp_path}/behind") == [4, 6]
