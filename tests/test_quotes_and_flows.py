"""Quotes against a replay in order; flows that grow by micro-batches against the batch result."""

import random

import pytest
from pyspark.sql import functions as F

from callweave import normalise
from callweave.operators import correlate, quotes
from callweave.operators.components import chain_ends
from callweave.schema import MESSAGES
from callweave.sources import readers
from callweave.streaming import flows
from tests.test_ordered_streams import message
from tests.test_rules import frame


def replayed(rows, people):
    """(frame, a, b) in order -> verdicts, and the final flow of each."""
    root, named = {}, {f: set(s) for f, s in people.items()}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for f, a, b in sorted(rows):
        x, y = find(a), find(b)
        one, two = named.get(x, set()), named.get(y, set())
        if x == y:
            out.append((f, a, b, "already joined"))
        elif one and two and len(one | two) > 1:
            out.append((f, a, b, "refused"))
        else:
            root[max(x, y)] = min(x, y)
            named[min(x, y)] = one | two
            out.append((f, a, b, "joined"))
    return [(*o, find(o[1]), find(o[2])) for o in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes_equal_a_replay_in_order(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(400), *(f"{g}-{k:02}" for k in r.sample(range(30), 2))) for g in range(6) for _ in range(45)]
    rows += [(k, "hub", f"leaf{r.randrange(90):02}") for k in range(130)] + [(300 + k, f"chain{k:02}", f"chain{k + 1:02}") for k in range(40)] + rows[:5] + [(7, "self", "self")]
    ends = sorted({e for x in rows for e in x[1:]})
    people = {e: r.choice([[], [], ["1"], ["1"], ["2"], ["1", "2"], None]) for e in ends}
    people["hub"] = ["1"]
    table = spark.createDataFrame([*rows, (5, None, "x"), (5, "x", None)], "frame long, a string, b string")
    named = spark.createDataFrame([(e, s) for e, s in people.items()] + [("elsewhere", ["9"])], "flow_id string, supis array<string>")
    got = quotes.apply_quotes(table, named)
    want = replayed(rows, {e: s or [] for e, s in people.items()})
    assert sorted(map(tuple, got.select("frame", "a", "b", "verdict", "a_flow", "b_flow").collect())) == sorted(want)
    assert len({x[3] for x in want}) == 3
    assert quotes.apply_quotes(table.where("false"), named).count() == 0


def test_totals_and_messages_after_quotes(spark):
    teid, other = ("gtp_teid", "9/1"), ("gtp_teid", "9/2")
    rows = [
        message(1, 1, keys=[("supi", "1"), ("amf_ue_ngap_id", "a")]), message(2, 2, keys=[teid]), message(3, 3, keys=[("amf_ue_ngap_id", "a")], quotes=[(*teid, "reported")]),
        message(4, 4, keys=[("supi", "2"), other]), message(5, 5, keys=[("amf_ue_ngap_id", "a")], quotes=[(*other, "forwarded"), ("gtp_teid", "unseen", "reported")]),
        message(6, 6, keys=[("amf_ue_ngap_id", "b")], quotes=[("supi", "2", "embedded")]), message(7, 7, quotes=[(*teid, "reported")]),
    ]
    flowed = correlate.correlate(spark.createDataFrame(rows, MESSAGES))
    after, verdicts = quotes.bridged(flowed)
    assert tuple(quotes.quote_totals(verdicts).first()) == (2, 1, 1)
    flow = {x.frame: x.flow_id for x in after.collect()}
    assert flow[1] == flow[2] == flow[3] == flow[5] != flow[4] == flow[6] and flow[7] is None and after.columns == flowed.columns
    assert tuple(quotes.quote_totals(verdicts.where("false")).first()) == (0, 0, 0)


def test_ends_of_chains(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, 7), (200, 201)]
    got = dict(map(tuple, chain_ends(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {**dict.fromkeys(range(20), 20), 100: 20, 200: 201}


def some_messages(r, n):
    kinds = ["supi", "amf_ue_ngap_id", "gtp_teid", "sbi_stream"]
    rows = []
    for k in range(n):
        pool = r.randrange(8)
        rows.append(message(k, k, r.choice("cd"), keys=[(r.choice(kinds), f"{pool}-{r.randrange(12)}") for _ in range(r.randint(0, 3))]))
    return rows


def test_flows_by_micro_batches_equal_the_batch(spark, tmp_path):
    r = random.Random(6)
    rows = some_messages(r, 70)
    table = flows.FlowTable(spark, f"{tmp_path}/flows", compact=3)
    order = list(range(70))
    r.shuffle(order)
    cuts = [order[k : k + 12] for k in range(0, 70, 12)]
    for n, part in enumerate(cuts):
        batch = spark.createDataFrame([rows[k] for k in part], MESSAGES)
        table.add(batch, n)
        if n in (1, 2):
            table.add(batch, n)  # run again after a failure
        if n in (1, 3, len(cuts) - 1):
            seen = spark.createDataFrame([rows[k] for p in cuts[: n + 1] for k in p], MESSAGES)
            shown = lambda df: sorted(map(tuple, df.select("capture_id", "frame", "flow_id").collect()), key=str)
            assert shown(table.flowed(seen)) == shown(correlate.correlate(seen))
    table.add(spark.createDataFrame([], MESSAGES), len(cuts))


def test_frames_of_growing_files_become_flows(spark, tmp_path):
    lines = [frame(k, {"pfcp": {"pfcp_pfcp_msg_type": "50", "pfcp_pfcp_seid": [hex(k % 4 + 1), "0x0"]}}) for k in range(12)]
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.ndjson").write_text("\n".join([*lines[k * 4 : k * 4 + 4], "{broken", ""]))
    messages = normalise.normalise(flows.stream_frames(spark, str(tmp_path / "in"), maxFilesPerTrigger="1"), ["pfcp"])
    table = flows.FlowTable(spark, f"{tmp_path}/flows")
    q = table.follow(messages, f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    whole = normalise.normalise(readers.read_frames(spark, str(tmp_path / "in" / "*.ndjson")), ["pfcp"])
    shown = lambda df: sorted((x.capture_id, x.frame, x.flow_id) for x in df.collect())
    got = shown(table.flowed(whole))
    assert got == shown(correlate.correlate(whole)) and len(got) == 12 and len({x[2] for x in got}) == 12
    assert table.components().where(F.col("node") == F.col("component")).count() > 0
