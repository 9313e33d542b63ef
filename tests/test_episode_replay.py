"""Key episodes are replayed once, whatever reads them."""

import pytest

from callweave.operators import correlate
from callweave.schema import MESSAGES
from tests.test_ordered_streams import message


@pytest.fixture
def replayed(spark, monkeypatch, tmp_path):
    """A folder with a file for each component that a replay began."""
    plain = correlate.Episodes
    folder = str(tmp_path)

    class Counted(plain):
        def step(self, keys, releases):
            with open(f"{folder}/steps", "a") as f:
                f.write("x")
            return super().step(keys, releases)

    monkeypatch.setattr(correlate, "Episodes", Counted)
    return tmp_path


def test_flows_of_episodes_replay_each_message_once(spark, replayed):
    a, b, supi = ("amf_ue_ngap_id", "7"), ("pfcp_seid", "9"), ("supi", "1")
    rows = [message(1, 1, keys=[a, supi]), message(2, 2, keys=[a, b]), message(3, 3, keys=[a], releases=[a]), message(4, 4, keys=[b]), message(5, 5, keys=[a]), message(6, 6)]
    got = {r.frame: ([k.value for k in r["keys"]], r.flow_id) for r in correlate.correlate(correlate.assign_episodes(spark.createDataFrame(rows, MESSAGES))).collect()}
    assert {f: k for f, (k, _) in got.items()} == {1: ["7", "1"], 2: ["7", "9"], 3: ["7"], 4: ["9@2"], 5: ["7@2"], 6: []}
    assert got[1][1] == got[2][1] == got[3][1] and len({got[f][1] for f in (1, 4, 5)}) == 3 and got[6][1] is None
    assert len((replayed / "steps").read_text()) == 5
