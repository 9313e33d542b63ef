import os

import pytest

from callweave.plans import queries  # noqa: F401  registers all
from callweave.plans.registry import QUERIES
from callweave.plans.standins import messages

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_episodes_and_flows_cover_all_messages(spark):
    got = QUERIES["episodes_and_flows"](spark, DATA)
    key = ["capture_id", "frame"]
    assert sorted(map(tuple, got.select(key).collect()), key=str) == sorted(map(tuple, messages(spark, DATA).select(key).collect()), key=str)
