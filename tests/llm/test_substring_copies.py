"""Rows that repeat, with and without an id: all removed, and no list that grows with their number."""

import random

from callweave.llm import substring_dedup as sd


def test_spans_of_equal_rows_are_kept_once(spark):
    r = random.Random(5)
    copied, other, alone = (" ".join(f"w{r.randrange(10**6)}" for _ in range(100)) for _ in range(3))
    rows = [(None, copied)] * 400 + [(7, other)] * 50 + [(8, alone)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = {row.doc_id: row.spans for row in sd.spans_of_copies(docs).collect()}
    assert set(spans) == {None, 7}
    for held in spans.values():
        # At most a span per window start, not one per copy.
        assert len({(s.start, s.windows) for s in held}) == len(held) <= 66
    got = {}
    for row in sd.remove_repeats(docs).collect():
        got.setdefault((row.doc_id, row.n_words, row.n_removed, row.kept), []).append(1)
    assert {k: len(v) for k, v in got.items()} == {(None, 100, 100, ""): 400, (7, 100, 100, ""): 50, (8, 100, 0, alone): 1}
