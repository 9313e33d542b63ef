import random

import numpy as np
from pyspark.sql import functions as F

from callweave.llm import secret_scan as ss

DOCS = "doc_id long, text string"


def words(r, n):
    return " ".join("".join(r.choice(["re", "tion", "an", "th", "lich", "ed", "que"]) for _ in range(r.randint(1, 8))) for _ in range(n))


def test_windows_cover_whole_candidates():
    r = random.Random(1)
    for n in (12, 39, 40, 41, 60, 61, 100, 1001):
        run = "".join(r.choices(ss._MIXED, k=n))
        text = "before it " + run + " and after"
        found = ss.windows_of(text, 10, 10 + n)
        inside = [w[ss.AROUND : ss.AROUND + ss.INSIDE].rstrip("\x01") for w in found]
        assert all(len(w) == ss.WIDTH for w in found) and inside[0] == run[: ss.INSIDE] and inside[-1] == run[ss.STEP * (len(found) - 1) :]
        assert len(found) == 1 or all(run[k : k + ss.STEP] in "|".join(inside) for k in range(n - ss.STEP))
    assert [c[:2] for c in ss.candidates("abcdefghijkl short " + "x" * 12 + "é" + "y" * 11, [])] == [(0, 12), (19, 31)]


def test_finds_what_the_patterns_miss(spark):
    r, rows, planted = random.Random(5), [], {}
    for k in range(400):
        text = words(r, 60) + r.choice(["", f" {r.randrange(10**15, 10**16)}", f" 10.{r.randrange(99)}.3.{r.randrange(99)}", " mail7.example.com"])
        if k % 2:
            kind = r.choice(sorted(set(ss.SHAPES) - {"hex", "access"}))
            key = ss.SHAPES[kind](r)
            if k % 8 == 1:  # the key stands far inside a long run
                key = "/".join(words(r, 25).split(" ")) + "/" + key
            planted[k] = (kind, key)
            text += " see " + key + " " + words(r, 20)
        rows.append((k, text))
    docs = spark.createDataFrame(rows, DOCS).withColumns({"start": F.lit("clash"), "windows": F.lit(1)})
    got = {x.doc_id: x for x in ss.scan(docs).collect()}
    hit = []
    for k, text in rows:
        added = [s for s in got[k].spans if s.kind == "cnn"]
        if k in planted:
            at = text.index(planted[k][1])
            base = any(s.start < at + len(planted[k][1]) and at < s.end for s in got[k].base)
            hit += [(planted[k][0], any(s.start <= at < s.end for s in added))] * (not base)
        else:
            assert not got[k].base
    wrong = sum(any(s.kind == "cnn" for s in got[k].spans) for k in range(0, 400, 2))
    assert np.mean([h for _, h in hit]) >= 0.9, hit
    assert np.mean([h for kind, h in hit if kind in ss.UNSEEN]) >= 0.8
    assert wrong <= 6


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "x" * 3), (3, "A9b+" * 100_000), (4, "token=" + "q" * 50_000), (4, "token=" + "q" * 50_000)]
    got = ss.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 6
    for x in got:
        if x.doc_id == 4:
            assert [(s.kind, s.start, s.end) for s in x.base] == [("assign", 0, 50_006)] and x.spans == x.base
        else:
            assert x.base == [] and all(s.kind == "cnn" and (s.start, s.end) == (0, 400_000) for s in x.spans)
    assert ss.scan(spark.createDataFrame([], DOCS)).count() == 0
