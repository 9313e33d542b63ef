import random

import numpy as np
from pyspark.sql import functions as F

from callweave.llm import toxicity

DOCS = "doc_id long, text string"


def test_lexicon_totals_cover_the_counted_rows(spark, monkeypatch):
    rows = [(k, f"filler{k % 50} insult") for k in range(400)] + [(k, "copied words") for k in range(400, 2000)] + [(k, f"clean{k} text") for k in range(2000, 3000)]
    marks = [(k, int(k < 1900)) for k in range(3000)] + [(k, 1) for k in range(90_000, 99_000)]
    seen = {}

    def held(counts, totals):
        seen.update(totals=totals, counts={r["feature"]: r.asDict() for r in counts.collect()})
        return toxicity.Lexicon([])

    monkeypatch.setattr(toxicity, "lexicon_of", held)
    toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int"))
    for f in toxicity.TRAINING:
        own = [k for k in range(3000) if toxicity.crc_fold(k) == f]
        assert (seen["totals"][f, 1], seen["totals"][f, 0]) == (sum(k < 1900 for k in own), sum(k >= 1900 for k in own))
        got = lambda word: (seen["counts"][word][f"t{f}"], seen["counts"][word][f"c{f}"])
        assert got("=copied") == (sum(400 <= k < 1900 for k in own), sum(1900 <= k < 2000 for k in own))
        assert got("=insult") == got("5=insul") == (sum(k < 400 for k in own), 0)


def test_lexicon_criterion_is_relative(spark):
    schema = "feature string, " + ", ".join(f"{n} long" for n in (*(f"c{f}" for f in toxicity.TRAINING), *(f"t{f}" for f in toxicity.TRAINING)))
    for scale in (1, 1000):
        rows = [("=sure", 0, 0, 0, 20 * scale, 20 * scale, 20 * scale), ("=even", 9 * scale, 9 * scale, 9 * scale, scale, scale, scale), ("=part", 0, 0, 0, 20 * scale, 0, 0)]
        totals = {(f, y): (400 if y else 3600) * scale for f in toxicity.TRAINING for y in (0, 1)}
        got = toxicity.lexicon_of(spark.createDataFrame(rows, schema), totals)
        assert dict(zip(got.names, got.folds)) == {"=sure": (0, 1, 2), "=part": (0,)}


def test_shouting_reads_the_whole_text():
    shouts = lambda text: toxicity.votes_of(text, [], toxicity.Lexicon([]), 0)[toxicity.VOTERS.index("shouting")]
    for n in (100, 2001, 3000, 3999, 4000, 8000):
        assert [shouts("A" * (n // 2 + k) + "a" * (n - n // 2 - k)) for k in (0, 1)] == [0, 1]
    assert shouts("aAAA" * 2000) == 1 and shouts("Aaaa" * 2000) == 0


def test_posteriors_beat_majority_vote():
    r = np.random.default_rng(3)
    for seed in range(5):
        y = r.random(3000) < 0.15
        votes = []
        for hit, false in ((0.8, 0.01), (0.5, 0.01), (0.3, 0.02)):
            votes.append(np.where(r.random(3000) < np.where(y, hit, false), 1, 0))
        votes += [votes[0].copy() for _ in range(2)]  # copies of one voter
        votes += [np.where(r.random(3000) < np.where(y, 0.5, 0.45), 1, -1) for _ in range(3)]  # nearly blind
        votes = np.stack(votes, 1)
        votes[r.random(votes.shape) < 0.1] = toxicity.MISSING
        post, model = toxicity.label_model(votes, toxicity.balance(y.astype(int)))
        assert ((post - y) ** 2).mean() < 0.5 * ((toxicity.majority(votes) - y) ** 2).mean()
        assert model["weight"][0] < 0.8 and model["correlation"][0, 3] > 0.7 and model["correlation"][1, 2] < 0.3
        assert model["accuracy"][0] > 0.85 > 0.7 > model["accuracy"][-1]


def test_edges(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice("alpha beta gamma delta") for _ in range(9)) + (" idiot worthless" if k % 5 == 0 else "")) for k in range(300)]
    rows += [(None, "you worthless idiot"), (7000, "fine words " * 200_000), (7001, ""), (7002, None), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"toxic": F.lit("clash"), "fold": F.lit(9), "score": F.lit(1)})
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(300)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(x.predicted == (x.doc_id is None or x.doc_id < 300 and x.doc_id % 5 == 0) for x in got)
    unlabelled = toxicity.scored(docs, toxicity.fit(docs, labels.where("false"))).collect()
    assert all(x.predicted == (x.doc_id is None or x.doc_id < 300 and x.doc_id % 5 == 0) for x in unlabelled)
    assert toxicity.scored(docs.where("false"), toxicity.fit(docs.where("false"), labels)).count() == 0
