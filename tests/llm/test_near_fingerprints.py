"""The pipeline's near-duplicates go through the SimHash index first; the join over shingles gives what lies further apart."""

import random
from fractions import Fraction

import numpy as np

from callweave.llm import near_text, simhash

DOCS = "doc_id long, text string"


def texts_of(r):
    """Long texts with near copies of one and two changed words, others at about 0.85, and one fingerprint of two texts."""
    vocabulary, out = [f"w{k}" for k in range(5000)], []
    for _ in range(40):
        words = [r.choice(vocabulary) for _ in range(500)]
        out.append(words)
        for changed in (1, 2, 8):
            near = list(words)
            for at in r.sample(range(500), changed):
                near[at] = r.choice(vocabulary)
            out.append(near)
    return [" ".join(t) for t in out] + ["", "a b"]


def components(names, linked):
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in names}


def test_fingerprints_link_what_is_within_four_bits(spark):
    texts = texts_of(random.Random(2))
    docs = spark.createDataFrame([*enumerate(texts), (900, texts[0])], DOCS)
    recurring = near_text.staged(near_text._recurring(near_text._hashed(docs, 5, 6), 8), "recurring")
    sets = near_text.staged(near_text._sets(recurring, Fraction(4, 5)), "sets")
    got = {x.id: x.fp for x in sets.collect()}
    want = {int(simhash.majority(np.unique(simhash.shingles(t, 5))).view(np.int64)[0]) for t in texts[:160]}
    assert set(got.values()) == want and len(got) == 160
    apart = lambda a, b: ((got[a] ^ got[b]) & 0xFFFFFFFFFFFFFFFF).bit_count()
    pairs = [(x.a, x.b) for x in near_text.by_fingerprint(sets).collect()]
    near = [(a, b) for a in got for b in got if a < b and apart(a, b) <= 4]
    assert all(apart(a, b) <= 4 for a, b in pairs)
    assert components(got, pairs) == components(got, near) and len(near) > 60
    # Two texts of one fingerprint are compared as well.
    same = sets.limit(2).drop("fp").crossJoin(spark.createDataFrame([(7,)], "fp long"))
    assert [(x.a, x.b) for x in near_text.by_fingerprint(near_text.staged(same, "same")).collect()] == [tuple(sorted(x.id for x in same.collect()))]


def test_the_join_gives_the_rest(spark, monkeypatch):
    texts = texts_of(random.Random(6))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    held = lambda: {x.doc_id for x in simhash.keep_first(docs).collect()}
    whole = held()
    assert whole == {*range(0, 160, 4), 160, 161}
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_text, "_with_pivots", lambda *_: none)
    monkeypatch.setattr(near_text, "_across", lambda *_: none)
    alone = held()
    assert whole < alone and len(alone) < 130
    monkeypatch.setattr(near_text, "by_fingerprint", lambda *_: none)
    assert held() == set(range(162))
