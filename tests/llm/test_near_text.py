"""The exact join of similar texts against all pairs: templates, groups of copies, hot shingles, blocks."""

import random
from fractions import Fraction

import numpy as np
import pytest

from callweave.llm import near_text, simhash

DOCS = "doc_id long, text string"


def grouped(texts, alike):
    sets = [set(simhash.shingles(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= alike * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for k in range(len(texts)):
        out.setdefault(find(k), set()).add(k)
    return sorted(map(sorted, out.values()))


def templated(r):
    """Texts with most of their words from a shared template, pairs of them alike at 0.8 and more, and groups of copies."""
    vocabulary = [f"w{k}" for k in range(5000)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    template, short, texts = words(360), words(20), []
    for k in range(60):
        own = words(60)
        texts.append(template + own)
        if k % 3 == 0:
            texts.append(template + own[: r.randrange(48, 60)] + words(r.randrange(10)))
    for k in range(40):
        texts.append(words(r.randrange(1, 90)) + short + words(r.randrange(1, 90)))
    copy = words(120)
    for k in range(60):
        near = list(copy)
        for _ in range(k % 5):
            near[r.randrange(120)] = r.choice(vocabulary)
        texts.append(near)
    return [" ".join(t) for t in texts] + ["", "a b", "a b", "a b c d e", "a b c d e f"]


@pytest.mark.parametrize("block,held", [(1024, 4_000_000), (7, 500)])
def test_every_pair_that_is_alike_is_in_one_group(spark, monkeypatch, block, held):
    if held < 1000:
        monkeypatch.setattr(near_text._Bucket.__init__, "__defaults__", (held, 20))
    texts = templated(random.Random(block))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found, groups = near_text.alike_groups(docs, 5, 0.8, block)
    root = {r.id: r.root for r in groups.collect()}
    got = {}
    for r in found.collect():
        got.setdefault(root.get(r.id, r.id), set()).add(r.doc_id)
    want = grouped(texts, 0.8)
    assert sorted(map(sorted, got.values())) == want
    assert sum(len(g) == 2 for g in want) > 10 and max(map(len, want)) > 30


def test_places_that_are_asked_for():
    t = Fraction(4, 5)
    for n in range(1, 300):
        asked, indexed = (int(x) for x in near_text.lengths(np.array(n), t))
        assert 1 <= indexed <= asked <= n
        # A longer text of m shingles shares at least so many; the first shared one stands among these.
        for m in range(n, int(n / 0.8) + 1):
            least = -(-4 * (n + m) // 9)
            assert n - least + 1 <= indexed and m - least + 1 <= int(near_text.lengths(np.array(m), t)[0])


def test_hot_shingles_leave_a_bucket_early_and_whole():
    r = np.random.default_rng(1)
    bucket, out, given = near_text._Bucket(300, 40), [], []
    for k in range(40):
        tokens = np.concatenate([r.integers(0, 3, 30), r.integers(100, 2000, 30)])
        refs = k * 100 + np.arange(60)
        given += list(zip(refs.tolist(), tokens.tolist(), strict=True))
        out.append(bucket.add(tokens, refs))
        assert bucket.size <= 4 * bucket.most
    out.append(bucket.out())
    got = np.concatenate(out)
    count = {}
    for _, t in given:
        count[t] = count.get(t, 0) + 1
    assert sorted(zip(got["ref"].tolist(), got["token"].tolist(), strict=True)) == sorted(x for x in given if count[x[1]] > 1)
    for t in set(got["token"].tolist()):
        assert len(set(got["df"][got["token"] == t].tolist())) == 1, "one place in the order for all entries"


def test_nothing_to_join(spark):
    for rows in ([], [(1, None)], [(1, "only one text here with words")]):
        found, groups = near_text.alike_groups(spark.createDataFrame(rows, DOCS), 5, 0.8)
        assert found.count() == len(rows) and groups.count() == 0
