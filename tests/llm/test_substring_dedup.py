import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from callweave.llm import substring_dedup as sd
from callweave.llm.words import names_of, words_of


def brute(rows, window):
    """(doc_id, text) -> (doc_id, n_words, n_removed, kept) by counting every window."""
    words = [words_of(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def texts(seed, n, alphabet, length):
    r = random.Random(seed)
    pool = [" ".join(r.choice(alphabet) for _ in range(r.randint(1, length))) for _ in range(n)]
    out = []
    for t in pool:
        if r.random() < 0.5:
            cut = r.choice(pool).split(" ")
            i = r.randrange(len(cut))
            t = t + " " + " ".join(cut[i : i + r.randint(1, 60)])
        out.append(t)
    return out


@pytest.mark.parametrize("window", [3, 7, 12, 35])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
def test_equals_brute_force(spark, window, alphabet):
    rows = list(enumerate(texts(window * 100 + len(alphabet), 60, alphabet, 90)))
    rows += [(100, None), (101, ""), (102, "  \t\n"), (103, "a " * 200), (104, "a b " * 100), (105, rows[0][1]), (None, rows[1][1]), (5, rows[5][1]), (6, "x " + rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in sd.remove_repeats(docs, window).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, window), key=str)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, context string, block long, start string")
    assert sd.remove_repeats(docs).count() == 0


@pytest.mark.parametrize("window", [6, 9, 20, 35, 50, 100])
def test_equal_windows_share_their_anchor(window):
    r = random.Random(window)
    for alphabet in ("ab", "abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"):
        core = [r.choice(alphabet).encode() for _ in range(window)]
        places = set()
        for _ in range(30):
            left, right = ([r.choice(alphabet).encode() for _ in range(r.randint(0, 60))] for _ in range(2))
            words = left + core + right
            anchor, first, last = sd.blocks_of(names_of(words), np.zeros(len(words), int), window)
            k = np.flatnonzero((first <= len(left)) & (last >= len(left)))
            places.add(int(anchor[k[0]]) - len(left))
        assert len(places) == 1


def test_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
