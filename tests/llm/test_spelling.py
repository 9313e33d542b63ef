import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from callweave.llm import spelling

DOCS = "doc_id long, text string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    count = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    form, beside = {}, {}
    for w in words:
        others = [x for x in words if near(w, x)]
        beside[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, words[w], beside[w], words[form[w]] if form[w] else None


def made_words(seed, n, letters="abé"):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(n)})


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyz"])
def test_the_index_finds_each_word_one_edit_apart_once(letters):
    words = made_words(2, 250, letters)
    if len(letters) > 5:
        r = random.Random(3)
        words = sorted({*words, *(w[:k] + r.choice(letters) + w[k + r.randint(0, 1) :] for w in words for k in [r.randint(0, len(w) - 1)])})
    queries = [*words, "zzzzz", "aaaaaaaaaaaaaaa"]
    got = [(q, words[w]) for from_end in (False, True) for q, w in spelling.near_in(words, queries, from_end)]
    assert len(got) == len(set(got))
    assert set(got) == {(q, w) for q in queries for w in words if near(q, w)}


def test_suffix_ranks():
    words = made_words(4, 60)
    index = spelling.Index(words)
    points = ("\0" + "\0".join(words) + "\0")[::-1]
    q, lo, hi = np.array([0]), np.array([0]), np.array([index.ends])
    for k, c in enumerate(words[5]):
        lo, hi = index.narrow(lo, hi, index.codes(words[5])[k : k + 1])
        assert hi[0] - lo[0] == points.count(("\0" + words[5][: k + 1])[::-1]), (q, c)


@pytest.mark.parametrize("shard", [40, 20_000])
def test_forms_and_roots(spark, shard):
    r = random.Random(7)
    base = [*made_words(8, 60), *made_words(9, 60, "abcdefgh"), "colour", "color", "colours", "École", "école", "ÀÉÎÕÜ"]
    base += [f"commonstart{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    pool = [w for w in base for _ in range(r.choice([1, 1, 2, 4, 9]))]
    docs = [(k, " ".join(r.choice(pool).upper() if r.random() < 0.1 else r.choice(pool) for _ in range(60))) for k in range(80)]
    docs += [(1, "Colour-colour2colour"), (1, "Colour-colour2colour"), (None, "colour " * 50), (5, None), (6, ""), (7, "12 34"), (8, "colour " * 30_000), (9, "q" * 100_000)]
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS + ", word string, n int")
    got = spelling.grouped(table, shard)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = sorted(plain(docs), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(w[2] != w[1] and w[1] for w in want), "no chain of two forms"


def test_no_words(spark):
    assert spelling.grouped(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.grouped(spark.createDataFrame([(1, None), (2, "a b")], DOCS)).count() == 0
