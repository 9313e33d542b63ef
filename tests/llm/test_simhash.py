import random

import pytest
import xxhash
from pyspark.sql import functions as F

from callweave.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    ids = {}
    for k, (doc, _) in enumerate(rows):
        ids[find(k)] = min(ids.get(find(k), doc), doc)
    return sorted((doc, f"{prints[k]:016x}", ids[find(k)]) for k, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("most", [4096, 2])
def test_equals_brute_force(spark, most):
    r = random.Random(3)
    rows = []
    for k in range(40):
        words = [r.choice(["alpha", "beta", "Gamma", "é", "x"]) + str(r.randrange(50)) for _ in range(r.randint(0, 300))]
        rows.append((3 * k + 5, " ".join(words)))
        for c in range(r.randrange(4)):
            near = list(words)
            if near and c:
                near[r.randrange(len(near))] = "edit"
            rows.append((3 * k + 500 + 1000 * c, " ".join(near)))
    rows += [(9001, None), (9002, ""), (9003, "one two"), (9003, "one two"), (9004, "ONE\ttwo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted(tuple(x) for x in simhash.near_duplicates(docs, most=most).collect())
    assert got == brute(rows)


def test_chains_and_balls(spark):
    r = random.Random(5)
    codes = {0}
    for _ in range(150):
        x = r.choice(list(codes))
        for _ in range(r.randint(1, 5)):
            x ^= 1 << r.randrange(64)
        codes.add(x)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    for most in (4096, 12, 3):
        pairs = simhash.links(spark.createDataFrame(signed, "fp long"), most=most).collect()
        root = {c[0]: c[0] for c in signed}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in pairs:
            assert ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 4
            root[find(a)] = find(b)
        got = {}
        for c in root:
            got.setdefault(find(c), set()).add(c)
        want, todo = [], {c[0] for c in signed}
        while todo:
            group, queue = set(), [todo.pop()]
            while queue:
                x = queue.pop()
                group.add(x)
                near = {y for y in todo if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 4}
                todo -= near
                queue += near
            want.append(group)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_texts(spark):
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, base = [], []
    for k in range(250):
        w = [r.choice(vocabulary) for _ in range(r.choice([60, 150, 400]))]
        base.append((k, w))
        rows.append((1000 + 10 * k, " ".join(w)))
        for c in range(1, r.randrange(4)):
            near = list(w)
            for _ in range(r.randint(1, max(1, len(w) // 50))):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            rows.append((1000 + 10 * k + c, " ".join(near)))
    rows += [(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, "One  TWO"), (None, "one two"), (1000, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "id": F.lit(1), "row": F.lit("x")})
    assert simhash.jaccard("a b c d e f", "a b c d e g") == 1 / 3 and simhash.jaccard(None, "") == 1
    sets = [set(simhash.shingles(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in alike:
        root[max(find(i), find(j))] = min(find(i), find(j))
    got = {}
    for x in simhash.similar(docs).collect():
        got.setdefault(x.doc_id, set()).add(x.group_id)
    same = lambda i, j: got[rows[i][0]] & got[rows[j][0]]
    assert all(same(i, j) for i, j in alike) and len(alike) > 200
    assert all(find(i) == find(j) for i in range(len(rows)) for j in range(i) if same(i, j))
    kept = simhash.keep_first(docs).collect()
    assert len(kept) == len({g for s in got.values() for g in s}) and kept[0].fp == "clash"
    assert simhash.keep_first(docs.where("false")).count() == 0
