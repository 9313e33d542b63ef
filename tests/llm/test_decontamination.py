import random

from callweave.llm import decontamination as dc


def distance(pattern, text):
    """Least edit distance of pattern to any run of text, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != w)))
        row, best = new, min(best, new[-1])
    return best


def test_myers_equals_the_table():
    r = random.Random(1)
    for _ in range(400):
        p = [r.choice("abc") for _ in range(r.randint(1, 90))]
        t = [r.choice("abc") for _ in range(r.randint(0, 120))]
        assert dc.best_match(p, t)[0] == distance(p, t)


def test_equals_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 50)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, items[0][1].upper())]
    docs = []
    for d in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        if d % 2:
            w = items[r.randrange(12)][1].split()
            for _ in range(r.randrange(1 + len(w) // 4)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(2)
            at = r.randrange(len(words) + 1)
            words[at:at] = w
        docs.append((d, " ".join(words)))
    docs += [(90, None), (91, ""), (3, docs[3][1])]
    want = []
    for d, t in docs:
        for i, b in items:
            p = dc.words_of(b)
            if p and (x := distance(p, dc.words_of(t))) <= dc.budget_of(len(p)):
                want.append((d, i, x))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 20
    for block in (dc.BLOCK, 200):
        got = sorted((x.doc_id, x.item_id, x.distance) for x in dc.matches(frame, bench, block=block).collect())
        assert got == sorted(want)
        bad = {d for d, _, _ in want}
        assert sorted(x.doc_id for x in dc.drop_contaminated(frame, bench, block=block).collect()) == sorted(d for d, _ in docs if d not in bad)
    assert dc.matches(frame, bench.where("false")).count() == 0
    assert dc.matches(frame.where("false"), bench).count() == 0


def test_a_text_of_hits_takes_time_in_proportion():
    import time

    took = []
    for n in (100_000, 400_000):
        began = time.process_time()
        assert dc.Matcher([([1], ["a"])], dc.BUDGET).find("a " * n)[0][:2] == (0, 0)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]
