import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callweave.llm import decontamination as dc
from callweave.llm import tokens

cp = pytest.importorskip("corpus_pipeline")


def words(text):
    return (text or "").encode().split()


def passes(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w) >= 50 and 100 * len(cover) <= 50 * len(w)


def without_later_runs(docs):
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: (d[0], xxhash.xxh64_intdigest((d[1] or "").encode(), 42))):
        lines = (text or "").split("\n")
        at = [i for i, line in enumerate(lines) if words(line)]
        gone = set()
        for a, b in zip(at, at[1:]):
            if (lines[a], lines[b]) in seen:
                gone |= {a, b}
            seen.add((lines[a], lines[b]))
        out.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def grams(text):
    w = words((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_per_group(docs):
    docs, sets, done, kept = sorted(docs), {}, set(), []
    for doc, text in docs:
        sets[doc] = grams(text)
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    for doc, text in docs:
        if doc in done:
            continue
        kept.append((doc, text))
        queue = [doc]
        while queue:
            x = queue.pop()
            done.add(x)
            queue += [y for y in sets if y not in done and alike(sets[x], sets[y])]
    return kept


def holds(item, text):
    p, t = dc.words_of(item), dc.words_of(text)
    return bool(p) and dc.best_match(p, t)[0] <= dc.budget_of(len(p))


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 15)))
    shared, items = [line() for _ in range(6)], [(k, " ".join(line() for _ in range(3))) for k in range(4)]
    docs = []
    for k in range(120):
        rows = [line() for _ in range(r.randint(2, 25))]
        if r.random() < 0.4:
            at = r.randrange(len(rows))
            rows[at:at] = shared[: r.randint(2, 6)]
        if r.random() < 0.15:
            leak = r.choice(items)[1].split(" ")
            leak[r.randrange(len(leak))] = "edited"
            rows.append(" ".join(leak))
        docs.append((k, "\n".join(rows)))
        if r.random() < 0.2:
            copy = [r.choice(vocabulary) for _ in range(600)]
            docs.append((1000 + k, " ".join(copy)))
            copy[r.randrange(len(copy))] = "changed"
            docs.append((2000 + k, " ".join(copy)))
    docs += [(5000, ""), (5001, "a b c " * 60), (5002, "x " * 400)]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, have = docs, frame
    for (_, stage), brute in zip(cp.STAGES, (lambda x: [d for d in x if passes(d[1])], without_later_runs, one_per_group, lambda x: [d for d in x if not any(holds(b, d[1]) for _, b in items)])):
        have, before = stage(spark, have, str(tmp_path)), want
        want = brute(want)
        assert have.columns == frame.columns
        got = {x.doc_id: x.text for x in have.collect()}
        assert got.keys() == dict(want).keys(), brute
        assert got == dict(want) and have.count() == len(want)
        assert want != before
    tokenizer = Tokenizer.from_file(tokens.TOKENIZER)
    got = cp.run(spark, str(tmp_path))
    sizes = {x.doc_id: (x.n, x.d) for x in got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()}
    assert sizes == {d: (n, n) for d, t in want for n in [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1]}
