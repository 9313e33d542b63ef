import hashlib
import random
import zlib

import pytest

from callweave.llm import manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, at):
    """(whether the sibling stands before, sibling or None) per level."""
    for level in levels[:-1]:
        other = at ^ 1
        yield other < at, level[other] if other < len(level) else None
        at //= 2


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda lang: (lang is not None, (lang or "").encode()))
    held = {lang: sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for lang in order}
    trees = {lang: tree([leaf_of(r) for r in held[lang]]) for lang in order}
    top = tree([trees[lang][-1][0] for lang in order])
    for g, lang in enumerate(order):
        for k, r in enumerate(held[lang]):
            steps = [*climb(trees[lang], k), *climb(top, g)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            at = leaf_of((*r[:3], r[3] + 1, r[4])) if hit else leaf_of(r)
            for before, sib in steps:
                at = H(sib, at) if sib and before else H(at, sib or "")
            beside = [s for _, s in steps if s]
            yield r[0], leaf_of(r), trees[lang][-1][0], top[-1][0], H(*beside), at, len(beside), at == top[-1][0]


def rows_of(n, seed=1):
    r = random.Random(seed)
    return [(k, r.choice(["web", None, "böok"]), r.choices(["en", "de", None, "-", "", "日本"], [60, 20, 5, 3, 2, 1])[0], r.choice([k, None, 0]), r.choice(["", None, "text é\n", "x" * 200])) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33, 700])
def test_manifest(spark, n):
    rows = rows_of(n, n)
    if n == 700:
        rows += [(None, None, None, None, None)] * 40 + [(7, "web", "en", 5, "same")] * 90 + [(7, "web", "en", 2**63 - 1, "x" * 300_000)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS + ", leaf string, pos int")
    got = manifest.manifest(table)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "n_siblings", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)


def test_no_documents(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_the_order_of_the_table_does_not_matter(spark):
    rows = rows_of(100)
    assert len({manifest.manifest(spark.createDataFrame(x, DOCS)).first().root for x in (rows, rows[::-1])}) == 1
