"""The leak scan tells what was left from pseudonyms that read like other originals."""

from callweave.operators import privacy as PR
from callweave.operators.permutation import Permuter

KEY = b"a key"


def test_nothing_is_its_own_pseudonym():
    p = Permuter(KEY)
    for tweak in "abcdefgh":
        for size in (2, 3, 10, 97, 1000):
            made = [p.index(tweak, k, size) for k in range(size)]
            assert sorted(made) == list(range(size)) and all(a != b for a, b in enumerate(made))


def test_pseudonyms_that_read_like_originals_are_no_leak(spark):
    """All addresses of a form are there, so every pseudonym is another original."""
    rows = [(10 * a + b, f"write {x}.{b} or call, {x}.{b}@mail.example.org") for a, x in enumerate("abcdefghijklmnopqrstuvwxyz") for b in range(10)]
    docs = spark.createDataFrame([(n, t.split(", ")[1]) for n, t in rows] + [(None, "é z.9@mail.example.org")], "id long, text string")
    found = PR.originals(docs, "id", "text").where("kind = 'email'")
    scan = lambda after, before=docs: tuple(PR.leak_scan(found, before, after, "id", "text").select("originals", "leaked", "control", "blind").first())
    kept = docs.where("id is not null")
    assert scan(PR.scrub(kept, "text", KEY), kept) == (260, 0, 260, False)
    # What is left is found: as it was, in a text whose length has changed, in one that the input lacks, and where the scrub saw no address.
    assert scan(docs) == (260, 260, 260, False)
    assert scan(docs.where("id < 5").selectExpr("id", "'x ' || text as text")) == (260, 5, 260, False)
    assert scan(docs.where("id < 5 or id is null").selectExpr("id + 1000 as id", "text")) == (260, 6, 260, False)
    free = spark.createDataFrame(rows, "id long, text string")
    assert scan(PR.scrub(free, "text", KEY), free) == (260, 260, 260, False)
