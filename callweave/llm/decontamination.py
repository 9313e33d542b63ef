r"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as sequences of lower-cased words (`\w+`). An item of m words
has an error budget of k = floor(budget * m) edits (insert, delete or replace a
word), at every length by the same formula. It is cut into k + 1 pieces: an occurrence with at most k edits leaves at
least one piece untouched, so looking for exact pieces misses nothing. All
pieces are found in one pass over a document by an Aho-Corasick automaton, and
around each hit Myers' bit-parallel algorithm gives the least edit distance of
the item to any run of the document's words.

The benchmark is a stated query set. It is cut into blocks of at most `block`
bytes of item text (checked: a block is collected and broadcast, never the whole
table at once beyond that), and all documents are scanned once per block: a
benchmark of 8 MB or less, as is usual, costs one scan, a larger one one more
for every 8 MB.

Null or empty texts hold no item; items without words match nothing; items with
the same words are matched as one and reported each. Repeated rows are reported
each.
Documents come through in whole, with all columns, in `drop_contaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 0.2
BLOCK = 8_000_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def pieces_of(words: list[str], k: int) -> list[tuple[int, list[str]]]:
    """k + 1 pieces of about equal length: (place, words)."""
    edges = [len(words) * j // (k + 1) for j in range(k + 2)]
    return [(a, words[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def budget_of(m: int, budget: float = BUDGET) -> int:
    return min(int(budget * m), m - 1)


def best_match(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance of pattern to any run of text, and where (exclusive end) it is first reached: Myers' algorithm."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, where = m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        across = ((((eq & up) + up) ^ up) | eq) & full
        eq |= down
        rise = (down | ~(across | up)) & full
        fall = up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up = (fall | ~(eq | rise)) & full
        down = rise & eq
        if score < best:
            best, where = score, j + 1
    return best, where


class Matcher:
    """The pieces of one block of items: (item ids, words)."""

    def __init__(self, items: list[tuple[list[int], list[str]]], budget: float):
        import ahocorasick

        self.items = [(ids, words, budget_of(len(words), budget)) for ids, words in items]
        self.machine = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for n, (_, words, k) in enumerate(self.items):
            for place, piece in pieces_of(words, k):
                held.setdefault(" " + " ".join(piece) + " ", []).append((n, place))
        for piece, uses in held.items():
            self.machine.add_word(piece, (len(piece), uses))
        if held:
            self.machine.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, distance, end word) of every item within its budget."""
        words = words_of(text)
        if not words or not len(self.machine):
            return []
        line = " " + " ".join(words) + " "
        seen: dict[int, list[int]] = {}
        counted, upto = 0, 0
        for end, (length, uses) in self.machine.iter(line):
            begin = end - length + 1
            counted += line.count(" ", upto, begin) if begin >= upto else -line.count(" ", begin, upto)
            upto = begin
            for n, place in uses:
                seen.setdefault(n, []).append(counted - place)
        out = []
        for n, starts in seen.items():
            _, pattern, k = self.items[n]
            best, where = k + 1, 0
            starts, next_ = sorted(set(starts)), 0
            while next_ < len(starts):
                lo = max(0, starts[next_] - k)
                hi = starts[next_] + len(pattern) + k
                while next_ < len(starts) and starts[next_] - k <= hi:  # overlapping stretches are read once
                    hi = max(hi, starts[next_] + len(pattern) + k)
                    next_ += 1
                got, at = best_match(pattern, words[lo:hi])
                if got < best:
                    best, where = got, lo + at
            if best <= k:
                out.append((n, best, where))
        return out


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple[list[int], list[str]]]]:
    held: dict[str, list[int]] = {}
    size = 0
    for row in items.select(F.col("item_id").cast("long"), "text").orderBy("item_id").toLocalIterator():
        words = words_of(row[1])
        if words:
            held.setdefault(" ".join(words), []).append(row[0])
            size += len(row[1])
        if size >= block:
            yield [(ids, w.split(" ")) for w, ids in held.items()]
            held, size = {}, 0
    if held:
        yield [(ids, w.split(" ")) for w, ids in held.items()]


def _scan(docs: DataFrame, items: list, budget: float, filtering: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    made: dict[int, Matcher] = {}
    at = docs.columns.index("text")

    def matcher() -> Matcher:
        if 0 not in made:
            made[0] = Matcher(shared.value, budget)
        return made[0]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, item, d, end) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, d, end in matcher().find(text) for item in matcher().items[n][0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["doc_id", "item_id", "distance", "end_word"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not matcher().find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    if filtering:
        return docs.mapInArrow(clean, docs.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(report, "doc_id long, item_id long, distance long, end_word long")


def matches(docs: DataFrame, items: DataFrame, budget: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance, end_word: every item that a document holds within the item's error budget."""
    out = None
    for part in _blocks(items, block):
        found = _scan(docs, part, budget, False)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance long, end_word long")


def drop_contaminated(docs: DataFrame, items: DataFrame, budget: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """docs without the rows that hold an item."""
    for part in _blocks(items, block):
        docs = _scan(docs, part, budget, True)
    return docs
