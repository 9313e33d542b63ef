"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. At most `bits` differing bits leave at least
8 - bits bytes equal at their positions, which is the guaranteed minimum of matches.
The inverted index is kept over 8 - bits positions at a time: a posting list holds the
fingerprints that agree in all of them. Pairs are formed inside a list only: their
shared positional bytes are tallied over all eight positions, pairs below the
minimum go, each pair counts only in the list of its first equal positions, and what
is left is verified by counting differing bits. A list gives a spanning forest of
its links, never its pairs.

Only different fingerprints are indexed, with the least doc_id of each. Lists are
counted first, and lists of one are dropped. A list of over `most` members is split
by its next byte position: `bits` differing bits over the positions left (no more of
them than bits) leave one that differs in at most one bit, so the list is split by
every such position with every one of its bits left out. Parts that are too long are
split again while that holds; what is then left has a bound of 2**18 members. Every
list, long or short, is read in the same way.

`similar` is for documents alike in their five-word shingles. The same fingerprints, index,
tally and count of bits link near copies first, and each link is verified by its shingles.
Texts alike at 0.8 differ in some ten of 64 bits or 77 of 512, so no number of equal bytes is
guaranteed that would reach them all: an inverted index over the shingles, with the places
that prefix filtering guarantees, gives the rest, verified exactly as well (near_text).

Null texts have no words; a fingerprint without words is zero and is linked
like others. Repeated rows get a row each. Rows with a null doc_id take part
and get the component's least non-null doc_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.staging import shuffle_partitions, staged
from callweave.llm import near_text
from callweave.llm.words import as_long
from callweave.operators.components import connected_components

SHINGLE = 4
BITS = 4
SEED = 42
#: Members of a list that are compared in one row; longer lists are split.
MOST = 4096
#: For `similar`: words of a shingle, similarity.
WORDS, ALIKE = 5, 0.8


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(words) - shingle + 1)


def majority(h: np.ndarray) -> np.ndarray:
    """A bit is set if it is in over half of the hashes, repeats included."""
    every = h.astype("<u8", copy=False)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 2048):
        counts += np.unpackbits(every[lo : lo + 2048].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return int(majority(shingles(text, shingle))[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), as_long(found)], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def linked(codes: np.ndarray, k: int, bits: int, first: int | None) -> np.ndarray:
    """Which codes (uint64) are linked to the k-th: bytes tallied, then bits counted. first: only pairs whose first equal bytes are these positions (as bits)."""
    apart = codes ^ codes[k]
    equal = apart.astype("<u8", copy=False).view(np.uint8).reshape(len(codes), 8) == 0
    tally = equal.sum(1)
    keep = tally >= 8 - bits
    if first is not None:
        begins = equal & (equal.cumsum(1) <= 8 - bits)
        keep &= np.packbits(begins, axis=1, bitorder="little")[:, 0] == first
    near = np.flatnonzero(keep)
    return near[np.bitwise_count(apart[near]) <= bits]


def _forest(members: np.ndarray, bits: int, first: int | None) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints."""
    left, out = np.ones(len(members), bool), []
    codes = members.view(np.uint64)
    for start in range(len(members)):
        queue = [start] * int(left[start])
        left[start] = False
        while queue:
            k = queue.pop()
            near = linked(codes, k, bits, first)
            near = near[left[near]]
            left[near] = False
            out += [(int(members[k]), int(members[j])) for j in near]
            queue += near.tolist()
    return out


def _forests(lists: DataFrame, bits: int, first: bool) -> DataFrame:
    """members, used -> a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {p for m, used in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for p in _forest(np.array(m.as_py(), np.int64), bits, used if first else None)}
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return lists.select("members", "used").mapInArrow(run, "a long, b long")


def _split(hot: DataFrame) -> DataFrame:
    """Postings -> theirs by every further position with one of its bits left out."""
    part = lambda p, j: F.struct((F.col("used").bitwiseOR(F.lit(1 << p))).cast("int").alias("used"), F.xxhash64("bytes", F.lit(8 * p + j), F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255 ^ 1 << j))).alias("bytes"))
    each = [F.when(F.col("used").bitwiseAND(F.lit(1 << p)) == 0, F.array(*(part(p, j) for j in range(8)))).otherwise(F.array().cast("array<struct<used:int,bytes:bigint>>")) for p in range(8)]
    return hot.select("fp", F.explode(F.concat(*each)).alias("x")).select("x.used", "x.bytes", "fp")


def links(distinct: DataFrame, bits: int = BITS, most: int = MOST) -> DataFrame:
    """a, b: links among different fingerprints fp that connect just what all links within `bits` bits connect."""
    sets = list(combinations(range(8), 8 - bits))
    masks = [sum(0xFF << 8 * p for p in c) for c in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    listed = F.explode(F.array(*(F.struct(F.lit(sum(1 << p for p in c)).alias("used"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for c, m in zip(sets, signed, strict=True))))
    # A fingerprint becomes many postings: deal them out first, or few tasks would hold them all.
    spread = distinct.select("fp").repartition(shuffle_partitions(distinct.sparkSession), "fp")
    posted = spread.select("fp", listed.alias("x")).select("x.used", "x.bytes", "fp")
    near, left = [], bits
    while True:
        lists = staged(posted.groupBy("used", "bytes").agg(F.count("*").alias("n")).where("n > 1"), "lists")
        whole = bits // left > 1  # no position is sure to differ in one bit at most: what is left is bounded
        # The lists grow with the input, so they are never broadcast.
        members = lambda some: posted.join(some.hint("merge"), ["used", "bytes"])  # noqa: B023, E731
        short = members(lists if whole else lists.where(F.col("n") <= most)).groupBy("used", "bytes").agg(F.collect_list("fp").alias("members"))
        near.append(_forests(short, bits, left == bits))
        if whole or lists.where(F.col("n") > most).isEmpty():
            break
        posted, left = _split(staged(members(lists.where(F.col("n") > most)), "hot")), left - 1
    every = near[0]
    for more in near[1:]:
        every = every.union(more)
    return staged(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def _named(found: DataFrame, bits: int, most: int) -> DataFrame:
    """fp, component_id, text_hash (of the component's first row) for every fingerprint of found."""
    distinct = staged(found.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")), "distinct")
    parts = staged(connected_components(links(distinct.select("fp"), bits, most), "a", "b"), "parts")
    rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    ids = staged(rooted.groupBy("root").agg(F.min("first").alias("first")), "ids")
    return staged(rooted.select("fp", "root").join(ids, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("text_hash"), "root"), "named")


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable over links)."""
    if bits % 2 or not 0 < bits < 8:
        raise ValueError("bits: 2, 4 or 6")
    found = staged(fingerprints(docs, shingle), "fingerprints")
    named = _named(found, bits, most).select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def jaccard(a: str | None, b: str | None, shingle: int = WORDS) -> float:
    """Similarity of the sets of shingles; 1 for two texts without words."""
    x, y = np.unique(shingles(a, shingle)), np.unique(shingles(b, shingle))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _groups(docs: DataFrame, alike: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, id); and per id the first row (doc_id, text_hash) of its group, as `first`."""
    found, groups = near_text.alike_groups(docs, WORDS, alike)
    rooted = found.join(groups.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = staged(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    return rooted, staged(firsts, "firsts")


def similar(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """doc_id, text_hash, group_id: the first doc_id of each row's group of texts alike in their five-word shingles."""
    rooted, firsts = _groups(docs, alike)
    return rooted.join(firsts.hint("merge"), "root").select("doc_id", "text_hash", F.col("first.doc_id").alias("group_id"))


def keep_first(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """The first row of each group of similar texts, by doc_id and text hash, with all its columns; of equal rows that with the least columns."""
    _, firsts = _groups(docs, alike)
    first = staged(firsts.select(F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("h")).distinct(), "kept")
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("hash"))
    held = held.join(first.hint("merge"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")))
    order = [F.col("row")[c] for c in sorted(docs.columns)]
    held = held.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "hash").orderBy(*order)))
    return held.where("nth = 1").select("row.*")
