"""Exact removal of word windows that also start elsewhere, by recompression.

Rounds name, in every document alike, first runs of two equal words and then
pairs of neighbouring symbols: a bit of each symbol's name says whether it may
be the left or the right part of a pair. A name is a hash of what the symbol
stands for, so equal runs and pairs get the same name everywhere without a
dictionary, and the rounds themselves need no shuffle: they run inside the scan.
Runs are named two words at a time, as a longer run's name would depend on words
outside a window. Whether a symbol begins at a word depends only on the `reach` words
on either side of it, and no symbol is longer than `span` words; rounds go on
while every window of L words still holds at least one beginning that is decided
inside the window. Of those, the window's anchor is the one with the least hash
of the two high-level symbols that meet there (leftmost among equals): equal
windows have their anchor at the same place.

Anchors are few. Consecutive windows of one anchor form a block. Spark counts
the anchors' contexts; only contexts seen twice go on. Where all blocks of a
context are equal, or a block itself occurs twice, all its windows repeat.
What is left, blocks at the edges of repeats, is verified window by window
under 128-bit names, equal blocks once. A document's repeated starts are then
joined to its text. Copies of a hot passage only ever meet in counts and in
joins against one row per context, which adaptive execution can split.

Null texts have no words; rows with a null id are handled like others; repeated
rows are copies of each other. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.staging import staged
from callweave.llm.words import Windows, as_long, mix, names_of, words_of

WINDOW = 35
#: Words worked on at once in one task; a longer document is a block of its own, of up to 2**32 words.
BLOCK = 1 << 20
_U = np.uint64
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def rounds_for(window: int) -> tuple[int, int, int]:
    """Pair rounds, reach and span for a window; (-1, 0, 1): not even runs are named."""
    if 2 * 2 + 2 > window:
        return -1, 0, 1
    rounds, reach, span = 0, 2, 2
    while 2 * (reach + span) + 2 * span <= window:
        rounds, reach, span = rounds + 1, reach + span, 2 * span
    return rounds, reach, span


def beginnings(names: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where a symbol of the last round begins, and there a hash of the two symbols of the round before."""
    at, sym, seam = np.arange(len(names)), names, mix(names)
    if rounds < 0 or len(names) < 3:
        return at, seam
    same = sym[1:] == sym[:-1]
    alone = same.copy()
    alone[1:] &= ~same[:-1]
    alone[:-1] &= ~same[1:]
    for k in range(-1, rounds):
        if k < 0:
            joined = alone
        else:
            side = (mix(sym, k + 7) >> _U(33)) & _U(1)
            joined = (side[:-1] == 0) & (side[1:] == 1)
        first = np.ones(len(sym), bool)
        first[1:] = ~joined
        met = np.empty_like(sym)
        met[0], met[1:] = sym[0], mix(sym[1:], sym[:-1])
        seam = met[first]
        named = sym.copy()
        named[:-1][joined] = mix(sym[:-1][joined], mix(sym[1:][joined]))
        sym, at = named[first], at[first]
    return at, seam


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    step, out = 1, values
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return out if step == width else np.minimum(out[: len(values) - width + 1], out[width - step : width - step + len(values) - width + 1])


def blocks_of(names: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first and last window start of each block; doc: the document of each word."""
    n = len(names) - window + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    rounds, reach, _ = rounds_for(window)
    at, seam = beginnings(names, rounds)
    order = np.full(len(names), np.iinfo(_U).max, _U)
    order[at] = (seam & ~_U((1 << 32) - 1)) | at.astype(_U)
    best = _least(order[reach:], window - 2 * reach + (reach > 0))[:n]
    anchor = (best & _U((1 << 32) - 1)).astype(np.int64)
    start = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (doc[start[1:]] != doc[start[:-1]])
    head = np.flatnonzero(new)
    return anchor[head], start[head], start[np.append(head[1:], len(start)) - 1]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int):
    """Documents in groups of about BLOCK words: key columns' values, extra values, words, document of each word."""
    rows, words, count = [], [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = words_of(row[n_keys])
            rows.append((*row[:n_keys], *row[n_keys + 1 :], len(own)))
            words += own
            count += len(own)
            if count >= BLOCK or len(rows) >= 20_000:
                yield rows, words, np.repeat(np.arange(len(rows)), [r[-1] for r in rows])
                rows, words, count = [], [], 0
    if rows:
        yield rows, words, np.repeat(np.arange(len(rows)), [r[-1] for r in rows])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (64 bits), text: rows that agree in the first two are copies of each other."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def same_doc(a: str, b: str) -> Column:
    return F.expr(f"{a}.doc_id <=> {b}.doc_id and {a}.text_hash = {b}.text_hash")


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per block: context and block (names), doc_id, text_hash, start (first window), windows (how many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, reach, _ = rounds_for(window)
        for rows, words, doc in _groups(batches, 2):
            names = names_of(words)
            anchor, first, last = blocks_of(names, doc, window)
            base = np.searchsorted(doc, np.arange(len(rows)))
            own = doc[first] if len(first) else first
            context = Windows(names, _SECOND)(anchor - reach, anchor + max(reach, 1))
            block = Windows(names, _FIRST)(first, last + window)
            yield pa.RecordBatch.from_arrays(
                [as_long(context), as_long(block), pa.array([rows[k][0] for k in own], pa.int64()), pa.array([rows[k][1] for k in own], pa.int64()), pa.array((first - base[own]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
                ["context", "block", "doc_id", "text_hash", "start", "windows"],
            )

    return keyed(docs).mapInArrow(run, "context long, block long, doc_id long, text_hash long, start int, windows int")


def window_names(held: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, text, spans (of start, windows) -> a row per window start with its 128-bit name a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, _ in _groups(batches, 2):
            names, at, starts, own = names_of(words), 0, [], []
            for k, (_, _, spans, n) in enumerate(rows):
                for s in spans:
                    starts.append(np.arange(at + s["start"], at + s["start"] + s["windows"]))
                    own.append((k, at, s["windows"]))
                at += n
            start = np.concatenate(starts)
            reps = [w for _, _, w in own]
            ids, hashes = [rows[k][0] for k, _, _ in own], [rows[k][1] for k, _, _ in own]
            which = pa.array(np.repeat(np.arange(len(own)), reps))
            yield pa.RecordBatch.from_arrays(
                [as_long(Windows(names, b)(start, start + window)) for b in (_FIRST, _SECOND)]
                + [pa.array(ids, pa.int64()).take(which), pa.array(hashes, pa.int64()).take(which), pa.array((start - np.repeat([a for _, a, _ in own], reps)).astype(np.int32))],
                ["a", "b", "doc_id", "text_hash", "start"],
            )

    return held.mapInArrow(run, "a long, b long, doc_id long, text_hash long, start int")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, start, windows: runs of window starts whose word sequence also starts elsewhere."""
    found = staged(anchors(docs, window), "anchors")
    contexts = found.groupBy("context").agg(F.count("*").alias("n"), (F.min("block") != F.max("block")).alias("mixed"))
    contexts = staged(contexts.where("n > 1").select("context", "mixed"), "contexts")
    again = staged(found.join(contexts, "context"), "again")
    mixed = again.where("mixed")
    blocks = mixed.groupBy("context", "block").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "start", "windows")).alias("one"))
    blocks = staged(blocks, "blocks")
    spans = ["doc_id", "text_hash", "start", "windows"]
    whole = again.where("not mixed").select(spans).unionByName(mixed.join(blocks.where("n > 1").select("context", "block"), ["context", "block"]).select(spans))
    check = blocks.select("one.*").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    held = keyed(docs).alias("d").join(staged(check, "check").alias("c"), same_doc("d", "c")).select("d.doc_id", "d.text_hash", "d.text", "c.spans")
    names = staged(window_names(held, window), "windows")
    twice = staged(names.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "twice")
    single = names.join(twice, ["a", "b"], "left_semi").select("doc_id", "text_hash", "start", F.lit(1).alias("windows"))
    return whole.unionByName(single)


def spans_of_copies(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, spans (of start, windows): a row for all copies of a row, each span once however many there are."""
    return repeated_spans(docs, window).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "windows")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                out: list[list] = [[], [], [], []]
                for doc, text, spans in zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns), strict=True):
                    words = words_of(text)
                    edges = np.zeros(len(words) + 1, np.int64)
                    for s in spans or ():
                        edges[s["start"]] += 1
                        edges[s["start"] + s["windows"] - 1 + window] -= 1
                    gone = np.cumsum(edges[:-1]) > 0
                    kept = [w for w, g in zip(words, gone, strict=True) if not g] if spans else words
                    for column, x in zip(out, (doc, len(words), int(gone.sum()), b" ".join(kept)), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

    held = keyed(docs).alias("d").join(staged(spans_of_copies(docs, window), "spans").alias("s"), same_doc("d", "s"), "left").select("d.doc_id", "d.text", "s.spans")
    return held.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))
