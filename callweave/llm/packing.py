"""Harmonic packing of tokenised documents into fixed-length sequences.

A length L belongs to class i = floor(capacity / L): i pieces of the class fill
one sequence. Documents are cut so that pieces sit at the top of their class
(floor(capacity / i) tokens), which leaves almost no padding: first whole
sequences, then the largest such length that fits, until at most `fine` tokens
are left, which become the last piece. Each class is numbered over many
independent workers (salts); a small table of counts per class and worker tells
each where its sequences begin. The pieces beyond the last full sequence of
each class, fewer than i per class and so bounded for all inputs, are packed
first-fit decreasing. Pieces are dealt to workers by a hash of what they hold
and by their place in the scan, so a document that is repeated very often is
spread too; which sequence holds a piece therefore depends on the file layout.

Null texts count as empty. An empty table gives an empty result. Repeated rows
are packed as often as they occur. Extra columns are ignored by `pieces` and
kept by `pack`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.staging import shuffle_partitions, staged
from callweave.llm import tokens

CAPACITY = 1024
FINE = 64
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def cuts(n: int, capacity: int = CAPACITY, fine: int = FINE) -> list[int]:
    """Piece lengths for a document of n tokens."""
    out = [capacity] * (n // capacity)
    left = n % capacity
    while left > fine:
        piece = capacity // -(-capacity // left)
        out.append(piece)
        left -= piece
    return out + [left] * (left > 0)


def pieces(docs: DataFrame, capacity: int = CAPACITY, fine: int = FINE, path: str = tokens.TOKENIZER, ranks: str = tokens.RANKS, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids (little-endian uint32), doc_tokens: each document, its end id included, cut into pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.coder(path, ranks).encode, end_id.to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows: list[list] = [[], [], [], [], []]
                part = batch.slice(lo, 512)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids, at = encode(text or "") + end, 0
                    n = len(ids) // 4
                    for length in cuts(n, capacity, fine):
                        for column, x in zip(rows, (doc, at, length, ids[4 * at : 4 * (at + length)], n), strict=True):
                            column.append(x)
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _leftover(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "__order"], ascending=[False, True], kind="stable")
        room: list[int] = []
        at, slot = [], []
        used: list[int] = []
        for n in rows["length"]:
            k = next((k for k, r in enumerate(room) if r >= n), len(room))
            if k == len(room):
                room.append(capacity)
                used.append(0)
            room[k] -= n
            at.append(k)
            slot.append(used[k])
            used[k] += 1
        return rows.assign(__bin=at, __slot=slot)

    return pack


def pack(found: DataFrame, order: list[str], capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """Rows with a length (1 to capacity) -> the same with sequence_id, offset, sequence_tokens, padded_tokens.

    order: columns that tell rows apart; equal rows may change places. The
    input is staged. Class i is a column of the plan, so no task holds a class:
    rows are dealt by class and salt.
    """
    spark = found.sparkSession
    salts = salts or shuffle_partitions(spark)
    key = F.xxhash64(*order)
    rows = staged(
        found.withColumns({"__class": F.floor(F.lit(capacity) / F.col("length")).cast("int"), "__order": key, "__salt": F.pmod(key + F.monotonically_increasing_id() % 64, F.lit(salts)).cast("int")}), "pieces"
    )
    counts = rows.groupBy("__class", "__salt").agg(F.count("*").alias("__n"))
    by_class = Window.partitionBy("__class").orderBy("__salt")
    starts = counts.select(
        "__class",
        "__salt",
        (F.sum("__n").over(by_class) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy("__class")).alias("__total"),
    )
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__class", "__salt").orderBy("__order", *order)))
    ranked = ranked.join(starts, ["__class", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__rank") - 1)
    ranked = staged(
        ranked.withColumns({"__bin": F.floor(F.col("__rank") / F.col("__class")), "__slot": F.col("__rank") % F.col("__class"), "__full": F.col("__rank") < F.col("__total") - F.col("__total") % F.col("__class")}).drop("__before", "__total", "__rank", "__salt"),
        "ranked",
    )
    full = ranked.where("__full").drop("__full")
    rest = ranked.where("not __full").drop("__full")
    rest = rest.groupBy(F.lit(0).alias("__one")).applyInPandas(_leftover(capacity), rest.schema).withColumn("__class", F.lit(capacity + 1))
    packed = full.unionByName(rest).withColumn("sequence_id", F.shiftleft(F.col("__class").cast("long"), 48) + F.col("__bin"))
    inside = Window.partitionBy("sequence_id")
    total = F.sum("length").over(inside)
    return packed.withColumns(
        {
            "offset": F.sum("length").over(inside.orderBy("__slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length"),
            "sequence_tokens": total,
            "padded_tokens": F.when(total.bitwiseAND(total - 1) == 0, total).otherwise(F.lit(capacity).cast("long")),
        }
    ).drop("__class", "__bin", "__slot", "__order")


def write_sequences(packed: DataFrame, path: str) -> None:
    """One row per sequence: its ids in order of offset, and where each piece begins."""
    held = packed.groupBy("sequence_id", "padded_tokens").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    held.select("sequence_id", "padded_tokens", F.concat(F.lit(b""), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))).alias("ids"), F.col("p.offset").alias("offsets"), F.col("p.doc_id").alias("doc_ids")).write.parquet(path)


def harmonic(spark, docs: DataFrame) -> DataFrame:
    """The digest of packing all docs: a row per piece."""
    found = pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(found, ["doc_id", "start", "ids_crc32"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens")
