"""Token ids as packed binary matrices: best-fit-decreasing packing.

Each scan task tokenises its documents and packs them block by block, so no
text or id crosses a shuffle. Documents longer than a sequence are split
losslessly into full sequences and a rest. Pieces of a block are taken longest
first; a segment tree over sequences, holding the largest room below each node,
finds the open sequence with the least room that still fits: sequences are kept
at the place of their room, so the search is for the first place with an open
sequence at or after the wanted room.

Blocks follow the scan, so another file layout or split size gives other
sequences of the same pieces.

A sequence is a row of the id matrix (`capacity` little-endian uint32 ids, padded),
with the cumulative lengths of its segments; positions restart at each of them.

Null texts count as empty (a document's end id is always written); repeated
rows are packed each; an empty table gives an empty result; rows with a null id
keep it. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import tokens

CAPACITY = 1024
#: Tokens packed together in one task.
BLOCK = 4_000_000
SCHEMA = "doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, ids binary"


class RoomTree:
    """Counts of open sequences by room, in a segment tree; finds the least room that is at least as wanted."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += n
            k //= 2

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, wanted: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest fit, taken out."""
        k = wanted + self.size
        while not self.count[k]:
            while k & 1:
                k //= 2
            if not k:
                return None
            k += 1
            if k & (k - 1) == 0:  # past the right edge of a level
                return None
        while k < self.size:
            k *= 2
            if not self.count[k]:
                k += 1
        room = k - self.size
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences as lists of places in lengths; each at most capacity long."""
    out: list[list[int]] = []
    tree = RoomTree(capacity)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[k])
        if found is None:
            found = capacity, len(out)
            out.append([])
        room, at = found
        out[at].append(k)
        if room > lengths[k]:
            tree.put(room - lengths[k], at)
    return out


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str = tokens.TOKENIZER, ranks: str = tokens.RANKS, end_id: int = 0, pad_id: int = 0, block: int = BLOCK) -> DataFrame:
    """A row per sequence: documents and starts of its segments, cumulative lengths, position resets, ids."""

    def flush(pieces: list[tuple]) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], [], []]
        for members in best_fit([len(p[2]) // 4 for p in pieces], capacity):
            ends, ids = [0], b"".join(pieces[k][2] for k in members)
            for k in members:
                ends.append(ends[-1] + len(pieces[k][2]) // 4)
            values = ([pieces[k][0] for k in members], [pieces[k][1] for k in members], ends, ends[:-1], ends[-1], ids + pad_id.to_bytes(4, "little") * (capacity - ends[-1]))
            for column, x in zip(rows, values, strict=True):
                column.append(x)
        types = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_ids", "starts", "cu_seqlens", "position_resets", "n_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.coder(path, ranks).encode, end_id.to_bytes(4, "little")
        pieces, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for at in range(0, len(ids), 4 * capacity):
                    pieces.append((doc, at // 4, ids[at : at + 4 * capacity]))
                held += len(ids) // 4
                if held >= block:
                    yield flush(pieces)
                    pieces, held = [], 0
        if pieces:
            yield flush(pieces)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_matrix(found: DataFrame, path: str) -> None:
    """Parquet rows of one sequence each: the id matrix with its segment lengths and resets."""
    found.write.parquet(path)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_ids", "starts", "cu_seqlens", "n_tokens", F.size("doc_ids").alias("n_segments"), F.crc32("ids").alias("ids_crc32"))
