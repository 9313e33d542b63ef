"""Texts alike in their five-word shingles: SimHash over byte positions, then an exact join by prefix filtering.

Fingerprints bring most near copies together; as texts alike at 0.8 may lie further apart
than any number of equal bytes reaches, the join gives the rest, without limits on partners.

Two texts with n and m distinct shingles and a similarity of t or more share at least
t / (1 + t) * (n + m) of them. With all shingles in one order, rare ones first, the first
shingle that both have stands among the first n - ceil(t * n) + 1 of the longer text and
the first n - ceil(2t / (1 + t) * n) + 1 of the shorter. Only those places are indexed.

1. Shingles are hashed once, where texts are read, and dealt by bucket (the hash's
   leading bits) in packed form. A bucket's task counts them; only shingles that occur
   again go on, with their count. A shingle that fills a bucket's memory is hot: its
   entries are handed on at once, and hot ones stand last in the order.
2. Dealt by text, each gets its recurring shingles in order. Those that occur nowhere
   else stand before them, so most texts have no recurring one among their first
   places: they have no partner and are done.
3. The SimHash of each text that may have a partner goes into the inverted index over byte
   positions (simhash.links: bytes tallied, count filter, bits); what it links is compared
   exactly, and what is alike is joined. In the lists of shingles that then hold different
   groups, every member is compared with one of another group that each list chooses for
   itself. Groups of near copies fall together here, by a few pairs a member.
4. Lists that still hold different groups give all pairs across groups, after bounds by
   length, place and marks; long lists are dealt into blocks, and each pair of blocks
   meets. Each pair is verified. So every pair that is alike lies in one group, at any
   size.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.staging import shuffle_partitions, staged
from callweave.llm.words import mix
from callweave.operators.components import connected_components

#: Texts hashed at once; entries of a bucket held before hot shingles are looked for, and how many make one hot; members of a list that meet in one row; entries packed at once.
SLICE, HELD, HOT, BLOCK, PACK = 2048, 4_000_000, 65_536, 1024, 1_000_000
_DOCS = "doc_id long, text_hash long, ref long, id long, n int, fp long"
_ENTRY = np.dtype([("ref", "<i8"), ("token", "<i8"), ("df", "<i4")])
NEVER = np.int32(2**31 - 1)


def lengths(n: np.ndarray, alike: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """How many first places are asked for, and how many are indexed, of texts with n distinct shingles."""
    n = np.asarray(n, np.int64)
    both = 2 * alike / (1 + alike)
    least = lambda share: -(-n * share.numerator // share.denominator)
    return n - least(alike) + 1, n - least(both) + 1


def _hashed(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Rows of texts (kind 0: doc_id, text_hash, ref, id, n, fp: the SimHash of the distinct shingles) and of packed shingles (kind 1: bucket, tokens, places, ref of the slice)."""
    from callweave.llm.simhash import majority, shingles

    schema = "kind byte, bucket int, doc_id long, text_hash long, ref long, id long, n int, fp long, tokens binary, places binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                piece = batch.slice(lo, SLICE)
                base = (part << 40) + (nth << 16)
                nth += 1
                ids, sizes, prints, seen, sets, rows = [], [], [], set(), [], []
                for k, text in enumerate(piece.column(1).to_pylist()):
                    h = np.unique(shingles(text, words))
                    name = int((mix(h).sum() + np.uint64(len(h))).astype(np.int64)) if len(h) else 0
                    ids.append(name)
                    sizes.append(len(h))
                    prints.append(int(majority(h).view(np.int64)[0]))
                    if name not in seen and len(h):
                        seen.add(name)
                        sets.append(h)
                        rows.append(k)
                count = piece.num_rows
                yield _batch(names, [0] * count, [(base + k) % (1 << bits) for k in range(count)], piece.column(0), piece.column(2), [base + k for k in range(count)], ids, sizes, prints, [None] * count, [None] * count)
                if sets:
                    every, place = np.concatenate(sets), np.repeat(np.array(rows, np.uint16), [len(s) for s in sets])
                    bucket = (every >> np.uint64(64 - bits)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    every, place, bucket = every[order], place[order], bucket[order]
                    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                    ends = np.append(edges[1:], len(bucket))
                    low = (every & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                    held, count = [low[a:b].tobytes() for a, b in zip(edges, ends, strict=True)], len(edges)
                    where = [place[a:b].tobytes() for a, b in zip(edges, ends, strict=True)]
                    none = [None] * count
                    yield _batch(names, [1] * count, bucket[edges].tolist(), none, none, [base] * count, none, none, none, held, where)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return given.mapInArrow(run, schema)


_TYPES = (pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names)


class _Bucket:
    """Entries of one bucket; `out` gives what occurs again, as it becomes certain."""

    def __init__(self, held: int = HELD, hot: int = HOT):
        self.tokens, self.refs, self.size, self.most, self.hot_at = [], [], 0, held, hot
        self.hot = np.zeros(0, np.int64)

    def add(self, tokens: np.ndarray, refs: np.ndarray) -> np.ndarray:
        self.tokens.append(tokens)
        self.refs.append(refs)
        self.size += len(tokens)
        return self._hot() if self.size > self.most else np.zeros(0, _ENTRY)

    def _all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(self.tokens), np.concatenate(self.refs)

    def _hot(self) -> np.ndarray:
        """Entries of shingles that are hot now; the others stay."""
        tokens, refs = self._all()
        names, counts = np.unique(tokens, return_counts=True)
        self.hot = np.union1d(self.hot, names[counts >= self.hot_at])
        gone = np.isin(tokens, self.hot)
        self.tokens, self.refs = [tokens[~gone]], [refs[~gone]]
        self.size = len(self.tokens[0])
        self.most = max(self.most, 2 * self.size)
        return _entries(refs[gone], tokens[gone], NEVER)

    def out(self) -> np.ndarray:
        first = self._hot() if len(self.hot) else np.zeros(0, _ENTRY)
        tokens, refs = self._all()
        names, where, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        df = counts[where]
        return np.concatenate([first, _entries(refs[df > 1], tokens[df > 1], df[df > 1])])


def _entries(refs: np.ndarray, tokens: np.ndarray, df) -> np.ndarray:
    made = np.empty(len(refs), _ENTRY)
    made["ref"], made["token"], made["df"] = refs, tokens, df
    return made


def _recurring(hashed: DataFrame, shards: int) -> DataFrame:
    """Rows of texts as they are (kind 0), and of entries that occur again, packed by the shard of their text (kind 1)."""
    schema = f"kind byte, shard int, {_DOCS}, entries binary"
    types = (pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    names = ["kind", "shard", "doc_id", "text_hash", "ref", "id", "n", "fp", "entries"]

    def packed(entries: np.ndarray) -> pa.RecordBatch:
        shard = _shard(entries["ref"], shards)
        order = np.argsort(shard, kind="stable")
        entries, shard = entries[order], shard[order]
        edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
        ends = np.append(edges[1:], len(shard)) if len(shard) else edges
        none = [None] * len(edges)
        columns = [1] * len(edges), shard[edges].tolist(), none, none, none, none, none, none, [entries[a:b].tobytes() for a, b in zip(edges, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket, waiting = None, _Bucket(), []

        def sent(more: np.ndarray, last: bool = False) -> Iterator[pa.RecordBatch]:
            """Entries of many buckets go on together, or their packs would be small and many."""
            waiting.append(more)
            if last or sum(map(len, waiting)) >= PACK:
                yield packed(np.concatenate(waiting))
                waiting.clear()

        for batch in batches:
            kind = batch.column(0).to_numpy()
            rows = batch.filter(pa.array(kind == 0))
            if rows.num_rows:
                shard = _shard(rows.column(4).to_numpy(), shards).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shard), *rows.columns[2:8], pa.nulls(rows.num_rows, pa.binary())], names)
            packs = batch.filter(pa.array(kind == 1))
            for b, base, tokens, places in zip(packs.column(1).to_pylist(), packs.column(4).to_pylist(), packs.column(8).to_pylist(), packs.column(9).to_pylist(), strict=True):
                if b != at:
                    yield from sent(bucket.out())
                    at, bucket = b, _Bucket()
                wide = np.zeros((len(tokens) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(tokens, np.uint8).reshape(-1, 5)
                full = wide.view("<i8").ravel() | (b << 40)
                early = bucket.add(full, base + np.frombuffer(places, "<u2").astype(np.int64))
                if len(early):
                    yield from sent(early)
        yield from sent(bucket.out(), last=True)

    parts = shuffle_partitions(hashed.sparkSession)
    return hashed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def marks(tokens: np.ndarray) -> bytes:
    """512 bits, each the parity of how many tokens fall on it: two sets differ in at least as many tokens as their marks in bits."""
    odd = np.bincount((mix(tokens.astype(np.uint64)) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _shard(refs: np.ndarray, shards: int) -> np.ndarray:
    return (mix(refs.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _sets(recurring: DataFrame, alike: Fraction) -> DataFrame:
    """id, n, fp, tokens (recurring ones, in order), asked and indexed (how many of the first of them), marks: texts that may have a partner."""

    def made(docs: dict, entries: list[np.ndarray]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], [], []]
        if entries and docs:
            every = np.concatenate(entries)
            every = every[np.lexsort((every["token"], every["df"], every["ref"]))]
            edges = np.flatnonzero(np.append(True, every["ref"][1:] != every["ref"][:-1]))
            ends = np.append(edges[1:], len(every))
            for a, b in zip(edges.tolist(), ends.tolist(), strict=True):
                name, n, fp = docs[int(every["ref"][a])]
                alone = n - (b - a)
                asked, indexed = (int(x) for x in lengths(np.array(n), alike))
                if asked > alone:
                    for column, x in zip(out, (name, n, fp, every["token"][a:b], min(asked - alone, b - a), max(indexed - alone, 0), marks(every["token"][a:b])), strict=True):
                        column.append(x)
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["id", "n", "fp", "tokens", "asked", "indexed", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, entries = None, {}, []
        for batch in batches:
            for kind, shard, ref, name, n, fp, held in zip(*(batch.column(c).to_pylist() for c in (0, 1, 4, 5, 6, 7, 8)), strict=True):
                if shard != at:
                    yield made(docs, entries)
                    at, docs, entries = shard, {}, []
                if kind == 0:
                    docs[ref] = name, n, fp
                else:
                    entries.append(np.frombuffer(held, _ENTRY))
        yield made(docs, entries)

    parts = shuffle_partitions(recurring.sparkSession)
    dealt = recurring.repartition(parts, "shard").sortWithinPartitions("shard")
    every = dealt.mapInArrow(run, "id long, n int, fp long, tokens array<long>, asked int, indexed int, marks binary")
    # Equal sets have equal tokens, whichever copy they were taken from.
    return every.dropDuplicates(["id"])


def _postings(sets: DataFrame) -> DataFrame:
    """token, id, n, rest (how many shingles stand at its place and after), indexed."""
    first = F.slice("tokens", F.lit(1), F.col("asked"))
    each = sets.select("id", "n", "indexed", F.size("tokens").alias("r"), F.posexplode(first).alias("place", "token"))
    return each.select("token", "id", "n", (F.col("r") - F.col("place")).alias("rest"), (F.col("place") < F.col("indexed")).alias("indexed"))


def _verified(pairs: DataFrame, sets: DataFrame, alike: Fraction) -> DataFrame:
    """a, b: pairs of ids whose sets are alike. Shingles that don't recur are in no other set, so the recurring ones decide."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}"))
    held = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    shared = F.size(F.array_intersect("t_a", "t_b")).cast("long")
    return held.where(shared * (alike.numerator + alike.denominator) >= alike.numerator * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def by_fingerprint(sets: DataFrame) -> DataFrame:
    """a, b: ids that the index over byte positions links, to be compared; of equal fingerprints each with the least id."""
    from callweave.llm.simhash import links

    firsts = staged(sets.groupBy("fp").agg(F.min("id").alias("first")), "near-prints")
    equal = sets.select("id", "fp").join(firsts.hint("merge"), "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    side = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")).hint("merge")
    apart = links(firsts.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return equal.unionByName(apart)


def _bounded(met: DataFrame, alike: Fraction) -> DataFrame:
    """Pairs that length and place leave possible: a, n, rest_a, b, m, rest_b -> a, b."""
    p, q = alike.numerator, alike.denominator
    close = (F.col("n").cast("long") * q >= F.col("m").cast("long") * p) & (F.least("rest_a", "rest_b").cast("long") * (p + q) >= p * (F.col("n") + F.col("m")).cast("long"))
    return met.where(close).select("a", "b").distinct()


def _in_groups(posted: DataFrame, parts: DataFrame) -> DataFrame:
    """The lists that are asked for by one group and another, with the group of each member."""
    grouped = posted.join(parts.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    grouped = staged(grouped, "near-postings")
    mixed = grouped.groupBy("token").agg(F.count("*").alias("size"), F.max("indexed").alias("any"), (F.min("component") != F.max("component")).alias("mixed"))
    return grouped.join(mixed.where("mixed and any").select("token", "size").hint("merge"), "token")


def _with_pivots(grouped: DataFrame, alike: Fraction) -> DataFrame:
    """a, b: of each list every member with one of another group, which each list chooses by a hash of its own.

    A member is in many lists and so meets many of a large group, of which one is
    enough; what is left for all pairs across groups are groups that really differ.
    """
    chosen = grouped.groupBy("token").agg(F.min_by(F.struct("id", "n", "rest", "component"), F.xxhash64("token", "id")).alias("f"))
    met = grouped.join(chosen.hint("merge"), "token").where("component <> f.component")
    lesser = F.struct("n", "id") < F.struct("f.n", "f.id")
    this, that = F.struct("id", "n", "rest"), F.struct("f.id", "f.n", "f.rest")
    met = met.select(F.when(lesser, this).otherwise(that).alias("s"), F.when(lesser, that).otherwise(this).alias("l"))
    return _bounded(met.select(F.col("s.id").alias("a"), "s.n", F.col("s.rest").alias("rest_a"), F.col("l.id").alias("b"), F.col("l.n").alias("m"), F.col("l.rest").alias("rest_b")), alike)


def _across(grouped: DataFrame, sets: DataFrame, alike: Fraction, block: int) -> DataFrame:
    """a, b: pairs of different groups in one list that length, place and marks leave possible. Lists are dealt into blocks; each pair of blocks is one row."""
    known = sets.select("id", (F.col("n") - F.size("tokens")).alias("alone"), "marks")
    held = grouped.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).join(known.hint("merge"), "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    held = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.struct("n", "id", "rest", "indexed", "component", "own", "alone", "marks").alias("e"))
    lists = held.groupBy("token", "x", "y").agg(F.collect_list("e").alias("members"))
    p, q = alike.numerator, alike.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], []]
            for x, y, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = members.values
                n, name, rest, indexed, comp, own = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(6))
                alone = rows.field(6).to_numpy(zero_copy_only=False)
                bits = np.frombuffer(b"".join(rows.field(7).to_pylist()), np.uint64).reshape(-1, 8)
                order = np.lexsort((name, n))
                n, name, rest, indexed, comp, own, alone, bits = (c[order] for c in (n, name, rest, indexed, comp, own, alone, bits))
                n, rest, alone = n.astype(np.int64), rest.astype(np.int64), alone.astype(np.int64)
                for k in np.flatnonzero(indexed):
                    m = slice(k + 1, None)
                    good = (comp[m] != comp[k]) & (n[k] * q >= n[m] * p) & (np.minimum(rest[k], rest[m]) * (p + q) >= p * (n[k] + n[m]))
                    if x != y:
                        good &= own[m] != own[k]
                    # Shingles of their own, and those that the marks tell apart, can't be shared.
                    sums = n[k] + n[m][good]
                    apart = alone[k] + alone[m][good] + np.bitwise_count(bits[k] ^ bits[m][good]).sum(1, dtype=np.int64)
                    hits = name[m][good][(sums - apart) * (p + q) >= 2 * p * sums]
                    out[0].append(np.full(len(hits), name[k]))
                    out[1].append(hits)
            both = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in both], ["a", "b"])

    return lists.select("x", "y", "members").mapInArrow(run, "a long, b long").distinct()


def alike_groups(docs: DataFrame, words: int, alike: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, id of each row; id, root: the group of each id that is alike to another). Rows of one set share an id."""
    share = Fraction(alike).limit_denominator(1000)
    parts = shuffle_partitions(docs.sparkSession)
    bits = max(6, min(16, (8 * parts - 1).bit_length()))
    recurring = staged(_recurring(_hashed(docs, words, bits), 2 * parts), "near-recurring")
    found = recurring.where("kind = 0").select("doc_id", "text_hash", "id")
    sets = staged(_sets(recurring, share), "near-sets")
    posted = _postings(sets)
    links = staged(_verified(by_fingerprint(sets), sets, share), "near-first-links")
    first = staged(connected_components(links, "a", "b"), "near-first-groups")
    links = links.unionByName(staged(_verified(_with_pivots(_in_groups(posted, first), share), sets, share), "near-pivot-links"))
    second = staged(connected_components(links, "a", "b"), "near-second-groups")
    pairs = staged(_across(_in_groups(posted, second), sets, share, block), "near-pairs")
    more = _verified(pairs, sets, share)
    every = staged(connected_components(links.unionByName(more), "a", "b"), "near-groups")
    return found, every.select(F.col("node").alias("id"), F.col("component").alias("root"))
