"""Spelling variants: words one edit apart, found with bidirectional FM-index search schemes.

If two words are one edit apart, the edit lies in the one or in the other half of
either. So a word's left half is matched exactly from the word's start and its
right half with exactly one error, and the other way round from the word's end.
Both searches run on an FM-index of the delimited words, kept for both reading
directions: an interval of suffix ranks is narrowed by one symbol at a time.

Spark deals the index: a word goes to the shards of those of its starts and ends
that can be the exact half of a word one edit apart, at most four, and is searched
for in the two shards of its own halves. A shard holds SHARD entries in the mean
half of the time; starts and ends with more are dealt over shards of their own by
the indexed word, and searched in all of them. So memory is bounded and no pair is
lost. A pair that either search could find is reported by the first one alone.

Defined cases: null texts and texts without runs give no words; a null id counts as
an empty text in the hash. Repeated rows count again. Other columns are left out,
whatever their names. An empty table gives an empty result. Of words near with the
same count the least in code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.staging import staged
from callweave.llm.manifest import CRC, CRC_TABLE

LENGTH, OCCURRENCES, EVERY, FACTOR = 5, 3, 97, 2
#: Index entries of a shard at most, but for chance; distinct words that a counting task holds; words searched at once.
SHARD, HELD, BLOCK = 20_000, 300_000, 2048
_RUN = re.compile("[a-zÀ-ÿ]+")


def runs_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """Words of a document and how often they stand there, one code point deleted where the hash says so; short ones left out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
        if len(word) >= LENGTH:
            h = zlib.crc32(word.encode(), start)
            if h % EVERY == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < LENGTH:
                    continue
            yield word, n


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts summed within the task, handed on whenever HELD words are reached."""
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return made

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            t = text.as_py()
            if t:
                for word, n in runs_of(doc_id.as_py(), t):
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words with at least OCCURRENCES occurrences."""
    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


class Index:
    """FM-index of distinct words between delimiters, read in the words' direction: an interval is narrowed by the next letter.

    Suffixes are those of the reversed text. Delimiters are the least symbols,
    each less than the next, so sorting ends at a word's end. `keys` holds (symbol
    before a suffix, its rank) in order; the place of (c, i) among them is at once
    the first rank of c's suffixes and how many of them stand before i.
    """

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), "<u4")[::-1]
        self.alphabet = np.unique(points)
        symbols = np.searchsorted(self.alphabet, points).astype(np.int64)
        self.size, self.ends = len(points), len(words) + 1
        order = self._suffixes(symbols)
        before = symbols[order - 1]
        self.keys = np.sort(before * (self.size + 1) + np.arange(self.size))
        self.before = before
        # The number of the word that a suffix starts in, counted in the reversed text.
        self.owner = len(words) - 1 - (np.cumsum(symbols == 0)[order] - 1)

    def _suffixes(self, symbols: np.ndarray) -> np.ndarray:
        """Suffix ranks by prefix doubling."""
        ends = symbols == 0
        rank = np.where(ends, np.cumsum(ends) - 1, symbols + self.ends)
        step = 1
        while True:
            after = np.zeros(self.size, np.int64)
            after[:-step] = rank[step:] + 1
            both = rank * (self.size + len(self.alphabet) + self.ends + 2) + after
            order = np.argsort(both, kind="stable")
            held = both[order]
            new = np.empty(self.size, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]]))
            rank, step = new, 2 * step
            if rank[order[-1]] == self.size - 1 or step >= self.size:
                return order

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a text; len(alphabet) for what no word holds."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points
        return np.where(known, at, len(self.alphabet)).astype(np.int64)

    def narrow(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = symbol * (self.size + 1)
        return np.searchsorted(self.keys, row + lo), np.searchsorted(self.keys, row + hi)

    def following(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, letter) pairs that occur next; wide intervals are asked for every letter instead of being read."""
        width, letters = hi - lo, len(self.alphabet)
        thin = np.flatnonzero(width < letters)
        state = np.repeat(thin, width[thin])
        first = np.repeat(lo[thin], width[thin])
        nth = np.arange(len(state)) - np.repeat(np.cumsum(width[thin]) - width[thin], width[thin])
        pairs = np.unique(state * letters + self.before[first + nth])
        wide = np.flatnonzero(width >= letters)
        pairs = np.concatenate([pairs, (wide[:, None] * letters + np.arange(letters)).ravel()])
        pairs = pairs[pairs % letters > 0]
        return pairs // letters, pairs % letters

    def one_error(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word): exactly one edit apart, with the query's first `exact` code points alike. Each pair once."""
        length = np.array([len(q) for q in queries], np.int64)
        text = self.codes("".join(queries))
        offset = np.cumsum(length) - length
        letter = lambda q, j: text[offset[q] + j]
        # The exact half, from the delimiters' interval on.
        q, lo, hi, j = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.full(len(queries), self.ends), 0
        whole = []
        while len(q):
            done = exact[q] == j
            whole.append((q[done], lo[done], hi[done]))
            q, lo, hi = q[~done], lo[~done], hi[~done]
            lo, hi = self.narrow(lo, hi, letter(q, j))
            q, lo, hi, j = q[hi > lo], lo[hi > lo], hi[hi > lo], j + 1
        q, lo, hi = (np.concatenate(x) for x in zip(*whole, strict=True)) if whole else (q, lo, hi)
        j = exact[q]
        none = np.zeros(0, np.int64)
        wrong, found = (none, none, none, none), []
        while len(q) or len(wrong[0]):
            # States with their error behind them read on.
            wq, wl, wh, wj = wrong
            end = wj == length[wq]
            first, last = self.narrow(wl[end], wh[end], np.zeros(end.sum(), np.int64))
            there = last > first
            found.append((wq[end][there], self.owner[self.keys[first[there]]]))
            wq, wl, wh, wj = wq[~end], wl[~end], wh[~end], wj[~end]
            wl, wh = self.narrow(wl, wh, letter(wq, wj))
            live = wh > wl
            next_wrong = [(wq[live], wl[live], wh[live], wj[live] + 1)]
            # An error here: of a run of equal letters the last is deleted, and insertions stand behind the run.
            inside = j < length[q]
            want = np.where(inside, letter(q, np.minimum(j, length[q] - 1)), -1)
            last_one = j + 1 >= length[q]
            runs_on = ~last_one & (letter(q, np.minimum(j + 1, length[q] - 1)) == want)
            cut = inside & ~runs_on
            next_wrong.append((q[cut], lo[cut], hi[cut], j[cut] + 1))
            state, other = self.following(lo, hi)
            keep = other != want[state]
            state, other = state[keep], other[keep]
            nl, nh = self.narrow(lo[state], hi[state], other)
            live = nh > nl
            state, nl, nh = state[live], nl[live], nh[live]
            next_wrong.append((q[state], nl, nh, j[state]))
            same = inside[state]
            next_wrong.append((q[state][same], nl[same], nh[same], j[state][same] + 1))
            wrong = tuple(np.concatenate(x) for x in zip(*next_wrong, strict=True))
            # No error yet.
            q, lo, hi, j, want = q[inside], lo[inside], hi[inside], j[inside], want[inside]
            lo, hi = self.narrow(lo, hi, want)
            live = hi > lo
            q, lo, hi, j = q[live], lo[live], hi[live], j[live] + 1
        if not found:
            return none, none
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_in(words: list[str], queries: list[str], from_end: bool) -> Iterator[tuple[str, int]]:
    """(query, place of the word) one edit apart; from the end only pairs that the search from the start can't find."""
    turn = (lambda w: w[::-1]) if from_end else (lambda w: w)
    index = Index([turn(w) for w in words])
    for at in range(0, len(queries), BLOCK):
        block = queries[at : at + BLOCK]
        half = np.array([len(q) // 2 for q in block], np.int64)
        exact = np.array([len(q) for q in block], np.int64) - half if from_end else half
        for k, w in zip(*(x.tolist() for x in index.one_error([turn(q) for q in block], exact)), strict=True):
            if not from_end or words[w][: half[k]] != block[k][: half[k]]:
                yield block[k], w


def _searched(shard: pa.Table) -> pa.Table:
    """Rows of a shard (role: 0 indexed, 1 searched from the start, 2 from the end) -> word, near, near_n."""
    role = shard.column("role").to_numpy()
    word, n = shard.column("word").to_pylist(), shard.column("n").to_numpy()
    held = {w: int(n[k]) for k, w in enumerate(word) if role[k] == 0}
    words = list(held)
    out: tuple[list, list, list] = [], [], []
    for side in (1, 2):
        queries = [w for k, w in enumerate(word) if role[k] == side]
        if words and queries:
            for q, at in near_in(words, queries, side == 2):
                out[0].append(q), out[1].append(words[at]), out[2].append(held[words[at]])
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])


def _dealt(words: DataFrame, shard: int) -> DataFrame:
    """word, n, role, shard, salt: index entries and searches of all words."""
    m = F.length("word")
    start = lambda k: F.concat(F.lit("<"), F.substring(F.col("word"), F.lit(1), k))
    end = lambda k: F.concat(F.lit(">"), F.substring(F.col("word"), m - k + 1, k))
    half = lambda k: F.floor(k / 2).cast("int")
    spots = F.array_distinct(F.array(start(half(m - 1)), start(half(m)), start(half(m + 1)), end(half(m)), end(half(m + 1)), end(half(m + 2))))
    entry = lambda role: lambda key: F.struct(F.lit(role).alias("role"), F.xxhash64(key).alias("key"))
    all_ = F.concat(F.transform(spots, entry(0)), F.array(entry(1)(start(half(m))), entry(2)(end(half(m + 1)))))
    each = staged(words.select("word", "n", F.explode(all_).alias("e")).select("word", "n", "e.*"), "spelling-entries")
    sizes = each.where("role = 0").groupBy("key").agg(F.count("*").alias("size"))
    shards = max(1, -(-2 * each.where("role = 0").count() // shard))
    hot = sizes.where(F.col("size") > shard).select("key", F.ceil(F.col("size") * 2 / shard).cast("int").alias("salts"))  # total / shard rows at most
    held = each.join(hot, "key", "left")
    own = F.pmod(F.xxhash64("word"), F.col("salts")).cast("int")
    salt = F.when(F.col("salts").isNull(), F.array(F.lit(-1))).when(F.col("role") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    return held.select("word", "n", "role", F.when(F.col("salts").isNull(), F.pmod("key", F.lit(shards))).otherwise(F.col("key")).alias("shard"), F.explode(salt).alias("salt"))


def near_pairs(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, near, near_n: each ordered pair of words one edit apart, once. words: word, n."""
    return _dealt(words, shard).groupBy("shard", "salt").applyInArrow(_searched, "word string, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """word, form -> word, root: the end of each chain of forms, by pointer doubling."""
    now = staged(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = staged(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def grouped(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = staged(vocabulary(docs), "spelling-words")
    best = near_pairs(words, shard).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("b"))
    counts = F.col("n") * FACTOR <= -F.col("b.least")
    made = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(counts, F.col("b.near")).alias("form"), F.when(counts, -F.col("b.least")).alias("form_n"))
    made = staged(made, "spelling-forms")
    ends = roots(made.where("form is not null"))
    return made.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _sql() -> str:
    return f"""with recursive {CRC_TABLE},
    runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
    each as (select doc_id, run, count(*) as n, coalesce(doc_id::varchar, '') || ':' || run as s from runs where length(run) >= {LENGTH} group by doc_id, run),
    hashed as (select run, n, {CRC.format(s="s")} as h from each, crc_table),
    cut as (select case when h % {EVERY} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
    words as (select word, sum(n)::bigint as n from cut where length(word) >= {LENGTH} group by word having sum(n) >= {OCCURRENCES}),
    spots as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
    gaps as (select word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as swap, substr(word, 1, i - 1) || substr(word, i + 1) as less from spots),
    near as (select a.word, b.word as near, b.n as near_n from gaps a join gaps b on a.swap = b.swap and a.word <> b.word
      union select a.word, b.word, b.n from gaps a join words b on a.less = b.word
      union select b.word, a.word, a.n from gaps a join words b on a.less = b.word),
    best as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word),
    made as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= {FACTOR} * w.n then near end as form, case when near_n >= {FACTOR} * w.n then near_n end as form_n from words w left join best b on b.word = w.word),
    chain as (select word, word as at, form as next from made union all select c.word, c.next, m.form from chain c join made m on m.word = c.next)
    select m.word, m.form, c.at as root, m.n, m.n_near, m.form_n from made m join chain c on c.word = m.word where c.next is null"""


ORACLE_SQL = _sql()
