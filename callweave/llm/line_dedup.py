"""Removal of repeated runs of lines, by a suffix array over line-ID sequences.

Lines (split at \\n) that hold a word form each document's sequence of lines.
Prefix doubling in Spark rounds: round k holds every position whose run of 2**k
lines occurs more than once, with the dense rank of that run among all of them, in
the order of the suffix array. A round pairs the rank at a position with the rank
2**k lines further on, counts the pairs, ranks those that occur again by a range
sort of distinct pairs, and joins the ranks back. A position whose run occurs once
leaves, as no longer run from it can recur. Rounds end when no position is left, so
they reach the longest repeat of the table.

Positions with equal ranks form an interval of the suffix array whose longest common
prefix is at least that of their run; the interval for `run` lines gives each position its
first occurrence (by doc_id, text hash, line). Where the line before doesn't continue
the same pair of places, a maximal repeated run begins; its length, the longest common
prefix of the two suffixes, follows from the ranks of all rounds, highest first. The
later copy of each maximal run is deleted. The first copy of any line never is. With
`words` given, a single line of at least that many words is a run too.

DataFrame functions only. A line repeated in many documents meets in counts and
minima, and in joins against one row per interval, which adaptive execution can
split; nothing is broadcast but the sizes of the range partitions. Null texts have no
lines and stay null; lines without a word stay; of repeated rows the first counts as
the original and the others as later copies; documents with a null id come first. An
empty table gives an empty result. Extra columns are kept by `drop_repeats`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.functions.staging import staged

RUN = 2
_WORD = r"[^\x20\x09-\x0D]"
_DOC = ("doc_id", "text_hash")


def numbered(text: Column) -> Column:
    """array of (raw index i, line) of the lines that hold a word."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda s: s["line"].rlike(_WORD))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_hash(text: Column) -> Column:
    """The first 60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))


def lines_of(docs: DataFrame, words: int | None = None) -> DataFrame:
    """doc_id, text_hash, i (place among the lines with a word), a, b (the line's name), long (has `words` words): repeated rows once."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), "text")
    long = (lambda line: _words(line) >= words) if words else (lambda line: F.lit(False))
    names = F.transform(numbered(F.col("text")), lambda s: F.struct(F.xxhash64(s["line"]).alias("a"), F.hash(s["line"]).alias("b"), long(s["line"]).alias("long")))
    return held.select(*_DOC, F.posexplode(names).alias("i", "x")).select(*_DOC, F.col("i").cast("long").alias("i"), "x.a", "x.b", "x.long").distinct()


def _ranked(held: DataFrame, by: list[str]) -> DataFrame:
    """held -> its rows whose values of `by` occur again, with r, the dense rank of these values; `by` is dropped."""
    again = held.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    again = staged(again.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "again")
    # One row per partition: the only table that is ordered as a whole.
    before = again.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*by)) + F.col("before")
    ranks = again.join(F.broadcast(before), "part").select(*by, rank.alias("r"))
    return held.join(ranks.hint("merge"), by).drop(*by)


def rounds_of(lines: DataFrame) -> list[DataFrame]:
    """Per round k: doc_id, text_hash, i, r of every position whose run of 2**k lines occurs again."""
    now, out = staged(_ranked(lines, ["a", "b"]), "rank"), []
    while not now.isEmpty():
        out.append(now.select(*_DOC, "i", "r"))
        ahead = Window.partitionBy(*_DOC).orderBy("i").rangeBetween(1 << (len(out) - 1), 1 << (len(out) - 1))
        pairs = now.select(*_DOC, "i", "r", F.first("r").over(ahead).alias("next")).where("next is not null")
        now = staged(_ranked(staged(pairs.withColumnRenamed("r", "this"), "pairs"), ["this", "next"]), "rank")
    return out


def interval(rounds: list[DataFrame], run: int) -> DataFrame | None:
    """doc_id, text_hash, i, r: positions whose run of `run` lines occurs again; None if there are none."""
    k = run.bit_length() - 1
    if k >= len(rounds):
        return None
    if run == 1 << k:
        return rounds[k]
    ahead = Window.partitionBy(*_DOC).orderBy("i").rangeBetween(run - (1 << k), run - (1 << k))
    pairs = rounds[k].select(*_DOC, "i", F.col("r").alias("this"), F.first("r").over(ahead).alias("next")).where("next is not null")
    return staged(_ranked(staged(pairs, "pairs"), ["this", "next"]), "rank")


def _later(held: DataFrame) -> DataFrame:
    """doc_id, text_hash, i, origin (the interval's first place) of every position that isn't the first."""
    place = F.struct(*_DOC, "i")
    first = staged(held.groupBy("r").agg(F.min(place).alias("origin")), "origins")
    return held.join(first.hint("merge"), "r").where(place != F.col("origin")).select(*_DOC, "i", "origin")


def maximal_runs(rounds: list[DataFrame], run: int) -> DataFrame | None:
    """doc_id, text_hash, i, origin, n: later copies of maximal repeated runs of at least `run` lines, n lines long."""
    held = interval(rounds, run)
    if held is None:
        return None
    back = Window.partitionBy(*_DOC).orderBy("i").rangeBetween(-1, -1)
    later = _later(held).withColumn("left", F.first("origin").over(back))
    goes_on = F.coalesce((F.col("left.i") + 1 == F.col("origin.i")) & F.col("left.doc_id").eqNullSafe(F.col("origin.doc_id")) & (F.col("left.text_hash") == F.col("origin.text_hash")), F.lit(False))
    found = staged(later.where(~goes_on).select(*_DOC, "i", "origin", F.lit(0).cast("long").alias("n")), "starts")
    for k in reversed(range(len(rounds))):
        at = lambda side: rounds[k].select(F.col("doc_id").alias(f"{side}d"), F.col("text_hash").alias(f"{side}h"), F.col("i").alias(f"{side}i"), F.col("r").alias(f"{side}r"))  # noqa: B023, E731
        met = found.join(at("x"), F.col("doc_id").eqNullSafe(F.col("xd")) & (F.col("text_hash") == F.col("xh")) & (F.col("i") + F.col("n") == F.col("xi")), "left")
        met = met.join(at("y"), F.col("origin.doc_id").eqNullSafe(F.col("yd")) & (F.col("origin.text_hash") == F.col("yh")) & (F.col("origin.i") + F.col("n") == F.col("yi")), "left")
        found = staged(met.select(*_DOC, "i", "origin", F.when(F.col("xr") == F.col("yr"), F.col("n") + (1 << k)).otherwise(F.col("n")).alias("n")), "runs")
    return found


def later_copies(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """doc_id, text_hash, i, n: stretches of lines to delete, disjoint within a document."""
    lines = staged(lines_of(docs, words), "lines")
    rounds = rounds_of(lines)
    spans = [maximal_runs(rounds, run)]
    if words and rounds and run > 1:
        long = lines.where("long").select(*_DOC, "i")
        held = rounds[0].alias("r").join(long.alias("l"), F.expr("r.doc_id <=> l.doc_id and r.text_hash = l.text_hash and r.i = l.i"), "left_semi")
        spans.append(_later(held).withColumn("n", F.lit(1).cast("long")))
    found = [s.select(*_DOC, "i", "n") for s in spans if s is not None]
    if not found:
        return lines.where("false").select(*_DOC, "i", F.col("i").alias("n"))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    before = Window.partitionBy(*_DOC).orderBy("i", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest("i", F.coalesce(F.max(F.col("i") + F.col("n")).over(before), F.lit(0)))
    return every.withColumn("begin", begin).where("i + n > begin").select(*_DOC, F.col("begin").alias("i"), (F.col("i") + F.col("n") - F.col("begin")).alias("n"))


def drop_repeats(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """docs with later copies of repeated runs of at least `run` lines (or of a line of `words` words) deleted from text, and __lines, __removed."""
    known = lambda d, h: [F.coalesce(d, F.lit(0)).alias("d"), d.isNull().alias("no_id"), h.alias("h")]
    spans = later_copies(docs, run, words).groupBy(*_DOC).agg(F.collect_list(F.struct("i", "n")).alias("spans"))
    spans = staged(spans.select(*known(F.col("doc_id"), F.col("text_hash")), "spans"), "line_spans")
    held = docs.select(F.struct("*").alias("row"), *known(F.col("doc_id").cast("long"), text_hash(F.col("text"))))
    held = held.join(spans.hint("merge"), ["d", "no_id", "h"], "left")
    # The join has dealt and sorted by the same columns.
    held = held.withColumn("copy", F.row_number().over(Window.partitionBy("d", "no_id", "h").orderBy("d")))
    text = F.col("row.text")
    worded = F.transform(numbered(text), lambda s: s["i"])
    long = F.transform(F.filter(numbered(text), lambda s: _words(s["line"]) >= (words or 0)), lambda s: s["i"]) if words else F.array().cast("array<int>")
    inside = lambda w: F.transform(F.flatten(F.transform("spans", lambda s: F.sequence(s["i"], s["i"] + s["n"] - 1))), lambda k: F.get(w, k.cast("int")))
    first = F.when(F.col("spans").isNotNull(), _let(worded, inside)).otherwise(F.array().cast("array<int>"))
    again = F.when(F.size(worded) >= run, worded).otherwise(long)
    held = held.select("row", F.coalesce(F.size(worded), F.lit(0)).alias("lines"), F.when(text.isNull(), F.array().cast("array<int>")).when(F.col("copy") > 1, again).otherwise(first).alias("gone"))
    kept = _let(F.split(text, "\n", -1), lambda w: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), F.col("gone")), lambda k: F.get(w, k)), "\n"))
    whole = [F.when(F.size("gone") > 0, kept).otherwise(text).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return held.select(*whole, F.col("lines").alias("__lines"), F.size("gone").alias("__removed"))


ORACLE_SQL = r"""
with docs as materialized (
  select doc_id, text, substr(md5(coalesce(text, '')), 1, 15) as text_hash, row_number() over () as rid from documents
), raw as (
  select doc_id, text_hash, rid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from docs where text is not null
), worded as (
  select *, row_number() over (partition by rid order by i) as k from raw where regexp_matches(line, '[^\x20\x09-\x0D]')
), runs as (
  select doc_id, text_hash, rid, k, i, line, lead(line) over (partition by rid order by k) as line2, lead(i) over (partition by rid order by k) as i2 from worded
), ranked as (
  select *, row_number() over (partition by line, line2 order by doc_id nulls first, text_hash, rid, i) as place from runs where line2 is not null
), gone as (
  select rid, i from ranked where place > 1 union select rid, i2 from ranked where place > 1
), kept as (
  select raw.rid, string_agg(raw.line, chr(10) order by raw.i) as text from raw anti join gone on raw.rid = gone.rid and raw.i = gone.i group by raw.rid
)
select d.doc_id, coalesce(w.n, 0)::int as n_lines, coalesce(g.n, 0)::int as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from docs d
left join (select rid, count(*) n from worded group by 1) w on d.rid = w.rid
left join (select rid, count(*) n from gone group by 1) g on d.rid = g.rid
left join kept on d.rid = kept.rid
"""
