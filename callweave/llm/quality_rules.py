r"""Quality rules with risk-controlled cutoffs.

Base measures follow from whole texts: words `[^\x20\x09-\x0D]+`, characters in
words, symbols, repeated lines, words in three-word windows that occur twice.
Five rates made of them are rules of the form "reject above a cutoff".

Cutoffs are chosen per stratum (language, others together) on labelled
documents. `risk` bounds the share of a stratum's good documents that all rules
together may reject; each rule gets an equal part of it. For each rule and cutoff
of a grid, the null hypothesis is that more than that part of the good documents
would be rejected; its exact binomial p-value is P(Bin(n, part) <= rejected). All
strata, rules and cutoffs are tested together (Bonferroni), so with probability
1 - `error` no chosen rule rejects more than its part anywhere, and hence the
union of the rules, which is what a user sees, no more than `risk`. The lowest
certified cutoff is taken; with too few labelled documents none is, and the rule
stays off in that stratum. The p-value has one form at every size: the largest
term by the saddle-point expansion of the binomial, times a falling sum that is
cut where what is left is below e**-50 of it.

DataFrame functions only; a document is one row throughout, so no shuffle
carries texts. The grid's counts are a few rows (strata x rules x cutoffs),
bounded by the parameters, and come to the driver to become literals.

Null texts are empty; a null or unknown language is the stratum "other";
repeated rows are judged alike, and count as one trial, as equal texts do; labels without a document, or null, count
nothing; without labels only the base rule rejects. Extra columns are kept by
`judge`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.staging import staged

STRATA = ("en", "fr", "de", "es")
RISK = 0.02
ERROR = 0.05
#: rule -> grid of cutoffs, lowest first
GRID = {
    "symbol_rate": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3),
    "shout_rate": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "mark_rate": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
    "dup_line_rate": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "repeat_rate": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
}
_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more."""

    def counted(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twin = lambda z: F.filter(
            F.transform(z, lambda s, k: F.when((F.get(z, k - 1)["h"] == s["h"]) | (F.get(z, k + 1)["h"] == s["h"]), s["i"])), lambda i: i.isNotNull()
        )
        cover = lambda p: F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), _let(F.sort_array(_let(placed, twin)), cover)).otherwise(F.lit(0).cast("long"))

    grams = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return _let(_let(words, grams), counted)


def measures(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and of n_lines, n_upper, n_marks for the rules."""
    long = lambda c: c.cast("long")
    without = lambda t, chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, _SPACE, -1), lambda w: w != "")
        counts = _let(words, lambda w: F.struct(long(F.size(w)).alias("n"), _repeat_words(w).alias("r")))
        held = _let(lines(t), lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        return _let(
            F.struct(counts.alias("w"), held.alias("l")),
            lambda s: F.struct(
                s["w"]["n"].alias("n_words"),
                long(F.length(F.translate(t, " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
                long(without(t, "#*$%&|<>")).alias("n_symbols"),
                s["l"]["dup"].alias("n_dup_lines"),
                s["w"]["r"].alias("n_repeat_words"),
                s["l"]["n"].alias("n_lines"),
                long(without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
                long(without(t, "!?")).alias("n_marks"),
            ),
        )

    return _let(F.coalesce(text, F.lit("")), of)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def rates(m: Column) -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(m[a].cast("double"), m[b].cast("double")), F.lit(0.0))
    return {
        "symbol_rate": share("n_symbols", "word_chars"),
        "shout_rate": share("n_upper", "word_chars"),
        "mark_rate": share("n_marks", "word_chars"),
        "dup_line_rate": share("n_dup_lines", "n_lines"),
        "repeat_rate": share("n_repeat_words", "n_words"),
    }


def stratum(lang: Column, strata: tuple[str, ...] = STRATA) -> Column:
    return F.when(lang.isin(*strata), lang).otherwise("other")


def _excess(x: Column) -> Column:
    """ln x! less Stirling's formula: tabled up to 15, then its series."""
    table = F.array(*(F.lit(math.lgamma(k + 1) - ((k + 0.5) * math.log(k) - k + 0.5 * math.log(2 * math.pi)) if k else 0.0) for k in range(16)))
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - F.lit(1 / 1188) / (x * x)) / (x * x)) / (x * x)) / (x * x)) / x
    return F.when(x < 16, F.get(table, x.cast("int"))).otherwise(series)


def p_value(n: Column, k: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), to double precision; 1 where k >= n * risk."""
    n, k = n.cast("double"), k.cast("double")
    away = lambda x, mean: F.when(x > 0, x * F.ln(x / mean)).otherwise(0.0) + mean - x
    log = _excess(n) - _excess(k) - _excess(n - k) - away(k, n * risk) - away(n - k, n * (1 - risk)) + 0.5 * F.ln(n / (2 * math.pi * k * (n - k)))
    log = F.when(k == 0, n * F.log1p(F.lit(-risk))).otherwise(log)
    # Below the mean, terms d places down are under exp(-d * d / 2k) of the largest.
    last = F.least(k, F.ceil(10 * F.sqrt(k)) + 10).cast("long")
    step = lambda a, i: F.struct((a["term"] * (k - i + 1) / (n - k + i) * ((1 - risk) / risk)).alias("term"), (a["sum"] + a["term"] * (k - i + 1) / (n - k + i) * ((1 - risk) / risk)).alias("sum"))
    falling = F.aggregate(F.when(last > 0, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<long>")), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step)["sum"]
    return F.when(k >= n * risk, F.lit(1.0)).otherwise(F.exp(log) * falling)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> the lowest certified cutoff. measured: doc_id, stratum, m, text_hash.

    The exact bound holds for independent trials, so copies don't count: a labelled
    doc_id is one trial, by the least of its texts' hashes, and so are equal texts.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = measured.select("doc_id", "stratum", "m", "text_hash").join(good, "doc_id", "left_semi").where(~base_failed(F.col("m")))
    once = held.groupBy("doc_id").agg(F.min(F.struct("text_hash", "stratum", "m")).alias("x")).select("x.*")
    held = once.groupBy("text_hash").agg(F.min(F.struct("stratum", "m")).alias("x")).select("x.*")
    found = rates(F.col("m"))
    tests = [(rule, c) for rule, grid in GRID.items() for c in grid]
    sums = [F.count_if(found[rule] > c).alias(f"k{i}") for i, (rule, c) in enumerate(tests)]
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *sums)
    each = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (rule, c) in enumerate(tests))))
    tested = counts.select("stratum", "n", each.alias("x")).select("stratum", "n", "x.*")
    sure = tested.where(p_value(F.col("n"), F.col("k"), risk / len(GRID)) <= error / (len(tests) * (len(STRATA) + 1)))
    return {(r["stratum"], r["rule"]): r["cutoff"] for r in sure.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff")).collect()}


def kept(m: Column, where: Column, chosen: dict[tuple[str, str], float]) -> Column:
    found, rejected = rates(m), base_failed(m)
    for (s, rule), cut in sorted(chosen.items()):
        rejected = rejected | ((where == s) & (found[rule] > cut))
    return ~rejected


def measured(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum(F.col("lang")).alias("stratum"), measures(F.col("text")).alias("m"), F.xxhash64("text").alias("text_hash"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept."""
    held = staged(measured(docs), "measures")
    chosen = cutoffs(held, labels)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return held.select("doc_id", *(F.col(f"m.{n}").alias(n) for n in names), base_failed(F.col("m")).alias("base_failed"), kept(F.col("m"), F.col("stratum"), chosen).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that pass, unchanged. Each row is staged with its measures, which are taken once."""
    m = measures(F.col("text")).alias("m")
    held = staged(docs.select(F.struct("*").alias("row"), stratum(F.col("lang")).alias("stratum"), m), "judged")
    chosen = cutoffs(held.select(F.col("row.doc_id").cast("long").alias("doc_id"), "stratum", "m", F.xxhash64("row.text").alias("text_hash")), labels)
    return held.where(kept(F.col("m"), F.col("stratum"), chosen)).select("row.*")
