"""Judging web addresses: rules of hosts and paths first, then a weighted vocabulary of terms.

A rule (host, path, verdict) fits its host and all subdomains if the address's
path starts with the rule's; of the rules that fit the longest wins (characters
of host and path together, then of the host; block before allow). What no rule
fits is read by an Aho-Corasick automaton over the whole address, with A-Z in
lower case. A term counts if no letter stands before or after it: a to z and
everything beyond ASCII are letters, digits are not, so casino777 holds casino.
One strict term blocks; soft terms block if the weights of the distinct ones
reach the limit, which no single one does.

Defined cases: a null address or one without :// has an empty host and path, so
no rule fits; the vocabulary reads what is there (null: nothing). Repeated rows
and ids keep a row each. Other columns are left out, whatever their names. An
empty table gives an empty result, an empty vocabulary allows all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path, verdict.
RULES: tuple[Rule, ...] = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
STRICT = ("porn", "porno", "xxx", "hentai", "casino", "casinos", "viagra", "cialis", "spam", "warez", "malware", "phishing", "escort", "escorts", "jackpot", "roulette")
SOFT = {
    "cheap": 1, "pills": 2, "free": 1, "bet": 2, "bets": 2, "betting": 2, "win": 1, "winner": 1, "ads": 2, "adserver": 2, "track": 1, "tracker": 1, "click": 1, "clicks": 1, "poker": 2, "slots": 2, "lottery": 2, "loan": 1, "loans": 1, "pharmacy": 2,
    "replica": 2, "adult": 2, "sexy": 2, "nude": 2, "dating": 1, "bonus": 1, "crack": 2, "keygen": 2, "torrent": 2, "farm": 1, "discount": 1, "offer": 1, "seo": 1, "backlinks": 2,
}
LIMIT = 3
_LETTER = re.compile("[a-z\u0080-\U0010ffff]")


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "^(?s:.*?)://", ""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _better(host: str, path: str, verdict: str) -> tuple:
    return len(host) + len(path), len(host), verdict == "block"


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The rule that wins, as a struct of rule and verdict, or null: an expression, so the rules travel with the plan."""
    got = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: _better(*r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        got = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(got)
    return got


def rules_by_join(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a table of rules of any size: (host, path) -> host, path, rule, verdict of the sites that a rule fits.

    Each site is exploded into its host's suffixes and those leading parts of
    its path that are as long as some rule's, so the join is on equality.
    """
    lengths = F.broadcast(rules.where("host is not null and path is not null").agg(F.array_sort(F.collect_set(F.length("path"))).alias("__lengths")))  # a row, of distinct lengths
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    heads = F.transform(F.filter("__lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    each = sites.select("host", "path").distinct().join(lengths).select("host", "path", F.explode(suffixes).alias("__h"), heads.alias("__heads")).select("host", "path", "__h", F.explode("__heads").alias("__p"))
    held = rules.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "verdict")
    rank = F.struct(F.length("__h") + F.length("__p"), F.length("__h"), F.col("verdict") == "block")
    best = each.join(held, ["__h", "__p"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("__h", "__p").alias("rule"), "verdict"), rank).alias("r"))
    return best.select("host", "path", "r.rule", "r.verdict")


def automaton(terms: Sequence[str]) -> ahocorasick.Automaton | None:
    made = ahocorasick.Automaton()
    for t in terms:
        made.add_word(t, t)
    if not len(made):
        return None
    made.make_automaton()
    return made


def terms_in(url: str, machine: ahocorasick.Automaton | None) -> set[str]:
    """Distinct terms of the automaton in the address, with no letter before or after."""
    if machine is None:
        return set()
    low, found = url.encode().lower().decode(), set()
    for last, term in machine.iter(low):
        first = last - len(term)
        if not (first >= 0 and _LETTER.match(low[first])) and not (last + 1 < len(low) and _LETTER.match(low[last + 1])):
            found.add(term)
    return found


def judged(pages: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, strict: Sequence[str] = STRICT, soft: dict[str, int] = SOFT, limit: int = LIMIT, id_: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and n_strict, n_soft, soft_weight: distinct strict and soft terms and the latter's weight.

    A list of rules becomes part of the expression; a table of them is joined.
    """
    weights = {t.encode().lower().decode(): w for t, w in soft.items()}
    hard = frozenset(t.encode().lower().decode() for t in strict)
    if "" in hard or "" in weights or any(not 0 < w < limit for w in weights.values()):
        raise ValueError("terms are not empty, and soft weights lie between 0 and the limit")

    @F.pandas_udf("n_strict long, n_soft long, soft_weight long")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton([*hard, *(t for t in weights if t not in hard)])
        for part in urls:
            rows = []
            for u in part:
                found = terms_in(u, machine) if isinstance(u, str) else set()
                mild = [weights[t] for t in found - hard]
                rows.append((len(found & hard), len(mild), sum(mild)))
            yield pd.DataFrame(rows, columns=["n_strict", "n_soft", "soft_weight"])

    held = pages.select(F.col(id_).alias("page_id"), F.col(url).alias("__url"))
    host, path = parts(F.col("__url"))
    held = held.select("page_id", host.alias("host"), path.alias("path"), hits("__url").alias("__t"))
    if isinstance(rules, DataFrame):
        held = held.join(rules_by_join(held, rules).withColumnRenamed("verdict", "__v"), ["host", "path"], "left")
    else:
        held = held.withColumn("__r", rule_of(F.col("host"), F.col("path"), rules)).select("*", "__r.rule", F.col("__r.verdict").alias("__v"))
    own = F.when((F.col("__t.n_strict") > 0) | (F.col("__t.soft_weight") >= limit), "block").otherwise("allow")
    return held.select("page_id", "host", "path", "rule", F.coalesce("__v", own).alias("verdict"), "__t.n_strict", "__t.n_soft", "__t.soft_weight")


def _sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    terms = ", ".join(f"({text(re.escape(t))}, {w})" for t, w in [*((t, 0) for t in STRICT), *SOFT.items()])
    rules = ", ".join(f"({text(h)}, {text(p)}, {text(v)})" for h, p, v in RULES)
    return f"""with terms(term, weight) as (values {terms}), rules(rule_host, rule_path, rule_verdict) as (values {rules}),
    rest as (select page_id, row_number() over () as k, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') as low, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as r from pages),
    parted as (select page_id, k, low, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
    ruled as (select k, arg_max(struct_pack(rule := rule_host || rule_path, verdict := rule_verdict), (length(rule_host || rule_path), length(rule_host), rule_verdict = 'block')) as r
      from parted, rules where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by k),
    found as (select k, count(*) filter (weight = 0) as n_strict, count(*) filter (weight > 0) as n_soft, sum(weight)::bigint as soft_weight
      from parted, terms where regexp_matches(low, '(^|[^a-z\\x{{80}}-\\x{{10FFFF}}])' || term || '($|[^a-z\\x{{80}}-\\x{{10FFFF}}])') group by k)
    select page_id, host, path, r.rule as rule, coalesce(r.verdict, case when coalesce(n_strict, 0) > 0 or coalesce(soft_weight, 0) >= {LIMIT} then 'block' else 'allow' end) as verdict,
      coalesce(n_strict, 0) as n_strict, coalesce(n_soft, 0) as n_soft, coalesce(soft_weight, 0) as soft_weight
    from parted left join ruled using (k) left join found using (k)"""


ORACLE_SQL = _sql()
