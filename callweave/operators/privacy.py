"""Keyed pseudonyms, text scrub with learned words, the survey before it, and the leak scan."""

from __future__ import annotations

import re
from collections.abc import Iterator
from ipaddress import ip_address

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.staging import staged
from callweave.operators.permutation import STRUCTURE, TLDS, Permuter

#: Characters that identifiers are written with, those of single numbers and names, and mail addresses.
_RUN = re.compile(r"[0-9A-Za-z+:.@%_-]+", re.ASCII)
_PIECE = re.compile(r"[0-9A-Za-z+.-]+", re.ASCII)
_MAIL = re.compile(r"([A-Za-z0-9._%+-]+)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.ASCII)
_NETWORK = re.compile(r"mnc[0-9]{2,3}\.mcc[0-9]{3}", re.IGNORECASE)
_LABEL = re.compile(r"[0-9A-Za-z](?:[0-9A-Za-z_-]*[0-9A-Za-z])?", re.ASCII)
#: Words of an automaton at most; more of them are matched in further passes.
WORDS = 100_000
#: Names that stand before an identifier, and schemes before a user part.
TAGS, SCHEMES = ("imsi", "msisdn", "imei", "nai", "suci"), ("sip", "sips", "tel")
#: Digits of an international number without its + (E.164), and of an IMSI or IMEI that stands alone.
E164, BARE = range(7, 16), range(14, 17)


def _number(text: str) -> bool:
    return text.isascii() and text.isdigit()


def _quad(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(_number(p) and len(p) <= 3 and int(p) <= 255 for p in parts)


def _six(text: str) -> bool:
    try:
        return text.count(":") > 1 and ip_address(text).version == 6
    except ValueError:
        return False


def _host(piece: str) -> bool:
    """A host name: three labels or more, or two with a known last one, and a letter in the last."""
    labels = piece.split(".")
    return len(labels) > 1 and all(map(_LABEL.fullmatch, labels)) and not labels[-1].isdigit() and (len(labels) > 2 or labels[-1].lower() in TLDS)


def identifiers(run: str, hosts: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what has to change in a run of identifier characters; the first reading that holds is taken.

    A URI with a number as user, mail addresses, an IPv6 address, then piece by
    piece: tagged identifiers (a SUCI whole), IPv4, international numbers, bare
    subscriber or equipment numbers, host names if asked for, and network names.
    """
    scheme, colon, rest = run.partition(":")
    user = rest.partition("@")[0].lstrip("+").rstrip(".")
    if colon and scheme.lower() in SCHEMES and _number(user) and len(user) >= 5:
        at = run.index(user, len(scheme) + 1)
        at_sign = run.find("@", at)
        rest = [(at_sign + 1 + a, at_sign + 1 + b, k) for a, b, k in identifiers(run[at_sign + 1 :], hosts)] if at_sign > 0 else []
        return [(at, at + len(user), "uri"), *rest]
    mails = [(*m.span(1), "email") for m in _MAIL.finditer(run)]
    if mails:
        domains = [(m.end(1) + 1, m.end(), "fqdn") for m in _MAIL.finditer(run)] if hosts else []
        return sorted(mails + domains)
    bare = run.strip(".-")
    if _six(bare):
        at = run.index(bare)
        return [(at, at + len(bare), "ipv6")]
    out = []
    for m in _PIECE.finditer(run):
        piece = m[0].strip(".-")
        at, fields = m.start() + m[0].find(piece), piece.split("-")
        if len(fields) > 1 and fields[0].lower() in TAGS and _number(fields[-1]) and len(fields[-1]) >= 5:
            tag = fields[0].lower()
            if tag == "suci":
                out.append((at, at + len(piece), "suci"))
            else:
                out.append((at + len(piece) - len(fields[-1]), at + len(piece), "imsi" if tag == "imsi" else "identity"))
        elif _quad(piece):
            out.append((at, at + len(piece), "ipv4"))
        elif piece.startswith("+") and _number(piece[1:]) and len(piece) - 1 in E164:
            out.append((at + 1, at + len(piece), "number"))
        elif _number(piece) and len(piece) in BARE:
            out.append((at, at + len(piece), "digits"))
        elif hosts and _host(piece):
            out.append((at, at + len(piece), "fqdn"))
        else:
            out += [(at + n.start(), at + n.end(), "plmn") for n in _NETWORK.finditer(piece)]
    return out


def pseudonym(key: bytes, kind: str, value: str) -> str:
    """Same length, character by character of the same class, and another for every original of a kind."""
    return Permuter(key).of(kind, value)


def pseudonyms(values: DataFrame, key: bytes, mcc3: tuple[str, ...] = ()) -> DataFrame:
    """kind, value -> pseudonym, once per distinct value; `collides` where two values of a kind got the same, which would be an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Permuter(key, mcc3)
        for p in parts:
            yield p.assign(pseudonym=[held.of(k, v) for k, v in zip(p["kind"], p["value"], strict=True)])

    made = values.select("kind", "value").where("kind is not null and value is not null").distinct().mapInPandas(run, "kind string, value string, pseudonym string")
    twice = made.groupBy("kind", "pseudonym").agg(F.count("*").alias("n"))
    return made.join(twice, ["kind", "pseudonym"]).select("kind", "value", "pseudonym", (F.col("n") > 1).alias("collides"))


def automaton(words: list[str]) -> ahocorasick.Automaton | None:
    made = ahocorasick.Automaton()
    for w in words:
        made.add_word(w.lower(), w)
    if not len(made):
        return None
    made.make_automaton()
    return made


def _words_in(text: str, words: ahocorasick.Automaton) -> Iterator[tuple[int, int]]:
    """Leftmost longest learned words that no letter or digit touches."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    held: dict[int, int] = {}
    for last, word in words.iter(low):
        first = last - len(word) + 1
        if not (first and low[first - 1].isalnum()) and not (last + 1 < len(low) and low[last + 1].isalnum()):
            held[first] = max(held.get(first, 0), last + 1)
    upto = 0
    for first in sorted(held):
        if first >= upto:
            yield first, held[first]
            upto = held[first]


def spans_of(text: str | None, words: ahocorasick.Automaton | None = None, hosts: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, original) of what the scrub finds; non-overlapping, identifiers before learned words."""
    text = text or ""
    found = [(m.start() + a, m.start() + b, kind, m[0][a:b]) for m in _RUN.finditer(text) for a, b, kind in identifiers(m[0], hosts)]
    if words is None:
        return found
    free, at = [], 0
    for s, e in _words_in(text, words):
        while at < len(found) and found[at][1] <= s:
            at += 1
        if at == len(found) or found[at][0] >= e:
            free.append((s, e, "word", text[s:e]))
    return sorted(found + free)


def originals(df: DataFrame, id_: str, text: str) -> DataFrame:
    """A row per finding: id, kind, value, start."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(i, k, v, s) for i, t in zip(p["id"], p["text"], strict=True) for s, _, k, v in spans_of(t)]
            yield pd.DataFrame(rows, columns=["id", "kind", "value", "start"])

    return df.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id long, kind string, value string, start long")


def _blocks(words: DataFrame, size: int) -> Iterator[list[str]]:
    """The learned words, at most `size` at a time on the driver."""
    held: list[str] = []
    for row in words.select("word").where("word is not null and word <> ''").distinct().toLocalIterator():
        held.append(row[0])
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def scrub(df: DataFrame, text: str, key: bytes, words: DataFrame | None = None, mcc3: tuple[str, ...] = (), block: int = WORDS) -> DataFrame:
    """df with the findings in text replaced by pseudonyms of the same length.

    words (word): what a survey learned; then host names are replaced too. Texts are
    read once for all words of a block, whatever their number, and a further time
    only for the words beyond it: what one pass has replaced is marked, so that no
    pass reads another's pseudonyms.
    """
    names = df.columns
    hosts = words is not None
    passes: list[tuple[list[str] | None, bool]] = [(None, True)]
    if words is not None:
        blocks = list(enumerate(_blocks(words, block)))
        passes = [(held, n == 0) for n, held in blocks] or passes

    def cleaned(df: DataFrame, held: list[str] | None, first: bool) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fake, machine = Permuter(key, mcc3), automaton(held or [])

            def clean(t, done):
                if not isinstance(t, str):
                    return t, done
                spans = spans_of(t, machine, hosts) if first else [(s, e, "word", t[s:e]) for s, e in (_words_in(t, machine) if machine else ())]
                spans = [x for x in spans if all(x[1] <= s or x[0] >= e for s, e in done)]
                out, at = [], 0
                for s, e, kind, value in spans:
                    out += [t[at:s], fake.of(kind, value)]
                    at = e
                return "".join(out) + t[at:], [*done, *((s, e) for s, e, _, _ in spans)]

            for p in parts:
                both = [clean(t, [tuple(x) for x in d]) for t, d in zip(p[text], p["__done"], strict=True)]
                yield p.assign(**{text: [b[0] for b in both], "__done": [[list(x) for x in b[1]] for b in both]})

        return df.mapInPandas(run, df.schema)

    out = df.withColumn("__done", F.array().cast("array<array<int>>"))
    for held, first in passes:
        out = cleaned(out, held, first)
    return out.select(names)


#: Everything an original could stand as: runs of letters, digits and marks, of letters, digits and dots, and of letters and digits.
TOKENS = (r"([A-Za-z0-9._%+-]+)", r"([A-Za-z0-9.]*[A-Za-z0-9])", r"([A-Za-z0-9]+)")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(t), 1) for t in TOKENS)))


def still_there(before: str | None, after: str, held: set[str]) -> set[str]:
    """Tokens of held that stand in after where they stood in before. Where a text's length has changed places say nothing, and all of held count."""
    if before is None or len(before) != len(after):
        return held
    return {m[0] for t in TOKENS for m in re.finditer(t, after) if m[0] in held and before[m.start() : m.end()] == m[0]}


def leak_scan(found: DataFrame, before: DataFrame, after: DataFrame, id_: str, text: str) -> DataFrame:
    """Per kind: originals that still stand in the output, and the same search on the input as a control; no control hit means blind.

    The pseudonym of one original can read like another: pseudonyms have the form of
    originals. What stands in a place where something else stood is no leak.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"token": [t for b, a, held in zip(p["before"], p["after"], p["held"], strict=True) for t in still_there(b, a, set(held))]}, dtype=object)

    known = staged(found.select("kind", F.col("value").alias("token")).distinct(), "known")  # read three times
    hits = lambda df: df.select(F.explode(tokens(F.col(text))).alias("token")).distinct().join(known, "token")
    after = staged(after.select(id_, text), "scrubbed")  # read three times
    standing = staged(hits(after), "standing")
    where = after.select(F.col(id_).alias("__id"), F.explode(tokens(F.col(text))).alias("token")).join(standing.select("token").distinct(), "token").groupBy("__id").agg(F.collect_set("token").alias("held"))
    # A row without an id, or one that the input lacks, has nothing to be compared with.
    rows = after.join(where, F.col(id_).eqNullSafe(F.col("__id"))).select("__id", F.col(text).alias("after"), "held").join(before.select(F.col(id_).alias("__id"), F.col(text).alias("before")), "__id", "left")
    leaked = rows.select("before", "after", "held").mapInPandas(run, "token string").distinct().join(standing, "token")
    total = known.groupBy("kind").agg(F.count("*").alias("originals"))
    count = lambda df, n: df.groupBy("kind").agg(F.count("*").alias(n))
    held = total.join(count(leaked, "leaked"), "kind", "left").join(count(hits(before), "control"), "kind", "left").fillna(0, ["leaked", "control"])
    return held.withColumn("blind", F.col("control") == 0)


def shift_clock(messages: DataFrame, epoch: str = "2000-01-01 00:00:00") -> DataFrame:
    """All clocks of a capture moved to a fixed start; differences stay."""
    base = messages.groupBy("capture_id").agg(F.min("event_time").alias("__t0"))
    moved = F.timestamp_micros(F.unix_micros("event_time") - F.unix_micros("__t0") + F.unix_micros(F.lit(epoch).cast("timestamp")))
    return messages.join(base, "capture_id").withColumn("event_time", moved).drop("__t0")


def zero_secrets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key material replaced by zeros of the same length."""
    return df.withColumns({c: F.repeat(F.lit("0"), F.length(c)) for c in columns})


def survey_plmn(texts: DataFrame, text: str) -> DataFrame:
    """PLMN pairs that 3GPP names in the data declare: mcc, mnc, how often."""
    pairs = F.regexp_extract_all(text, F.lit(r"mnc([0-9]{2,3})\.mcc([0-9]{3})"), 0)
    return texts.select(F.explode(pairs).alias("p")).groupBy(F.regexp_extract("p", r"mcc([0-9]{3})", 1).alias("mcc"), F.regexp_extract("p", r"mnc([0-9]{2,3})", 1).alias("mnc")).agg(F.count("*").alias("n"))


def learn_words(names: DataFrame, name: str, least: int = 4) -> DataFrame:
    """word, n: parts of host names that say whose they are, to be found wherever they stand: labels, and what hyphens divide, of `least` characters with a letter in them; nothing that only says what an element is."""
    labels = F.split(F.lower(F.col(name)), r"\.")
    whole = names.select(F.explode(labels).alias("label")).where("label is not null")
    parts = whole.select(F.explode(F.array_distinct(F.concat(F.array("label"), F.split("label", "[-_]")))).alias("word"))
    numbered = "^(" + "|".join(sorted(STRUCTURE, key=len, reverse=True)) + ")[0-9]+$"
    kept = parts.where((F.length("word") >= least) & F.col("word").rlike("[a-z]") & ~F.col("word").rlike("^(mnc|mcc)[0-9]+$") & ~F.col("word").rlike(numbered) & ~F.col("word").isin(*sorted(STRUCTURE | TLDS)))
    return kept.groupBy("word").agg(F.count("*").alias("n"))


def host_names(df: DataFrame, text: str) -> DataFrame:
    """name: host names that texts hold."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"name": [v for t in p["text"] for _, _, kind, v in spans_of(t, hosts=True) if kind == "fqdn"]}, dtype=object)

    return df.select(F.col(text).alias("text")).where("text is not null").mapInPandas(run, "name string")


def learned_mcc3(pairs: DataFrame) -> tuple[str, ...]:
    """Country codes that the data (mcc, mnc, n) show with network codes of three digits, not counting a zero in front. At most a thousand."""
    return tuple(sorted(r[0] for r in pairs.where("length(mnc) = 3 and mnc not like '0%' and length(mcc) = 3").select("mcc").distinct().collect()))


def keyed_columns(df: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    """Values that place an element or cell (tracking areas, cell ids; decimal or hexadecimal text), permuted under the key."""

    @F.pandas_udf("string")
    def keyed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fake = Permuter(key)
        for p in parts:
            yield p.map(lambda v: fake.of("topology", v) if isinstance(v, str) else None)

    return df.withColumns({c: keyed(c) for c in columns})
