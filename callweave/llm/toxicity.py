"""Toxicity by weak supervision.

Voters, each of which votes toxic, clean, or abstains:

- seed lexicons, written down here by theme and language, made without any label;
- mined lexicons: each labelled training row gives its distinct lower-cased words
  and their first five and seven letters as features. Features are counted per
  label and training fold, and one whose log-odds, less 1.5 standard errors, are
  still at least `LEAST_ODDS` in a fold enters the lexicon of its kind and fold.
  The criterion is relative to the error of its own estimate, so it is the same at
  every table size. A mined voter has no vote on rows of its own fold;
- for each fold, all its mined lexicons together;
- patterns: shouting, exclamation, and address in the second person beside a listed
  word.

Label model. A generative model of the votes (each voter's vote rates given the
class) is fitted by expectation maximisation on a bounded sample of rows, from
the votes and the class balance alone. Abstaining is no evidence, and a vote for a
class is never evidence against it, which keeps the classes from changing places. Correlations between voters, given the class,
are estimated from the same posteriors; a voter's evidence is divided by the root
of the correlated votes it shares. Known labels then calibrate the posterior (Platt).

Classifier. A logistic regression on the lexicon features, seed hits among them,
is trained on the posterior labels of the sample and scores whole texts. Labels,
language, source and id are no inputs of a score.

Bounds: `SAMPLE` rows for the label model and classifier (those with the least
hash of doc_id); lexicon features that pass the criterion, `LEXICON` of them at
most, in order of strength (the 0.5 GB table has a fortieth of that); both fit
the driver whatever the input. Feature counts cover all labelled training rows.
Null and empty texts have no feature and get the classifier's base score; rows
without a doc_id are scored and are no training rows; labels that are null or
name no document are ignored; repeated rows are scored each. Without labels only
the seed lexicons and patterns speak, and their majority is the target.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2
TRAINING = tuple(f for f in range(FOLDS) if f != HELD_OUT)
SAMPLE = 20_000
LEXICON = 200_000
LEAST_ODDS, ERRORS = 2.0, 1.5
#: Letters of a feature; None: the whole word.
KINDS = (None, 5, 7)
CUTOFF = 0.3
#: Seed lexicons by theme and language.
SEEDS = {
    "en_mind": "idiot idiots moron morons stupid dumb imbecile fool fools clown clowns brainless retarded cretin dimwit",
    "en_worth": "worthless trash garbage scum loser losers pathetic disgusting filth vermin useless lowlife pig coward",
    "en_abuse": "bastard bitch asshole shit fuck fucking damn crap whore slut jerk bullshit",
    "de": "dumm dummkopf trottel depp arschloch scheisse scheiße abschaum wertlos ekelhaft erbärmlich versager verlierer müll dreck schwein hure",
    "fr": "idiote crétin crétine imbécile débile minable pathétique ordure déchet dégoûtant merde connard connasse salaud pute raté nul",
    "es": "idiota idiotas imbécil estúpido estúpida tonto tonta basura escoria inútil patético asqueroso mierda cabrón puta perdedor cerdo",
}
SECOND = ("you", "your", "du", "dich", "tu", "vous", "usted", "eres")
MINED = [(k, f) for k in range(len(KINDS)) for f in TRAINING]
PATTERNS = ("shouting", "exclamation", "address")
VOTERS = [*SEEDS, *(f"mined-{KINDS[k] or 'word'}-{f}" for k, f in MINED), *(f"many-{f}" for f in TRAINING), *PATTERNS]
#: A voter that has no say on a row, unlike one that abstains.
MISSING = 2
_TRIM = "\t\n\r\x0b\x0c .,;:!?\"'()[]{}<>*#$%&|-_/\\"


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == HELD_OUT, F.lit(False))


class Features(dict):
    """Raw word -> its features: the word, and its first five and seven letters."""

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) >= 500_000:
            self.clear()
        w = raw.strip(_TRIM).lower()
        self[raw] = got = tuple(f"{n or ''}={w[:n]}" for n in KINDS if w and len(w) >= (n or 1))
        return got


class Lexicon:
    """The features that passed: name, and the folds (places in TRAINING) in whose own counts each passes; the seed lists stand behind them."""

    def __init__(self, mined: list[tuple[str, list[int]]]):
        self.names = [n for n, _ in mined]
        self.folds = [tuple(f) for _, f in mined]
        marks = [f"{n or ''}=" for n in KINDS]
        self.kinds = [next(j for j, m in enumerate(marks) if n.startswith(m)) for n in self.names]
        self.places: list[dict[str, int]] = [{} for _ in KINDS]
        for k, (n, j) in enumerate(zip(self.names, self.kinds, strict=True)):
            self.places[j][n[len(marks[j]) :]] = k
        self.seeds: dict[str, list[int]] = {}
        for k, words in enumerate(SEEDS.values()):
            for w in words.split():
                self.seeds.setdefault(w, []).append(len(self.names) + k)
        self.size = len(self.names) + len(SEEDS)


class Scores(dict):
    """Raw word -> places of its features in the lexicon."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> tuple[int, ...]:
        if len(self) >= 500_000:
            self.clear()
        word = raw.strip(_TRIM).lower()
        found = [places.get(word[:n]) for n, places in zip(KINDS, self.lexicon.places, strict=True) if len(word) >= (n or 1)]
        self[raw] = got = (*(k for k in found if k is not None), *self.lexicon.seeds.get(word, ()))
        return got

    def of(self, text: str | None) -> list[int]:
        return sorted({k for raw in set((text or "").split()) for k in self[raw]})


def _counts(k: str) -> list[str]:
    return [f"{k}{f}" for f in TRAINING]


def feature_counts(rows: DataFrame) -> DataFrame:
    """text, toxic, fold -> feature, and the toxic (t) and clean (c) documents of each fold that have it."""
    names = _counts("c") + _counts("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features: Features = Features()
        place: dict[str, int] = {}
        seen: list[np.ndarray] = [np.zeros((1 << 16, len(names)), np.int32)]

        def flush():
            found = seen[0][: len(place)].astype(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()), *(pa.array(found[:, j]) for j in range(len(names)))], ["feature", *names])
            place.clear()
            seen[0] = np.zeros((1 << 16, len(names)), np.int32)
            return out

        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {f for raw in set((text or "").split()) for f in features[raw]}
                at = [place.setdefault(f, len(place)) for f in own]
                while len(place) > len(seen[0]):
                    seen[0] = np.vstack([seen[0], np.zeros_like(seen[0])])
                seen[0][at, toxic * len(TRAINING) + TRAINING.index(fold)] += 1
                if len(place) > 400_000:
                    yield flush()
        yield flush()

    made = rows.select("text", "toxic", "fold").mapInArrow(run, "feature string, " + ", ".join(f"{n} long" for n in names))
    return made.groupBy("feature").agg(*(F.sum(n).alias(n) for n in names))


def _least_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Smoothed log-odds less ERRORS standard errors."""
    odds = F.ln((toxic + 0.5) / (n_toxic + 1)) - F.ln((clean + 0.5) / (n_clean + 1))
    return odds - ERRORS * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def lexicon_of(counts: DataFrame, totals: dict[tuple[int, int], int]) -> Lexicon:
    """totals: (fold, label) -> training rows."""
    total = lambda label, folds: sum(totals.get((f, label), 0) for f in folds)
    add = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    pooled = _least_odds(add(_counts("t")), add(_counts("c")), total(1, TRAINING), total(0, TRAINING))
    each = [_least_odds(F.col(f"t{f}"), F.col(f"c{f}"), total(1, (f,)), total(0, (f,))) for f in TRAINING]
    own = F.filter(F.array(*(F.when(b >= LEAST_ODDS, F.lit(k)) for k, b in enumerate(each))), lambda k: k.isNotNull())
    strong = counts.withColumns({"bound": pooled, "folds": own}).where((F.col("bound") >= LEAST_ODDS) & (add(_counts("t")) > 0))
    found = strong.orderBy(F.desc("bound"), "feature").limit(LEXICON).select("feature", "folds").collect()
    return Lexicon([(r["feature"], r["folds"]) for r in found])


def votes_of(text: str | None, hits: list[int], lexicon: Lexicon, fold: int) -> list[int]:
    """1 toxic, -1 clean, 0 no vote, MISSING: in the order of VOTERS."""
    text, n = text or "", len(lexicon.names)
    seeds = {k - n for k in hits if k >= n}
    out = [1 if k in seeds else 0 for k in range(len(SEEDS))]
    held: dict[tuple[int, int], int] = {}
    for k in hits:
        if k < n:
            kind = lexicon.kinds[k]
            for f in lexicon.folds[k]:
                held[kind, TRAINING[f]] = held.get((kind, TRAINING[f]), 0) + 1
    # Chance hits grow with a text, so a vote for toxic takes two hits and one for every hundred different words.
    enough = max(2, len(set(text.split())) / 100)
    out += [MISSING if f == fold else 1 if held.get((kind, f), 0) >= enough else 0 if (kind, f) in held else -1 for kind, f in MINED]
    for f in TRAINING:
        n_hits = sum(held.get((kind, f), 0) for kind in range(len(KINDS)))
        out.append(MISSING if f == fold else 1 if n_hits >= enough else 0 if n_hits else -1)
    upper = sum(map(str.isupper, text))
    out.append(1 if 2 * upper > len(text) else 0)
    marks = text.count("!")
    out.append(1 if marks * 50 > len(text) else -1 if not marks else 0)
    low = f" {text.lower()} "
    out.append(1 if hits and any(f" {w} " in low for w in SECOND) else 0)
    return out


def majority(votes: np.ndarray) -> np.ndarray:
    """Share of toxic among the votes given, halfway where there are none."""
    up, down = (votes == 1).sum(1), (votes == -1).sum(1)
    return (up + 0.5) / (up + down + 1)


def balanced(evidence: np.ndarray, share: float) -> np.ndarray:
    """Posteriors with the given evidence (log-odds, but for a constant) whose mean is the class balance."""
    low, high = -60.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        post = 1 / (1 + np.exp(-np.clip(evidence + mid, -30, 30)))
        low, high = (mid, high) if post.mean() < share else (low, mid)
    return post


def label_model(votes: np.ndarray, share: float, rounds: int = 100) -> tuple[np.ndarray, dict]:
    """Posterior of the toxic class for each row of votes, from the votes and the class balance alone; and the model."""
    given = votes != MISSING
    held = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)
    # To begin with, a vote for toxic is right four times in five, one for clean halves the odds.
    up, down = (votes == 1).sum(1), (votes == -1).sum(1)
    post, weight = balanced(0.3 * (up * np.log(4 * (1 - share) / share) - down * np.log(2)), share), np.ones(votes.shape[1])
    settled = False  # correlations are looked at only in posteriors that have settled without them
    signed = np.where(given, votes, 0)
    for k in range(rounds):
        rates = []
        for p in (1 - post, post):
            seen = np.einsum("vij,i->vj", held, p) + 0.5
            rates.append(np.log(seen / seen.sum(0)))
        odds = rates[1] - rates[0]
        odds = np.stack([np.minimum(odds[0], 0), np.zeros_like(odds[0]), np.maximum(odds[2], 0)])
        gain = np.einsum("vij,vj->ij", held, odds)
        new = balanced(gain @ weight, share)
        rest = np.zeros(votes.shape)
        for p in (1 - new, new):
            mean = (signed * p[:, None]).sum(0) / np.maximum((given * p[:, None]).sum(0), 1e-9)
            rest += p[:, None] * (signed - mean) * given
        spread = np.sqrt((rest**2).mean(0)) + 1e-9
        linked = np.abs(rest.T @ rest / len(rest) / np.outer(spread, spread))
        done = np.abs(new - post).max() < 1e-4 or k == rounds // 2
        post = new
        if done and settled:
            break
        settled = settled or done
        if settled:
            weight = 1 / np.sqrt(np.where(linked > 0.15, linked, 0).clip(0, 1).sum(1).clip(1))
    # How often a voter that votes is right.
    right = (held[2] * post[:, None] + held[0] * (1 - post)[:, None]).sum(0) / np.maximum((held[0] + held[2]).sum(0), 1)
    return post, {"rates": rates, "weight": weight, "correlation": linked, "accuracy": right}


def balance(labels: np.ndarray) -> float:
    """Smoothed share of toxic rows."""
    return (labels.sum() + 1) / (len(labels) + 2)


def calibrated(post: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Platt's scaling of the posterior's logit to the known labels; as it is without both labels."""
    if len(set(labels.tolist())) < 2:
        return post
    raw = np.log(post.clip(1e-9, 1 - 1e-9) / (1 - post).clip(1e-9, 1 - 1e-9))
    at = np.array([1.0, 0.0])
    loss = lambda x: np.logaddexp(0, np.where(labels == 1, -1, 1) * (x[0] * raw + x[1])).sum() + (x[0] - 1) ** 2 / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at[0] * raw + at[1], -30, 30)))
        s = p * (1 - p) + 1e-6
        slope = np.array([((p - labels) * raw).sum() + (at[0] - 1), (p - labels).sum()])
        move = np.linalg.solve(np.array([[(s * raw * raw).sum() + 1, (s * raw).sum()], [(s * raw).sum(), s.sum()]]), slope)
        size = next((t for t in 0.5 ** np.arange(20) if loss(at - t * move) < loss(at)), 0.0)
        at = at - size * move
        if not size:
            break
    return 1 / (1 + np.exp(-np.clip(at[0] * raw + at[1], -30, 30)))


def linear(hits: list[list[int]], target: np.ndarray, n: int, rounds: int = 400, hold: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features with soft targets; weights are at least 0, as every feature is there for marking toxic texts."""
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    cols = np.concatenate([np.asarray(h, np.int64) for h in hits]) if len(rows) else np.zeros(0, np.int64)
    seen = np.bincount(cols, minlength=n) + 1.0
    w, bias = np.ones(n), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))) - 1
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, rounds + 1):
        score = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, w[cols], len(hits)), -30, 30)))
        error = score - target
        # The penalty draws each weight towards 1; the more rows have a feature, the less it counts.
        slope, own = (np.bincount(cols, error[rows], n) + hold * (w - 1)) / seen, error.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2, 0.9 * mb + 0.1 * own, 0.999 * vb + 0.001 * own**2
        rate = 0.1 if t < rounds // 2 else 0.02
        w = np.maximum(w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6), 0)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    return w, bias


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias


def voted(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, text, toxic, fold -> doc_id, hits, votes, toxic."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for batch in batches:
            texts, folds = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            hits = [scores.of(t) for t in texts]
            votes = [votes_of(t, h, shared.value, f) for t, h, f in zip(texts, hits, folds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int32())), batch.column(2)], ["doc_id", "hits", "votes", "toxic"])

    return rows.select("doc_id", "text", "toxic", "fold").mapInArrow(run, "doc_id long, hits array<int>, votes array<int>, toxic int")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.withColumn("fold", fold_of(F.col("doc_id")).cast("int"))
    # Labels grow with the input, so they are never broadcast here.
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = held.join(known.hint("merge"), "doc_id")
    totals = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    lexicon = lexicon_of(feature_counts(rows), totals)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    got = voted(held.join(F.broadcast(chosen), "doc_id"), lexicon).select("hits", "votes", "toxic").collect()
    got.sort()  # at most `SAMPLE` documents; the fit doesn't depend on their order of arrival
    if not got:
        return Model(lexicon, np.append(np.zeros(len(lexicon.names)), np.full(len(SEEDS), 4.0)), -3.0)
    hits = [r["hits"] for r in got]
    marks = np.array([r["toxic"] for r in got])
    post, _ = label_model(np.array([r["votes"] for r in got]), balance(marks))
    target = calibrated(post, marks)
    return Model(lexicon, *linear(hits, target, lexicon.size))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights, bias = shared.value
        scores = Scores(lexicon)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sums = np.array([bias + weights[scores.of(t)].sum() for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -30, 30))), pa.float64())], ["doc_id", "score"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS
