r"""Secret scan: fixed patterns, and a character convolutional network for what they miss.

Three patterns give the base findings (kinds assign, access, hex), which always
stay. Candidates are all maximal runs of at least 12 key characters, whatever
they hold. A small network, in numpy, reads each candidate whole with those
around it: windows of 40 characters that overlap by half run along the candidate,
each with 16 characters before and after; character embedding, convolution, ReLU,
maxima before, inside and after, one output; a candidate's score is the greatest
of its windows'. Candidates at or above the threshold that overlap no base
finding are added as kind cnn.

Training does not take its labels from the base patterns alone, so that a secret
which these miss is no negative example. Positives: keys made by the public shapes
of common credentials, and the base findings of the table with their prefix or
surroundings changed. Negatives: things made to look alike (card numbers, addresses,
identifiers, paths, hosts, dates, UUIDs), and candidates of the table that are
plainly no keys: letters alone, or digits and separators alone. All other candidates
of the table are unlabelled and not trained on. Surroundings come from the table.
Scores are calibrated by Platt's method on findings kept out of training, among them
kinds of keys that training never sees; the threshold is the highest that keeps the
required recall there.

All of the table's base findings and plain candidates are trained on, at every table
size: they are dealt by hash to shards of about `SHARD` each; in each of `ROUNDS` rounds
every shard goes once through its own, beside a set of made findings, from the weights of
the round before, and the shards' weights are averaged. However many findings of a sort a
shard has, they weigh as much as `MASS` made ones at most. Every fifth finding (by hash) is
kept for calibration, which reads all of those. Equal findings count once.
Texts are read once; only candidates with their surroundings go on.

Null and empty texts have no finding; rows with a null id and repeated rows are
scanned like others; an empty table gives an empty result; extra columns are
ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.staging import staged

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
#: Candidates that are no keys: words, names of words, numbers, addresses of hosts.
PLAIN = re.compile(r"[A-Za-z]+[.]?|[0-9][0-9./-]*|[A-Za-z]+(?:[./_-][A-Za-z]+)+[.]?|[A-Za-z]*[.]?[0-9]{1,3}|[a-z0-9-]+(?:[.][a-z0-9-]+)*[.](?:com|org|net|example)[.]?")
KINDS = ("assign", "access", "hex", "cnn")
AROUND, INSIDE = 16, 40
STEP = INSIDE // 2
WIDTH = 2 * AROUND + INSIDE
#: Findings of the table in a shard; the weight of a sort of them there, in made findings; rounds; findings made for a round.
SHARD, MASS, ROUNDS = 1 << 16, 4000, 6
PER_SHAPE, DECOYS = 400, 6000
RECALL = 0.97
_SPAN = "array<struct<kind:string,start:long,end:long>>"
_FOUND = f"doc_id long, base {_SPAN}, candidates array<struct<start:long,end:long,windows:array<string>,labelled:boolean,plain:boolean>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    at = 0
    for word in text.split():
        at = text.index(word, at)
        if len(word) >= 16:
            if "AKIA" in word:
                out += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(word) if len(m[0]) >= 16]
            if len(word) >= 32:
                out += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(word) if len(m[0]) >= 32]
        at += len(word)
    return sorted(out)


def windows_of(text: str, start: int, end: int) -> list[str]:
    """The windows along text[start:end], each padded to WIDTH characters."""
    out = []
    for s in range(start, max(start + 1, end - (INSIDE - STEP)), STEP):
        e = min(end, s + INSIDE)
        out.append((text[max(0, s - AROUND) : s].rjust(AROUND, "\0") + text[s:e].ljust(INSIDE, "\0") + text[e : e + AROUND].ljust(AROUND, "\0")).replace("\0", "\x01"))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[str], bool, bool]]:
    """(start, end, windows, overlaps a base finding, is otherwise plainly no key)."""
    out, at, k = [], 0, 0
    reach = 0  # the furthest end of the base findings that begin before a candidate's end
    for word in text.split():
        at = text.index(word, at)
        if len(word) >= LEAST:
            for m in CANDIDATE.finditer(word):
                s, e = at + m.start(), at + m.end()
                while k < len(base) and base[k][0] < e:
                    reach, k = max(reach, base[k][2]), k + 1
                out.append((s, e, windows_of(text, s, e), reach > s, reach <= s and bool(PLAIN.fullmatch(m[0]))))
        at += len(word)
    return out


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, candidates: one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        found = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("windows", pa.list_(pa.string())), ("labelled", pa.bool_()), ("plain", pa.bool_())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[list] = [[], [], []]
                part = batch.slice(lo, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    base = base_spans(text or "")
                    out[0].append(doc)
                    out[1].append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base])
                    out[2].append([{"start": s, "end": e, "windows": w, "labelled": x, "plain": y} for s, e, w, x, y in candidates(text or "", base)])
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(span)), pa.array(out[2], pa.list_(found))], ["doc_id", "base", "candidates"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_MIXED, _BASE64 = _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/"


def _of(r: random.Random, letters: str, least: int, most: int | None = None) -> str:
    return "".join(r.choices(letters, k=r.randint(least, most or least)))


def _words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n)]


#: Shapes of credentials; those of UNSEEN are kept for calibration.
SHAPES = {
    "hex": lambda r: _of(r, "0123456789abcdef", r.choice((32, 40, 64))),
    "upper-hex": lambda r: _of(r, "0123456789ABCDEF", r.choice((32, 40))),
    "mixed": lambda r: _of(r, _MIXED, 20, 64),
    "base64": lambda r: _of(r, _BASE64, 24, 88) + r.choice(("", "=", "==")),
    "url-safe": lambda r: _of(r, _MIXED + "-_", 22, 64),
    "prefixed": lambda r: f"{_of(r, _LOWER, 2, 4)}{r.choice('_-')}{r.choice(('', 'live_', 'test_', 'prod-'))}{_of(r, _MIXED, 16, 40)}",
    "dashed": lambda r: f"{_of(r, _LOWER, 4)}-{_of(r, _DIGITS, 10, 12)}-{_of(r, _MIXED, 24)}",
    "access": lambda r: _of(r, _UPPER, 4) + _of(r, _UPPER + _DIGITS, 12, 20),
    "path": lambda r: f"{'/'.join(_words(r, 2))}/{_of(r, _UPPER, 1)}{_of(r, _UPPER + _DIGITS, 8)}/{_of(r, _MIXED, 20, 32)}",
    "signed": lambda r: f"eyJ{_of(r, _MIXED, 20, 60)}.eyJ{_of(r, _MIXED, 30, 120)}.{_of(r, _MIXED + '-_', 43)}",
    "lower": lambda r: _of(r, _LOWER + _DIGITS, 24, 48),
}
UNSEEN = ("signed", "lower", "prefixed")


def _decoy(r: random.Random) -> str:
    """A run of key characters that is no secret."""
    w, d = _words(r, 6), lambda n: _of(r, _DIGITS, n)
    return r.choice(
        (
            lambda: d(r.randint(12, 19)),
            lambda: "-".join(d(4) for _ in range(4)),
            lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
            lambda: f"{w[0]}.{w[1]}{r.randrange(99)}",
            lambda: f"{w[0]}{r.randrange(10)}.{w[1]}.com",
            lambda: "".join(w[: r.randint(2, 5)]) + r.choice(("", ".", str(r.randrange(999)))),
            lambda: "".join(x.capitalize() for x in w[: r.randint(2, 6)]),
            lambda: r.choice("-_./").join(w[: r.randint(3, 6)]),
            lambda: "/".join(w[: r.randint(2, 4)]) + f"/{w[4]}_{r.randrange(999)}.{r.choice(('html', 'py', 'txt', 'png'))}",
            lambda: "".join(w).upper() + r.choice(("", "_", str(r.randrange(99)))),
            lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{d(2)}T{d(2)}.{d(2)}.{d(2)}",
            lambda: "-".join(_of(r, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
            lambda: f"{w[0]}-{r.randrange(20)}.{r.randrange(20)}.{r.randrange(99)}-{w[1]}.tar.gz",
            lambda: r.choice("-=._") * r.randint(12, 60),
            lambda: f"{w[0]}-{w[1]}={r.randrange(9999)}/{w[2]}",
        )
    )().ljust(LEAST, "0")


def _placed(r: random.Random, run: str, surroundings: list[tuple[str, str]], lead: bool) -> list[str]:
    """Windows of a run set between the surroundings of another."""
    before, after = r.choice(surroundings)
    if lead and r.random() < 0.5:
        before += r.choice(("key: ", "auth=", "Bearer ", "X-Key: ", "use ", "//", "id ", "code ", "credential='", '": "', "pass "))
    return windows_of(before + run + after, len(before), len(before) + len(run))


class Network:
    """Embedding, convolution, three maxima, one output; trained by Adam."""

    def __init__(self, seed: int = 0, depth: int = 8, filters: int = 24, wide: int = 5):
        r = np.random.default_rng(seed)
        self.wide = wide
        self.w = {"e": r.normal(0, 0.3, (128, depth)), "k": r.normal(0, 0.2, (wide * depth, filters)), "b": np.zeros(filters), "o": r.normal(0, 0.2, 3 * filters), "c": np.zeros(1)}
        self.span = WIDTH - wide + 1
        edges = 0, AROUND - wide // 2, AROUND + INSIDE - wide // 2, self.span
        self.parts = [slice(a, b) for a, b in zip(edges, edges[1:])]  # noqa: B905
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def load(self, flat: np.ndarray) -> Network:
        ends = np.cumsum([v.size for v in self.w.values()])
        self.w = {k: part.reshape(self.w[k].shape) for k, part in zip(self.w, np.split(flat, ends[:-1]), strict=True)}
        return self

    def whole(self, runs: list[list[str]]) -> np.ndarray:
        """The score of each run of windows: that of its highest window."""
        return self.score(self.highest(runs))

    def highest(self, runs: list[list[str]]) -> np.ndarray:
        """The output for each run's highest window, before calibration."""
        each = self.output(self.codes([w for windows in runs for w in windows]))
        return np.maximum.reduceat(each, np.cumsum([0] + [len(w) for w in runs[:-1]])) if runs else each

    @staticmethod
    def codes(windows: list[str]) -> np.ndarray:
        points = np.frombuffer("".join(w[:WIDTH].ljust(WIDTH, "\x01") for w in windows).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.minimum(points, 127).astype(np.uint8).reshape(len(windows), WIDTH)

    def _table(self) -> np.ndarray:
        """What a character adds to each filter at each offset: embedding times convolution."""
        return np.stack([self.w["e"] @ k for k in np.split(self.w["k"], self.wide)]).astype(np.float32)

    def _hidden(self, x: np.ndarray, table: np.ndarray) -> np.ndarray:
        h = table[0].take(x[:, : self.span], axis=0)
        for j in range(1, self.wide):
            h += table[j].take(x[:, j : j + self.span], axis=0)
        return h

    def output(self, x: np.ndarray) -> np.ndarray:
        table, out = self._table(), []
        for lo in range(0, len(x), 256):
            h = self._hidden(x[lo : lo + 256], table)
            pooled = np.concatenate([h[:, p].max(1) for p in self.parts], axis=1) + np.tile(self.w["b"], 3)
            # A sum per row: a matrix product could round a row by its neighbours.
            out.append((np.maximum(pooled, 0) * self.w["o"]).sum(1) + self.w["c"])
        return np.concatenate(out) if out else np.zeros(0)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Of the mean weighted logistic loss. Only the places of the maxima have a part in it."""
        w, n, filters = self.w, len(x), self.w["b"].size
        weight = weight / weight.sum()
        h = self._hidden(x, self._table())
        top = np.concatenate([h[:, p].argmax(1) + p.start for p in self.parts], axis=1)
        pooled = np.take_along_axis(h.reshape(n, -1), top * filters + np.tile(np.arange(filters), 3), 1) + np.tile(w["b"], 3)
        open_ = pooled > 0
        pooled = np.where(open_, pooled, 0)
        error = weight * (1 / (1 + np.exp(-np.clip((pooled * w["o"]).sum(1) + w["c"], -30, 30))) - y)
        back = open_ * error[:, None] * w["o"]
        grad = {"e": np.zeros_like(w["e"]), "k": np.zeros_like(w["k"]), "b": back.sum(0).reshape(3, filters).sum(0), "o": error @ pooled, "c": np.array([error.sum()])}
        row, filter_ = np.arange(n)[:, None], np.tile(np.arange(filters), 3)
        depth = w["e"].shape[1]
        for j in range(self.wide):
            at = slice(j * depth, (j + 1) * depth)
            by_char = np.bincount((x[row, top + j].astype(np.int64) * filters + filter_).ravel(), back.ravel(), 128 * filters).reshape(128, filters)
            grad["k"][at] = w["e"].T @ by_char
            grad["e"] += by_char @ w["k"][at].T
        return grad

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float) -> None:
        """Adam over batches of codes, labels, weights."""
        m, v = ({k: np.zeros_like(g) for k, g in self.w.items()} for _ in range(2))
        for step, (x, y, weight) in enumerate(batches, 1):
            for k, g in self.gradient(x, y, weight).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -30, 30)))


def own(found: DataFrame) -> tuple[DataFrame, int]:
    """shard, kept (for calibration), keys (runs), plain (windows of each): all findings of the table that have a label, two rows per shard; number of shards."""
    last = F.size("c.windows") - 1
    run = F.array_join(F.transform("c.windows", lambda w, k: F.substring(w, F.lit(AROUND + 1), F.when(k < last, STEP).otherwise(INSIDE))), "")
    each = found.select(F.explode("candidates").alias("c")).where("c.labelled or c.plain")
    each = staged(each.select(F.when(F.col("c.labelled"), F.array(F.rtrim(run, F.lit("\x01")))).otherwise(F.col("c.windows")).alias("x"), "c.labelled").distinct(), "labelled")
    shards = max(1, -(-each.count() // SHARD))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("x"), F.lit(shards)).cast("int")).withColumn("kept", F.pmod(F.xxhash64("x", F.lit("kept")), F.lit(5)) == 0)
    part = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("x"))))
    parts = dealt.groupBy("shard", "kept").agg(part(F.col("labelled")).alias("keys"), part(~F.col("labelled")).alias("plain"))
    every = found.sparkSession.range(2 * shards).select(F.floor(F.col("id") / 2).cast("int").alias("shard"), (F.col("id") % 2 == 1).alias("kept"))
    return staged(every.join(parts, ["shard", "kept"], "left").repartition(2 * shards), "own"), shards


def _around(plain: list[list[str]]) -> list[tuple[str, str]]:
    return [(w[0][:AROUND].replace("\x01", ""), w[-1][AROUND + INSIDE :].replace("\x01", "")) for w in plain] or [("", ""), ("\n", "\n"), (" ", " ")]


def _made(r: random.Random, around: list[tuple[str, str]], share: float, kinds: tuple[str, ...]) -> tuple[list[list[str]], list[list[str]]]:
    """Keys and look-alikes as windows, that share of a full set."""
    some = lambda n: range(int(n * share + r.random()))
    keys = [_placed(r, SHAPES[kind](r), around, True) for kind in kinds for _ in some(PER_SHAPE)]
    return keys, [_placed(r, _decoy(r), around, r.random() < 0.3) for _ in some(DECOYS)]


def _changed(r: random.Random, keys: list[list[str]], around: list[tuple[str, str]]) -> list[list[str]]:
    """Base findings of the table with their prefix or surroundings changed."""
    out = []
    for (run,) in keys:
        run = run[4:] if run.startswith("AKIA") and len(run) >= LEAST + 4 and r.random() < 0.5 else run
        out.append(_placed(r, run, around, True))
    return out


def _batches(r: random.Random, keys: list[list[str]], plain: list[list[str]], batch: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A round of a shard: all its own findings once, dealt out beside a set of made ones."""
    around, order = _around(plain), np.random.default_rng(r.randrange(1 << 32))
    made, alike = _made(r, around, 1.0, tuple(k for k in SHAPES if k not in UNSEEN))
    sorts = [(made, 1.0, None), (alike, 0.0, None), (_changed(r, keys, around), 1.0, MASS), (plain, 0.0, MASS)]
    codes, labels, weights, steps = [], [], [], 0
    for runs, label, mass in sorts:
        x = Network.codes([w for windows in runs for w in windows])
        codes.append(x)
        labels.append(np.full(len(x), label))
        weights.append(np.full(len(x), min(1.0, mass / max(1, len(x))) if mass else 1.0))
        steps += int(np.ceil(weights[-1].sum() / batch))
    mixed = [order.permutation(len(x)) for x in codes]
    for step in range(steps):
        at = [m[len(m) * step // steps : len(m) * (step + 1) // steps] for m in mixed]
        yield tuple(np.concatenate([c[a] for c, a in zip(every, at, strict=True)]) for every in (codes, labels, weights))


def fit(found: DataFrame, seed: int = 7) -> Network:
    """Train and calibrate on made findings and all of the table's own."""
    mine, shards = own(found)
    net = Network()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, kept, keys, plain = (c[k].as_py() for c in batch.columns)
                yield shard, kept, keys or [], plain or []

    for nth in range(ROUNDS):

        def trained(batches: Iterator[pa.RecordBatch], start: np.ndarray = net.flat(), nth: int = nth) -> Iterator[pa.RecordBatch]:
            for shard, kept, keys, plain in rows(batches):
                if kept:
                    continue
                local = Network().load(start)
                local.train(_batches(random.Random(f"{seed} {nth} {shard}"), keys, plain), 0.01 / (1 + nth / 2))
                n = len(keys) + sum(map(len, plain))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n + DECOYS], pa.int64()), pa.array([local.flat().tolist()], pa.list_(pa.float64()))], ["shard", "n", "w"])

        got = sorted(mine.mapInArrow(trained, "shard int, n long, w array<double>").collect())
        net.load(np.average([x.w for x in got], axis=0, weights=[x.n for x in got]))
    weights = net.flat()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Network().load(weights)
        for shard, kept, keys, plain in rows(batches):
            if not kept:
                continue
            r, around = random.Random(f"{seed} kept {shard}"), _around(plain)
            unseen, _ = _made(r, around, 1 / shards, UNSEEN)
            seen, alike = _made(r, around, 0.2 / shards, tuple(k for k in SHAPES if k not in UNSEEN))
            for runs, label in ((unseen + seen + _changed(r, keys, around), 1), (alike + plain, 0)):
                raw = local.highest(runs)
                yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(np.full(len(raw), label, np.int32))], ["raw", "y"])

    calibrate(net, staged(mine.mapInArrow(held, "raw double, y int"), "held"))
    return net


def calibrate(net: Network, held: DataFrame, recall: float = RECALL) -> None:
    """Platt scaling of all kept findings' outputs, then the highest threshold that keeps the recall."""
    count = {x.y: x.n for x in held.groupBy("y").agg(F.count("*").alias("n")).collect()}
    yes, no = count.get(1, 0), count.get(0, 0)
    target = F.when(F.col("y") == 1, (yes + 1) / (yes + 2)).otherwise(1 / (no + 2))
    a, b, raw = 1.0, 0.0, F.col("raw")
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * raw + b))))
        terms = held.select("raw", (p - target).alias("g"), (p * (1 - p) + 1e-4).alias("s"))
        x = terms.agg(*(F.coalesce(F.sum(e), F.lit(0.0)) for e in (F.col("g") * raw, F.col("g"), F.col("s") * raw * raw, F.col("s") * raw, F.col("s")))).first()
        step = np.linalg.solve(np.array([[x[2] + 1, x[3]], [x[3], x[4] + 1e-9]]), np.array([x[0] + a - 1, x[1]]))
        a, b = float(a - step[0]), float(b - step[1])
        if np.abs(step).max() < 1e-6:
            break
    net.scale, net.shift = a, b
    at = held.where("y = 1").orderBy("raw").offset(int((1 - recall) * yes)).limit(1).first()
    net.threshold = float(net.score(np.array([at.raw]))[0]) if at else 2.0


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end), sorted by start, then kind."""
    found = staged(findings(docs), "findings")
    shared = docs.sparkSession.sparkContext.broadcast(fit(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                base, cands = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                open_ = [(k, c) for k, cs in enumerate(cands) for c in cs if not c["labelled"]]
                spans = [[(s["start"], KINDS.index(s["kind"]), s["end"]) for s in b] for b in base]
                for (k, c), p in zip(open_, net.whole([c["windows"] for _, c in open_]), strict=True):
                    if p >= net.threshold:
                        spans[k].append((c["start"], 3, c["end"]))
                made = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(x)] for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, batch.column(1).type)], ["doc_id", "base", "spans"])

    return found.mapInArrow(run, f"doc_id long, base {_SPAN}, spans {_SPAN}")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text)."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS[:3]]
    return scanned.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
