"""The secret scan's network learns from all of the table's findings, dealt to shards."""

import random

import numpy as np

from callweave.llm import secret_scan as ss

DOCS = "doc_id long, text string"


def table(r):
    """Plain candidates of every length, and keys that the base patterns find."""
    name = lambda: "".join(r.choices(ss._LOWER, k=r.randint(12, 20)))
    rows = [(k, f"{name()} é {'/'.join(name() for _ in range(r.randint(1, 9)))} {name()}") for k in range(1500)]
    rows += [(k, f"{name()} token={ss._of(r, ss._MIXED, 8, 90)} {name()}") for k in range(1500, 1600)]
    return rows + [(2000, "a/" * 30_000 + "b")] + rows[:50]


def test_every_finding_is_trained_on_or_kept_for_calibration(spark, monkeypatch):
    monkeypatch.setattr(ss, "SHARD", 700)
    rows = table(random.Random(3))
    keys, plain = set(), set()
    for _, text in rows:
        for s, e, windows, labelled, is_plain in ss.candidates(text, ss.base_spans(text)):
            if labelled:
                keys.add(text[s:e])
            elif is_plain:
                plain.add(tuple(windows))
    assert len(plain) > ss.MASS and sum(len(w) > 1 for w in plain) > 1000 and max(map(len, plain)) > 2000
    mine, shards = ss.own(ss.findings(spark.createDataFrame(rows, DOCS)))
    got = mine.collect()
    assert shards > 5 and sorted((x.shard, x.kept) for x in got) == [(k, b) for k in range(shards) for b in (False, True)]
    assert sorted(k for x in got for (k,) in x["keys"] or []) == sorted(keys)
    assert sorted(tuple(w) for x in got for w in x["plain"] or []) == sorted(plain)
    assert 0.7 < sum(len(x["plain"]) for x in got if not x.kept) / len(plain) < 0.9
    x = next(x for x in got if not x.kept)
    steps = list(ss._batches(random.Random(1), x["keys"], x["plain"]))
    codes = np.concatenate([c[y == 0] for c, y, _ in steps])
    seen = {c.tobytes() for c in codes}
    assert all(c.tobytes() in seen for w in x["plain"] for c in ss.Network.codes(w))
    assert sum(len(c) for c, _, _ in steps) > sum(map(len, x["plain"])) + ss.DECOYS


def test_shards_agree_on_one_network(spark, monkeypatch):
    docs = spark.createDataFrame(table(random.Random(4)), DOCS)
    found = ss.staged(ss.findings(docs), "found")
    monkeypatch.setattr(ss, "SHARD", 2500)
    first, second = ss.fit(found), ss.fit(found.repartition(7))
    assert all((first.w[k] == second.w[k]).all() for k in first.w) and abs(first.threshold - second.threshold) < 1e-9
    r = random.Random(5)
    around = [("see ", " and"), ("\n", "\n")]
    for kind in set(ss.SHAPES) - set(ss.UNSEEN) - {"hex"}:
        assert np.mean(first.whole([ss._placed(r, ss.SHAPES[kind](r), around, True) for _ in range(100)]) >= first.threshold) >= 0.9, kind
    assert np.mean(first.whole([ss._placed(r, ss._decoy(r), around, False) for _ in range(300)]) >= first.threshold) <= 0.05


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(2)
    net, x, y, weight = ss.Network(3), r.integers(30, 120, (40, ss.WIDTH)).astype(np.uint8), r.integers(0, 2, 40).astype(float), r.random(40)
    monitor = net.gradient(x, y, weight)

    def loss():
        e = net.w["e"][x]
        unfolded = np.concatenate([e[:, j : j + net.span] for j in range(net.wide)], axis=2)
        h = np.maximum(unfolded @ net.w["k"] + net.w["b"], 0)
        z = np.concatenate([h[:, :14].max(1), h[:, 14:54].max(1), h[:, 54:].max(1)], axis=1) @ net.w["o"] + net.w["c"]
        assert np.allclose(z, net.output(x), atol=1e-4)
        return (weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum()

    for name, w in net.w.items():
        for at in r.integers(0, w.size, 12):
            w.flat[at] += 1e-5
            high = loss()
            w.flat[at] -= 2e-5
            low = loss()
            w.flat[at] += 1e-5
            assert abs((high - low) / 2e-5 - monitor[name].flat[at]) < 1e-4, name
