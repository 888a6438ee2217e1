"""The quality classifier: held-out accuracy, calibration, what it may not look at."""

import random
from zlib import crc32

import numpy as np

from millrace.llm import classifier as c


def frames(spark, n=900, seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnstr") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = [word() for _ in range(rng.randrange(20, 200))]
        if not good:
            words = [w.upper() + "!!" if i % 2 else w + rng.choice(["***", "$$$"]) for w in words]
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 1.0))
        labels.append((i, int(good), 0))
    docs += [(n, None, None, None, None), (n + 1, "", "", "", 0.0), (None, "a null id", "", "", 0.0), (3, docs[3][1], "de", "x", 2.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame([*labels, (5, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = frames(spark)
    found = c.classify(docs, labels).collect()
    assert len(found) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
    held = [(r.score, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    good, bad = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.95
    same = [r.score for r in found if r.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]


def test_hold_outs_teach_nothing(spark):
    docs, labels = frames(spark, 300)
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(cast(doc_id as string)), 5) = 0 then 1 - quality else quality end as quality", "toxic")
    a, b = ({r.doc_id: round(r.score, 9) for r in c.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_empty(spark):
    docs, labels = frames(spark, 20)
    assert {r.score for r in c.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert c.classify(docs.limit(0), labels).count() == 0


def test_isotonic():
    rng = np.random.default_rng(0)
    y = rng.random(40) + np.arange(40) / 30
    knots, values = c.isotonic(np.arange(40.0), y, np.ones(40))
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    pools = np.searchsorted((knots[:-1] + knots[1:]) / 2, np.arange(40)) if len(knots) > 1 else np.zeros(40, int)
    assert len(values) <= 40 and abs(sum(values[pools]) - y.sum()) < 40
    knots, values = c.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 3, 2, 0]), np.array([1.0, 1, 1, 0]))
    assert knots.tolist() == [0, 1.5] and values.tolist() == [1, 2.5]


def test_kernel():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(c.STATISTICS, 4000)) / np.sqrt(c.STATISTICS)
    model = c.Model(np.zeros(c.STATISTICS), np.ones(c.STATISTICS), weights, rng.uniform(0, 2 * np.pi, 4000), np.zeros(4001), np.empty(0), np.empty(0))
    f = rng.normal(size=(20, c.STATISTICS))
    z = model.features(f)[:, :-1]
    true = np.exp(-((f[:, None] - f[None]) ** 2).sum(2) / (2 * c.STATISTICS))
    assert np.abs(z @ z.T - true).max() < 0.1
