"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann


def brute(rows, k=20):
    """{query: [(id, score)]} of rows (id, vector)."""
    ok = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            found = sorted(((-(v * w).sum(), j) for j, w in ok if j != i))[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


@pytest.mark.parametrize("split", [False, True])
def test_exact_where_all_lists_are_read(spark, split, monkeypatch):
    if split:  # many lists in two levels, lists and their queries split
        for name, value in (("FLAT", 2), ("SAMPLE_A_LIST", 4), ("LIST_ROWS", 10), ("QUERY_ROWS", 3)):
            monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(150)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0]) for i in range(120)]  # one vector that is very common
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [0.0] * 6), (2060, [float("nan")] + [1.0] * 7), (2080, [float("inf")] + [1.0] * 7), (2100, [1.0] * 9), (None, [1.0] * 8), (40, rows[40][1])]
    found = {}
    for r in ann.neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0, recall=1.0, rerank=50).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    expected = brute(rows)
    assert set(found) == set(expected)
    for q, near in expected.items():
        assert [found[q][k + 1] for k in range(len(near))] == near, q


@pytest.mark.parametrize("flat", [512, 4])
def test_recall(spark, flat, monkeypatch):
    monkeypatch.setattr(ann, "FLAT", flat)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    v = centres[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v = v.astype(np.float32)
    found = {}
    for r in ann.neighbours(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)]), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    w = v.astype(float)
    hits = 0
    for q in range(0, 3000, 20):
        s = w @ w[q]
        s[q] = -9
        hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (150 * 20) >= 0.9


@pytest.mark.parametrize("kind", ["codes", "queries"])
def test_recall_where_codes_are_coarse_or_queries_unlike_the_rest(spark, kind, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6000, 32))
    if kind == "codes":
        monkeypatch.setattr(ann, "CODES", 2)
    else:
        like = rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] + 0.1 * v
        v[np.arange(6000) % 20 > 0] = like[np.arange(6000) % 20 > 0]
    v = v.astype(np.float32)
    found = {}
    for r in ann.neighbours(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)]), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    w, hits = v.astype(float), 0
    for q in range(0, 6000, 20):
        s = w @ w[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (300 * 20) >= 0.94


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0] * 8)], [(0, [1.0] * 8), (1, [2.0] * 8)]])
def test_small(spark, rows):
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()]
    assert found == ([(0, 1, 1, 16.0)] if len(rows) == 2 else [])


def test_outlier_gets_all_its_rows(spark):
    rng = np.random.default_rng(5)
    like = np.array([10.0] + [0.0] * 15) + rng.normal(size=(66, 16)) * 0.1
    rows = [(i + 1, x.tolist()) for i, x in enumerate(like)] + [(0, [0.0] * 15 + [10.0])]
    found = ann.neighbours(frame(spark, rows), F.col("vec_id") == 0).collect()
    assert sorted(r.rank for r in found) == list(range(1, 21))
