"""Bit-sliced whitening against exact sums and plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickwise.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string, x int"


@pytest.mark.parametrize("span, rows", [(1, 1), (2, 63), (300, 64), (700, 1000), (1 << 40, 129), (1 << 63, 70)])
def test_scatter_is_exact(span, rows):
    rnd = random.Random(span + rows)
    x = np.array([[rnd.randrange(-span, span) for _ in range(5)] for _ in range(rows)], np.int64)
    sums, products = whitening.scatter(x)
    assert [int(s) for s in sums] == [sum(int(v) for v in x[:, i]) for i in range(5)]
    for i in range(5):
        for j in range(5):
            assert int(products[i, j]) == sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j]))


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", 7) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def test_whitened_equals_numpy(spark):
    rnd = np.random.default_rng(4)
    base = (rnd.normal(size=(400, 6)) @ rnd.normal(size=(6, 6))).astype(np.float32).tolist()
    bad = [None, [], [None] * 6, [math.nan, *[0.0] * 5], [math.inf, *[0.0] * 5], [1.0, 2.0]]
    vectors = base + base[:1] * 200 + base[5:9] + bad + base[:1]
    got = whitening.whitened(table(spark, vectors)).collect()
    sound = [i for i, v in enumerate(vectors) if v in base]
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c) for i in sound for c in (1, 2, 3, 4)]
    x = {i: np.floor(np.array(vectors[i], np.float32).astype(float) * 256).astype(int) for i in sound}
    fit = np.unique(np.array([*x.values()]), axis=0)
    n, total = len(fit), fit.sum(0)
    y = fit - total / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v.T[::-1]
    by = {(r.vec_id, r.component): r for r in got}
    for i in sound:
        for c in range(4):
            r = by[i, c + 1]
            want = (x[i] - total / n) @ v[c] / math.sqrt(e[c])
            assert abs(abs(r.whitened) - abs(want)) < 1e-9
            assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total))
            assert abs(r.explained - e[c] / e.sum()) < 1e-12 and r.identity_error < 1e-9
    for c in range(1, 5):
        w = np.array([by[i, c].whitened for i in sound])
        want = np.array([(x[i] - total / n) @ v[c - 1] for i in sound])
        assert np.ptp(np.sign(w) * np.sign(want)) == 0  # one sign for all rows


def test_edges(spark):
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, [None, []])).count() == 0
    one = whitening.whitened(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(one) == 6 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in one} == {(None, None, None, 0)}
    flat = whitening.whitened(table(spark, [[float(k), float(2 * k), 1.0] for k in range(9)])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True), (3, True)}
    far = whitening.whitened(table(spark, [[1e30, 1.0], [-1e30, 2.0], [3.0, 4.0]])).collect()
    assert len(far) == 6 and any(r.deviation is None for r in far)
    # A hot copy weighs as one row.
    hot = whitening.whitened(table(spark, [[1.0, 0.0]] * 50 + [[0.0, 1.0], [0.5, 0.25]])).where(F.col("component") == 1).collect()
    assert {r.n for r in hot} == {3} and len(hot) == 52
