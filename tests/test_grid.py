"""The grid of probes: each at its gradient's zero, scores and edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import grid as P

PENALTIES = [(0.01, 200), (1.0, 200), (10.0, 300)]
VIEWS = {"all": "v", "half": "slice(v, 1, 2)"}


def _made(n: int = 400, seed: int = 2):
    rng = np.random.default_rng(seed)
    y = rng.choice(3, n, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(n, 4)) * [1, 5, 0.1, 1] + np.array([[0, 0, 0, 0], [1, 3, 0, 0], [0, 0, 0.1, 2]])[y]
    x[:, 3] = x[:, 3] * 0 + 2.5 if seed == 9 else x[:, 3]
    return y, x


def _frame(spark, y, x):
    return spark.createDataFrame([("xyz"[a], [float(b) for b in row]) for a, row in zip(y, x)], "label string, v array<double>").repartition(5)


def _slope(y, x, weights, c):
    """Gradient by plain numpy over the whole table."""
    n, sd = len(y), x.std(axis=0)
    z = np.concatenate([(x - x.mean(axis=0)) / np.where(sd > 1e-12, sd, 1), np.ones((n, 1))], axis=1)
    p = np.exp(z @ weights.T)
    p = p / p.sum(axis=1, keepdims=True) - np.eye(len(weights))[y]
    heavy = n / (len(weights) * np.bincount(y))[y]
    held = weights.copy()
    held[:, -1] = 0
    return (p * heavy[:, None]).T @ z / n + held / (c * n)


@pytest.mark.parametrize("seed", [2, 9])
def test_every_probe_ends_at_its_gradients_zero(spark, seed):
    y, x = _made(seed=seed)
    grid = P.fit(_frame(spark, y, x), VIEWS, "label", PENALTIES)
    assert [(f.view, f.c) for f in grid.fits] == [(v, c) for v in VIEWS for c, _ in PENALTIES]
    for f in grid.fits:
        assert f.converged and f.rounds < f.most
        assert np.abs(_slope(y, x if f.view == "all" else x[:, :2], f.weights, f.c)).max() < 2e-6


def test_bound_on_rounds_and_scores(spark):
    y, x = _made()
    rows = _frame(spark, y, x)
    grid = P.fit(rows, VIEWS, "label", [(1.0, 3)])
    assert all(f.rounds == 3 and not f.converged for f in grid.fits) and grid.table(spark).count() == 2
    grid = P.fit(rows, VIEWS, "label", [(1.0, 200)])
    got = {(r.view, r.by): r for r in grid.scores(rows.withColumn("part", F.when(F.col("v")[0] > 0, "up")), F.col("part")).collect()}
    w = grid.fits[0].weights
    z = np.concatenate([(x - x.mean(axis=0)) / x.std(axis=0), np.ones((len(x), 1))], axis=1)
    right = (z @ w.T).argmax(axis=1) == y
    for name, of in (("up", x[:, 0] > 0), ("", x[:, 0] <= 0)):
        assert got[("all", name)].n == of.sum() and abs(got[("all", name)].accuracy - right[of].mean()) < 1e-12


def test_rows_left_out_one_class_and_no_rows(spark):
    y, x = _made(60)
    good = _frame(spark, y, x)
    bad = spark.createDataFrame([(None, [1.0] * 4), ("x", None), ("x", []), ("x", [1.0, None, 1.0, 1.0]), ("y", [float("nan")] * 4), ("y", [1.0, 2.0])], "label string, v array<double>")
    one, two = P.fit(good, VIEWS, "label", [(1.0, 200)]), P.fit(good.unionAll(bad), VIEWS, "label", [(1.0, 200)])
    assert two.n == 60 and all(np.allclose(a.weights, b.weights, atol=1e-4) for a, b in zip(one.fits, two.fits))
    alone = P.fit(good.where("label = 'x'"), VIEWS, "label", [(1.0, 200)])
    assert all(f.converged for f in alone.fits)
    assert P.fit(good.limit(0), VIEWS, "label", PENALTIES).fits == [] and P.fit(bad.where("label IS NULL OR v IS NULL OR size(v) = 0"), VIEWS, "label", PENALTIES).fits == []
