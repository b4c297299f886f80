"""Exact quantiles against numpy, with and without ranges."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tracelode.operators.quantiles import quantiles

SHARES = [0.0, 0.25, 0.5, 0.95, 1.0]


def _made():
    rng = random.Random(5)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", 7.0)] * 900 + [("b", rng.random()) for _ in range(300)]
    rows += [(None, float(rng.randrange(40))) for _ in range(700)] + [("c", 1.5), ("d", None), ("e", 2.0), ("e", 3.0), ("f", -0.0), ("f", 0.0)]
    rows += [("g", 4.0)] * 500
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small, ranges", [(10**6, 64), (50, 4), (1, 3), (200, 64)])
def test_against_numpy(spark, small, ranges):
    rows = _made()
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", SHARES, small, ranges).collect()}
    want: dict = {}
    for g, x in rows:
        if x is not None:
            want.setdefault(g, []).append(x)
    assert set(got) == set(want)
    for g, xs in want.items():
        assert (got[g].n, got[g].least, got[g].most) == (len(xs), min(xs), max(xs))
        assert np.allclose(got[g].q, np.quantile(xs, SHARES), rtol=0, atol=1e-12), g


def test_no_key_no_row_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, 3), (2, 9), (3, None)], "n int, k int")
    assert quantiles(rows, [], "k", [0.5]).collect()[0].q == [6.0]
    assert quantiles(rows, [], "k", [0.5], small=1, ranges=2).collect()[0].q == [6.0]
    assert [(r.k, r.q) for r in quantiles(rows.limit(2), ["k"], "n", [0.5]).select("k", "q").sort("k").collect()] == [(3, [1.0]), (9, [2.0])]
    assert quantiles(rows.limit(0), ["n"], "k", [0.5]).collect() == []
