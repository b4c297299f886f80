"""Balanced folds of groups: against dealing by dictionaries, across blocks, and at the edges."""

from __future__ import annotations

import hashlib
import random
import statistics

import pytest

from tracelode.operators.folds import balanced_folds


def _made(groups: int = 120, seed: int = 3):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        odds = [rng.random() ** 3 for _ in range(4)]
        rows += [(g, x) for x in rng.choices("abcd", odds, k=rng.randrange(1, 40))]
    rows += [(7, "d")] * 300  # a group with many rows of one label
    return rows


def _spread(rows, fold_of, folds=5):
    out = []
    for x in sorted({x for _, x in rows}, key=str):
        total = sum(1 for _, y in rows if y == x)
        out.append(statistics.pstdev([sum(1 for g, y in rows if y == x and fold_of[g] == f) / total for f in range(folds)]))
    return statistics.mean(out)


def _by_dictionaries(rows, folds=5):
    names = sorted({x for _, x in rows})
    counts: dict = {}
    for g, x in rows:
        counts.setdefault(g, dict.fromkeys(names, 0))[x] += 1
    total = {x: sum(c[x] for c in counts.values()) for x in names}
    order = sorted(counts, key=lambda g: (-round(statistics.pstdev(counts[g].values()), 9), hashlib.md5(str(g).encode()).hexdigest()))
    held = [dict.fromkeys(names, 0) for _ in range(folds)]
    given = {}
    for g in order:
        def after(f):
            spread = [statistics.pstdev([(held[k][x] + (counts[g][x] if k == f else 0)) / total[x] for k in range(folds)]) for x in names]
            return round(statistics.mean(spread), 9), sum(held[f].values()), f

        given[g] = min(range(folds), key=after)
        for x in names:
            held[given[g]][x] += counts[g][x]
    return given


def _folds(spark, rows, **how):
    frame = spark.createDataFrame(rows, "g bigint, l string").repartition(3)
    return {r.g: r.fold for r in balanced_folds(frame, "g", "l", **how).collect()}


def test_equals_dealing_by_dictionaries(spark):
    rows = _made()
    assert _folds(spark, rows) == _by_dictionaries(rows)


def test_blocks_stay_level(spark):
    rows = _made(600, 9)
    one, many = _folds(spark, rows), _folds(spark, rows, block=8)
    assert set(many) == set(one) and set(many.values()) == set(range(5))
    rng = random.Random(1)
    by_lot = _spread(rows, {g: rng.randrange(5) for g in one})
    assert _spread(rows, one) <= _spread(rows, many) < by_lot / 2
    assert _folds(spark, rows, block=8) == many


@pytest.mark.parametrize("rows", [[], [(None, "a")], [(1, None)], [(1, None), (2, "a"), (2, "a")]])
def test_edges(spark, rows):
    assert set(_folds(spark, rows)) == {g for g, _ in rows if g is not None}
