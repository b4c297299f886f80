"""Traces in chunks and tiles against the one-window forms and plain numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import chunks, tiles
from tracelode.operators import sequence as Q
from tracelode.plans.facts import LABELS

ROWS = "trace bigint, sid bigint, label string, status string, judgement string, antecedent bigint"


def _rows(spark, sizes: list[int], step: int = 1):
    rng = random.Random(11)
    made = []
    for trace, size in enumerate(sizes):
        label = "ORIENT"
        for k in range(size):
            label = label if rng.random() < 0.45 else rng.choice(LABELS)
            status = rng.choice(["novel", "revised", "repeated"]) if label == "HYPO" else None
            judged = rng.choice(["accept", "reject", "uncertain"]) if label == "JUDGE" else None
            made.append((trace or None, k * step, label, status, judged, rng.randrange(k + 1) * step if status == "revised" else None))
    return spark.createDataFrame(made, ROWS)


def _set(frame) -> list:
    return sorted((tuple(map(repr, r)) for r in frame.collect()))


@pytest.mark.parametrize("step", [1, 3])
def test_positions_with_gaps_and_a_null_trace(spark, step):
    got = chunks.positions(_rows(spark, [130, 1, 64], step), 16).select("trace", "sid", "_pos").collect()
    assert len(got) == 195 and all(r._pos * step == r.sid for r in got)


@pytest.mark.parametrize(("size", "step"), [(50, 1), (64, 1), (64, 2), (4096, 1)])
def test_dependencies_in_chunks(spark, size, step):
    rows = _rows(spark, [330, 1, 51, 128], step)
    got = chunks.dependencies(rows, size=size, dense=step == 1)
    assert got.columns == Q.dependencies(rows).columns
    assert _set(got) == _set(Q.dependencies(rows))


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_runs_in_chunks(spark, size):
    rows = _rows(spark, [200, 1, 33])
    same = spark.createDataFrame([(9, k, "TEST", None, None, None) for k in range(70)], ROWS)  # one run through many chunks
    both = rows.unionByName(same)
    for least in (1, 3):
        assert _set(chunks.runs(both, least, size)) == _set(Q.runs(both, least))
    assert _set(chunks.longest_run(both, size)) == _set(Q.longest_run(both))


@pytest.mark.parametrize("size", [3, 5, 64])
def test_repeated_grams_in_chunks(spark, size):
    rows = _rows(spark, [200, 1, 3, 4, 33])
    assert _set(chunks.repetition_ratio(rows, 4, size)) == _set(Q.repetition_ratio(rows, 4))
    assert _set(chunks.repetition_ratio(rows, 2, size, True)) == _set(Q.repetition_ratio(rows, 2))


def test_no_rows(spark):
    none = _rows(spark, [5]).where("false")
    assert chunks.dependencies(none).count() == chunks.runs(none).count() == chunks.repetition_ratio(none).count() == 0


def test_a_hot_trace_is_many_tasks(spark):
    """One trace of 1,000,000 rows: no task of the windows has more than a few chunks of it."""
    labels = F.element_at(F.array(*map(F.lit, LABELS)), (F.xxhash64("id") % 9 + 9).cast("int") % 9 + 1)
    rows = spark.range(1_000_000).select(F.lit(7).cast("bigint").alias("trace"), F.col("id").alias("sid"), labels.alias("label"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("judgement"), F.lit(None).cast("bigint").alias("antecedent"))
    found = chunks.dependencies(rows, dense=True).withColumn("task", F.spark_partition_id())
    spread = found.groupBy("task").agg(F.count("*").alias("n"), F.sum(F.size("depends_on")).alias("d")).collect()
    assert sum(r.n for r in spread) == 1_000_000 and len(spread) > 1 and max(r.n for r in spread) < 500_000
    assert sum(r.length for r in chunks.runs(rows, 1).groupBy().agg(F.sum("length").alias("length")).collect()) == 1_000_000


def test_cosines_by_tiles(spark):
    rng = np.random.default_rng(5)
    made = []
    for trace, size in ((1, 40), (2, 1), (None, 23)):
        for k in range(size):
            v = rng.normal(size=6)
            made.append((trace, 2 * k, [float(x) for x in v]))
    made[7] = (1, 14, made[3][2])  # equal vectors: the earliest wins
    made[9] = (1, 18, [2 * x for x in made[3][2]])
    made[11] = (1, 22, [0.0] * 6)
    made += [(1, 901, None), (1, 902, [float("nan")] * 6), (1, 903, []), (1, 904, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1, 905, [float("inf")] * 6)]
    rows = spark.createDataFrame(made, "g bigint, k bigint, v array<double>")
    kept = [(t, k, np.array(v)) for t, k, v in made if v and all(x is not None and np.isfinite(x) for x in v)]
    wanted, pairs = {}, {}
    for t, k, v in kept:
        sims = [(round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 9), -j) for u, j, w in kept if u == t and j < k and v.any() and w.any()]
        wanted[t, k] = max(sims) if sims else None
        pairs |= {(t, k, -j): s for s, j in sims if s >= 0.25}
    for tile in (1, 7, 512):
        got = {(r.trace, r.sid): None if r.sim is None else (r.sim, -r.early) for r in tiles.best_earlier(rows, "g", "k", "v", tile).collect()}
        assert got.keys() == wanted.keys()
        for key, found in got.items():
            assert (found is None) == (wanted[key] is None) and (found is None or found[1] == wanted[key][1] and abs(found[0] - wanted[key][0]) < 2e-9), key
        seen = {(r.trace, r.sid, r.early): r.sim for r in tiles.similar_pairs(rows, "g", "k", "v", 0.25, tile).collect()}
        assert seen.keys() == pairs.keys()
    assert tiles.best_earlier(rows.where("false"), "g", "k", "v").count() == 0


def test_rows_of_a_trace_are_sent_a_few_times(spark):
    import pandas as pd

    rows = spark.range(3000).select(F.lit(1).alias("g"), F.col("id").alias("k"), F.array(F.sin("id").cast("float"), F.lit(1.0).cast("float")).alias("v"))
    counted = lambda late, early: pd.DataFrame({"trace": [1], "sid": [len(late)], "sim": [0.0], "early": [len(early)]})
    for tile in (tiles.similar_pairs.__defaults__[-1], tiles.best_earlier.__defaults__[-1]):
        met = tiles._tiled(rows, "g", "k", "v", tile, counted).collect()
        assert sum(r.sid + r.early for r in met) <= 3 * 3000
    import inspect

    from tracelode.plans import long

    assert "TILE" not in inspect.getsource(long)


@pytest.mark.parametrize("tile", [7, 64, 1000])
def test_copies_and_near_ties_in_blocks(spark, monkeypatch, tile):
    """Copies tie, and cosines that differ by less than nine places do; the earliest counts, in a block or beyond."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6))
    vectors = np.concatenate([base, base, base * 3.0, base + 1e-12, np.zeros((2, 6)), rng.normal(size=(60, 6))])
    rows = spark.createDataFrame([(None if k % 5 == 0 else k % 5, k, v.tolist()) for k, v in enumerate(vectors)], "g int, k bigint, v array<double>")
    best = {(r.trace, r.sid): (r.sim, r.early) for r in tiles.best_earlier(rows, "g", "k", "v", tile).collect()}
    pairs = {(r.trace, r.sid, r.early): r.sim for r in tiles.similar_pairs(rows, "g", "k", "v", 0.25, tile).collect()}
    unit = [v / np.linalg.norm(v) if v.any() else None for v in vectors]
    want_best, want_pairs = {}, {}
    for k, v in enumerate(unit):
        g = None if k % 5 == 0 else k % 5
        sims = [(round(float(np.clip(v @ unit[j], -1, 1)), 9), -j) for j in range(k % 5, k, 5) if v is not None and unit[j] is not None]
        want_best[g, k] = (max(sims)[0], -max(sims)[1]) if sims else (None, None)
        want_pairs |= {(g, k, -j): c for c, j in sims if c >= 0.25}
    assert best.keys() == want_best.keys() and pairs.keys() == want_pairs.keys()
    assert all(best[k][1] == w[1] and (w[0] is None or abs(best[k][0] - w[0]) < 2e-9) for k, w in want_best.items())
    assert all(abs(pairs[k] - w) < 2e-9 for k, w in want_pairs.items())
