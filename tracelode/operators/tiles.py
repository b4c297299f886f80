"""Cosines within traces by blocked matrix products: a trace is cut into tiles of rows, and each pair of tiles is a task's small group.

A long trace is many pairs of tiles under different keys, so no group grows with a trace; the work, a product for each
pair of rows, is what the question asks for. Each row is sent once for each tile of its trace, so tiles are as large as a task can hold. Similarities count to nine places, so that equal vectors tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators.chunks import positions

#: Rows of a tile where its result is a row a row, and where it may be one for each pair, which bounds what a task holds.
TILE, PAIR_TILE = 8192, 2048
#: Rows of a tile that are multiplied at a time.
BLOCK = 512
PLACES = 9
#: More than rounding to PLACES moves a cosine.
_SLACK = 2 * 10.0**-PLACES


def _units(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that have a direction, at unit length in order of sid, and their sids."""
    if part.empty:
        return np.empty((0, 0)), np.empty(0, np.int64)
    raw, sid = np.stack(part["v"].to_numpy()).astype(np.float64), part["sid"].to_numpy()
    length = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
    order = np.argsort(sid, kind="stable")
    order = order[length[order, 0] > 0]
    return raw[order] / length[order], sid[order]


def _blocks(late: pd.DataFrame, early: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sids of late rows, sids of early rows, cosines by BLOCK late rows), -inf where the other row is not an earlier one; not rounded."""
    (a, sid), (b, before) = _units(late), _units(early)
    if not len(a) or not len(b):
        return
    for k in range(0, len(a), BLOCK):
        cos = a[k : k + BLOCK] @ b.T
        if before[-1] >= sid[k]:  # within one tile; an earlier tile's rows are all earlier
            cos[before[None, :] >= sid[k : k + BLOCK, None]] = -np.inf
        yield sid[k : k + BLOCK], before, cos


def _rounded(cos: np.ndarray) -> np.ndarray:
    return np.round(np.clip(cos, -1.0, 1.0), PLACES) + 0.0


def _frame(late: pd.DataFrame, early: pd.DataFrame, found: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    trace = (late if len(late) else early)["trace"].iloc[:1]
    sid, sim, of = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    return pd.DataFrame({"trace": trace.repeat(len(sid)).to_numpy(), "sid": sid, "sim": sim, "early": of})


def _best(late: pd.DataFrame, early: pd.DataFrame) -> pd.DataFrame:
    found = []
    for sid, before, cos in _blocks(late, early):
        top = cos.max(axis=1)
        some = np.isfinite(top)
        sid, cos, top = sid[some], cos[some], top[some]
        if len(sid):
            sim = _rounded(top)
            # Rounding keeps the order, so only what is within its reach of the highest can be its equal.
            i, j = np.nonzero(cos >= (top - _SLACK)[:, None])
            equal = _rounded(cos[i, j]) == sim[i]
            _, first = np.unique(i[equal], return_index=True)  # the first of equals
            found.append((sid, sim, before[j[equal][first]]))
    return _frame(late, early, found)


def _over(least: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def pairs(late: pd.DataFrame, early: pd.DataFrame) -> pd.DataFrame:
        found = []
        for sid, before, cos in _blocks(late, early):
            i, j = np.nonzero((cos >= least - _SLACK) & (cos > -np.inf))
            sim = _rounded(cos[i, j])
            kept = sim >= least
            found.append((sid[i[kept]], sim[kept], before[j[kept]]))
        return _frame(late, early, found)

    return pairs


def usable(vector: str) -> Column:
    """A vector with entries, all of them finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _tiled(rows: DataFrame, trace: str, sid: str, vector: str, tile: int, of: Callable) -> DataFrame:
    # Floats are moved as such and become doubles in the task that multiplies them.
    kind = "array<float>" if rows.select(vector).dtypes[0][1] == "array<float>" else "array<double>"
    kept = rows.where(usable(vector)).select(F.col(trace).alias("trace"), F.col(sid).cast("bigint").alias("sid"), F.col(vector).cast(kind).alias("v"))
    placed = positions(kept, tile).withColumn("tile", F.floor(F.col("_pos") / tile)).drop("_pos")
    last = placed.groupBy(F.col("trace").alias("of")).agg(F.max("tile").alias("last"))
    late = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tile"))))
    early = placed.join(last, F.col("trace").eqNullSafe(F.col("of"))).drop("of")
    early = early.withColumnRenamed("tile", "other").withColumn("tile", F.explode(F.sequence("other", "last"))).drop("last")
    schema = f"trace {kept.schema['trace'].dataType.simpleString()}, sid bigint, sim double, early bigint"
    # Both sides come from the same rows: toDF gives each columns of its own.
    sides = [side.select("trace", "tile", "other", "sid", "v").toDF("trace", "tile", "other", "sid", "v").groupBy("trace", "tile", "other") for side in (late, early)]
    return sides[0].cogroup(sides[1]).applyInPandas(of, schema)


def best_earlier(rows: DataFrame, trace: str, sid: str, vector: str, tile: int = TILE) -> DataFrame:
    """(trace, sid, sim, early): each vector's most similar earlier one in its trace, the earliest of equals; both null if there is none.

    Rows without a vector, or whose vector has no entry or one that isn't finite, are left out; a vector of zeros stays
    and is similar to none. sid is unique in a trace; all vectors have the same length.
    """
    found = _tiled(rows, trace, sid, vector, tile, _best).groupBy("trace", "sid")
    best = found.agg(F.max("sim").alias("sim"), F.max_by("early", F.struct("sim", -F.col("early"))).alias("early"))
    every = rows.where(usable(vector)).select(F.col(trace).alias("_t"), F.col(sid).cast("bigint").alias("_s"))
    met = every.join(best, F.col("_t").eqNullSafe(F.col("trace")) & (F.col("_s") == F.col("sid")), "left")
    return met.select(F.col("_t").alias("trace"), F.col("_s").alias("sid"), "sim", "early")


def similar_pairs(rows: DataFrame, trace: str, sid: str, vector: str, least: float, tile: int = PAIR_TILE) -> DataFrame:
    """(trace, sid, early, sim): pairs of a row and an earlier one of its trace with a cosine of at least `least`; rows as in best_earlier."""
    return _tiled(rows, trace, sid, vector, tile, _over(least)).select("trace", "sid", "early", "sim")
