"""A grid of probes fitted together: all views of a vector and all penalties share each pass over the rows.

A probe is a standardised, class-balanced multinomial logistic regression with an L2 penalty, as `vectors.Probe`. Every
pass evaluates loss and gradient of all probes that still move; tasks add up their own rows, Spark adds up tasks by entry,
and the driver, which holds the coefficients alone, takes a limited-memory quasi-Newton step for each probe.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators.agreement import grouped_scores
from tracelode.operators.tiles import usable

#: Steps whose curvature a descent remembers.
MEMORY = 10


class Descent:
    """Minimises a smooth convex function whose values are asked for one point at a time."""

    def __init__(self, size: int, most: int, tolerance: float):
        self.x, self.most, self.tolerance = np.zeros(size), most, tolerance
        self.value, self.slope, self.rounds, self.converged, self.over = np.inf, np.zeros(size), 0, False, False
        self.way, self.step, self.known = np.zeros(size), 1.0, []

    def asked(self) -> np.ndarray:
        return self.x + self.step * self.way

    def told(self, value: float, slope: np.ndarray) -> None:
        """Takes the point asked for if the value falls far enough; else asks for one at half the step."""
        self.rounds += 1
        if value <= self.value + 1e-4 * self.step * (self.slope @ self.way) or not np.isfinite(self.value):
            moved, turned = self.step * self.way, slope - self.slope
            if np.isfinite(self.value) and moved @ turned > 1e-14:
                self.known = [*self.known, (moved, turned)][-MEMORY:]
            self.x, self.value, self.slope, self.step = self.asked(), value, slope, 1.0
            self.converged = bool(np.abs(slope).max(initial=0.0) <= self.tolerance)
            self.way = -self._curved(slope)
        else:
            self.step /= 2
        self.over = self.converged or self.rounds >= self.most or self.step < 1e-12

    def _curved(self, slope: np.ndarray) -> np.ndarray:
        """The inverse of the remembered curvature times the slope."""
        q, factors = slope.copy(), []
        for moved, turned in reversed(self.known):
            factors.append((moved @ q) / (moved @ turned))
            q -= factors[-1] * turned
        if self.known:
            moved, turned = self.known[-1]
            q *= (moved @ turned) / (turned @ turned)
        for (moved, turned), a in zip(self.known, reversed(factors)):
            q += (a - (turned @ q) / (moved @ turned)) * moved
        return q


@dataclass
class Fit:
    """A probe: its view, penalty, and coefficients (classes x dimensions and one for the intercept) over standardised entries."""

    view: str
    c: float
    most: int
    rounds: int
    converged: bool
    weights: np.ndarray


@dataclass
class Grid:
    """Fitted probes of all views and penalties, and what new rows need: classes, means and deviations."""

    views: dict[str, str]
    label: str
    classes: list
    n: int = 0
    scales: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    fits: list[Fit] = field(default_factory=list)

    def table(self, spark) -> DataFrame:
        """(view, c, most, rounds, converged): a row a probe."""
        return spark.createDataFrame([(f.view, f.c, f.most, f.rounds, f.converged) for f in self.fits], "view string, c double, most bigint, rounds bigint, converged boolean")

    def cells(self, rows: DataFrame, by: Column) -> DataFrame:
        """(view, penalty, by, a, b, k): how many rows of each `by` with label a every probe calls b. Rows as in fit; labels that weren't learned are left out."""
        fits, scales, names, classes = self.fits, self.scales, list(self.views), np.array([str(x) for x in self.classes], dtype=object)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, (code, groups) = batch.column(0).to_numpy(), pd.factorize(batch.column(1).to_pandas())
                for i, name in enumerate(names):
                    z = _standardised(batch.column(2 + i), scales[i])
                    for f in (f for f in fits if f.view == name):
                        said = (z @ f.weights.T).argmax(axis=1)
                        some, k = np.unique(np.stack([code, y, said]), axis=1, return_counts=True)
                        yield pa.RecordBatch.from_pydict({"view": [name] * len(k), "penalty": [f.c] * len(k), "by": groups[some[0]].tolist(), "a": classes[some[1]].tolist(), "b": classes[some[2]].tolist(), "k": k})

        data = _rows(rows, self.views, self.label, self.classes, [len(m) for m, _ in scales], F.coalesce(by.cast("string"), F.lit("")))
        found = data.mapInArrow(run, "view string, penalty double, by string, a string, b string, k bigint")
        return found.groupBy("view", "penalty", "by", "a", "b").agg(F.sum("k").alias("k"))

    def scores(self, rows: DataFrame, by: Column) -> DataFrame:
        """(view, c, by, n, macro_f1, weighted_f1, accuracy)."""
        return grouped_scores(self.cells(rows, by), ["view", "penalty", "by"], times="k").withColumnRenamed("penalty", "c")


def _standardised(column: pa.Array, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows of standardised entries and a one."""
    raw = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(scale[0]))
    return np.concatenate([(raw - scale[0]) / scale[1], np.ones((len(raw), 1))], axis=1)


def _rows(rows: DataFrame, views: dict[str, str], label: str, classes: list, sizes: list[int] | None, by: Column | None = None) -> DataFrame:
    """(y, by, v0, v1, ...): the label's number and the views of rows that have all of them."""
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
    picked = rows.select(number.cast("bigint").alias("y"), (by if by is not None else F.lit("")).alias("by"), *[F.expr(v).cast("array<double>").alias(f"v{i}") for i, v in enumerate(views.values())])
    picked = picked.where(F.col("y") >= 0)
    for i in range(len(views)):
        picked = picked.where(usable(f"v{i}"))
        if sizes:
            picked = picked.where(F.size(f"v{i}") == sizes[i])
    return picked


def fit(rows: DataFrame, views: dict[str, str], label: str, penalties: list[tuple[float, int]], tolerance: float = 1e-6) -> Grid:
    """A probe for each view (name -> SQL of a vector) and each (c, most rounds) of penalties, all over the same rows.

    Rows without a label, or with a view that is null, empty, shorter than the longest or not finite throughout, are left
    out. A dimension without deviation counts as is. Labels are few: classes, coefficients and curvatures are the driver's.
    Without rows there are no probes.
    """
    classes = [r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().sort(label).collect()]
    grid = Grid(views, label, classes)
    if not classes:
        return grid
    data = _rows(rows, views, label, classes, None)
    top = data.agg(*[F.max(F.size(f"v{i}")) for i in range(len(views))]).first()
    if top[0] is None:
        return grid
    sizes = list(top)
    # Cached blocks that are lost with an executor are computed again.
    data = _rows(rows, views, label, classes, sizes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        held = dict(data.groupBy("y").count().collect())
        grid.n = sum(held.values())
        if not grid.n:
            return grid
        grid.scales = [_scale(data, f"v{i}", sizes[i]) for i in range(len(views))]
        weights = np.array([grid.n / (len(held) * held[y]) if y in held else 0.0 for y in range(len(classes))])
        names = [(i, view, c, most) for i, view in enumerate(views) for c, most in penalties]
        moves = [Descent(len(classes) * (sizes[i] + 1), most, tolerance) for i, _, _, most in names]
        while any(not m.over for m in moves):
            open_ = [k for k, m in enumerate(moves) if not m.over]
            points = {k: moves[k].asked().reshape(len(classes), -1) for k in open_}
            sums = _evaluated(data, {k: (names[k][0], w) for k, w in points.items()}, grid.scales, weights)
            for k in open_:
                w = points[k].copy()
                w[:, -1] = 0  # the intercept isn't held down
                hold = 1 / (names[k][2] * grid.n)
                moves[k].told(sums[k][0] / grid.n + hold / 2 * (w * w).sum(), sums[k][1:] / grid.n + hold * w.ravel())
    finally:
        data.unpersist()
    grid.fits = [Fit(view, float(c), most, m.rounds, m.converged, m.x.reshape(len(classes), -1)) for (_, view, c, most), m in zip(names, moves)]
    return grid


def _scale(data: DataFrame, view: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = data.select(F.posexplode(view).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()  # a row a dimension
    mean, deviation = np.zeros(size), np.ones(size)
    for r in found:
        mean[r.i], deviation[r.i] = r.m, r.s or 1.0
    return mean, deviation


def _evaluated(data: DataFrame, points: dict[int, tuple[int, np.ndarray]], scales: list, weights: np.ndarray) -> dict[int, np.ndarray]:
    """The weighted loss and its gradient, in one array, at each point; summed by Spark entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(1 + w.size) for k, (_, w) in points.items()}
        for batch in batches:
            y = batch.column(0).to_numpy()
            at, heavy = np.arange(len(y)), weights[y]
            for i in {i for i, _ in points.values()}:
                z = _standardised(batch.column(2 + i), scales[i])
                for k, (of, w) in points.items():
                    if of != i:
                        continue
                    logits = z @ w.T
                    logits -= logits.max(axis=1, keepdims=True)
                    total = np.log(np.exp(logits).sum(axis=1))
                    sums[k][0] += (heavy * (total - logits[at, y])).sum()
                    off = np.exp(logits - total[:, None])
                    off[at, y] -= 1
                    sums[k][1:] += ((off * heavy[:, None]).T @ z).ravel()
        for k, x in sums.items():
            yield pa.RecordBatch.from_pydict({"k": np.full(len(x), k), "i": np.arange(len(x)), "x": x})

    found = data.mapInArrow(run, "k bigint, i bigint, x double").groupBy("k", "i").agg(F.sum("x").alias("x"))
    out = {k: np.zeros(1 + w.size) for k, (_, w) in points.items()}
    table = found.toPandas()  # as many rows as there are coefficients
    for k, part in table.groupby("k"):
        out[int(k)][part["i"].to_numpy()] = part["x"].to_numpy()
    return out
