"""Embedding whitening: the leading principal components without a covariance matrix, and vectors scaled to unit variance along them.

Vectors are made whole numbers, floor(scale * c), and each distinct one counts once. With V the covariance of those, a
Spark pass takes an orthonormal block Q of `block` columns and returns X'(X Q) over rows centred before they are multiplied;
nothing of the size of dimension squared is made on a worker. The driver orthonormalises by QR and takes Ritz pairs of the subspace
(Rayleigh-Ritz). Blocks of earlier passes stay in the subspace with their products, so each pass adds what the residuals
point to; flat spectra, where plain powers of V take hundreds of passes, need about dimension / block. Passes end when the residual
of each of the k components is under TOLERANCE of the first eigenvalue, or the subspace is the whole space.

Scale: every pass reads the table of distinct vectors once and returns dimension x block sums, added up by Spark. The driver
holds dimension x KEPT numbers; beyond, it restarts from the best Ritz vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm._shared import bound_batches, returned, written

SCALE = 256
BLOCK, TOLERANCE, KEPT, MOST_PASSES = 16, 1e-13, 256, 500
#: Numbers of vectors that a worker turns into doubles at a time.
ROWS = 1 << 18
SEED = 5


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values as doubles (null: NaN), starts and sizes of a list column; size -1 where the list is null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values.cast(pa.float64(), safe=False)
    values = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    return values, offsets[:-1], np.where(np.asarray(column.is_valid()), sizes, -1)


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c) as long; what no long holds is the nearest one."""
    return np.clip(np.floor(values * scale), -(2.0**63), 2.0**63 - 1024).astype(np.int64) + 0


def vectors(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(key, x) of the rows whose vector has entries, all of them finite numbers."""
    spark = rows.sparkSession
    bound_batches(spark)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts, sizes = _lists(batch.column("v"))
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                for some in np.array_split(at, -(-len(at) * size // ROWS)):
                    found = values[starts[some][:, None] + np.arange(size)]
                    fine = np.isfinite(found).all(axis=1)
                    x = pa.array(whole(found[fine], scale).ravel())
                    listed = pa.ListArray.from_arrays(np.arange(0, fine.sum() * size + 1, size, dtype=np.int32), x)
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(some[fine])), listed], ["key", "x"])

    return rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(returned(run), f"key {kind}, x array<bigint>")


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(ROWS // dim, 1)
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, np.asarray(part.column("x").flatten()).reshape(part.num_rows, dim)


def _summed(fit: DataFrame, dim: int, width: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double", tall: int | None = None) -> np.ndarray:
    """The sum of of(x) (tall x width; tall is dim if not given) over blocks x of fit's vectors, added up by row in Spark."""
    tall = tall or dim
    names = [f"c{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _blocks(batch, dim):
                found = of(x)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(tall, dtype=np.int32)), *map(pa.array, total.T)], ["i", *names])

    found = fit.select("x").mapInArrow(returned(run), "i int, " + ", ".join(f"{c} {kind}" for c in names))
    sums = found.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = np.zeros((tall, width), np.int64 if kind == "bigint" else float)
    for row in sums:
        out[row[0]] = row[1:]
    return out


def _against(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what new adds to basis; directions that are noise next to the largest are left out."""
    size = np.linalg.norm(new, axis=0).max(initial=0)
    if not size:
        return new[:, :0]
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
    q, r = np.linalg.qr(new)
    q = q[:, np.abs(np.diag(r)) > 1e-14 * size]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


@dataclass
class Components:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance, its trace, the passes taken and the residuals."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    residuals: np.ndarray


def components(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, trace: float, block: int = BLOCK) -> Components:
    """The k leading eigenpairs of the symmetric matrix that product() multiplies a block with."""
    k, block = min(k, dim), min(block, dim)
    basis, products = np.zeros((dim, 0)), np.zeros((dim, 0))
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, block)))[0]
    for passes in range(1, MOST_PASSES + 1):
        basis, products = np.hstack([basis, q]), np.hstack([products, product(q)])
        small = basis.T @ products
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = basis @ turn, products @ turn
        rest = image - ritz * values
        residuals = np.linalg.norm(rest[:, :k], axis=0)
        if basis.shape[1] >= k and (residuals <= TOLERANCE * max(values[0], 0)).all() or basis.shape[1] >= dim:
            break
        if basis.shape[1] + block > max(KEPT, 4 * block):
            basis, products = ritz[:, : 2 * block], image[:, : 2 * block]
        q = _against(rest[:, :block], basis)[:, : dim - basis.shape[1]]
        if not q.shape[1]:
            break
    else:
        raise ArithmeticError(f"residuals of {residuals.max()} after {MOST_PASSES} passes")
    return Components(np.maximum(values[:k], 0), ritz[:, :k], trace, passes, residuals)


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, residual): a row for each row and component.

    Rows whose vector is null, empty or has a null or non-finite entry are left out, and so are those of another length
    than most distinct vectors have (ties: the longer), which lie in no common space. Components are numbered from 1; vectors of fewer entries than k have as many.
    Each distinct vector counts once in n, means and covariance; repeated rows give repeated results. A component without
    variance has whitened null, and explained is null where nothing varies. deviation is null where no long holds it.
    identity_error is taken over components with variance, null without any. residual is the component's, over the first eigenvalue.
    An empty table gives an empty one. Other columns, whatever their names, are not touched.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, residual double"
    clean = vectors(rows, key, vector, scale)
    fit = written(clean.select("x").distinct(), "vectors")
    sizes = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes
    fit = fit.where(F.size("x") == dim)
    sums = _summed(fit, dim, 1, lambda x: x.sum(axis=0)[:, None], "bigint")[:, 0]
    mean = sums / n

    def product(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return _summed(fit, dim, q.shape[1], of) / n

    trace = float(_summed(fit, dim, 1, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None]).sum()) / n
    found = components(product, dim, k, trace, block)
    # What rounding leaves of a variance of zero is none.
    real = found.values > 1e-12 * max(found.values[0], 0)
    k = len(found.values)
    turn = np.where(real, found.vectors / np.sqrt(np.where(real, found.values, 1)), 0)

    def outer(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    got = _summed(fit, dim, k, outer, tall=k + 1) / n
    error = np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k))[np.ix_(real, real)].max(initial=-1)
    error = None if error < 0 else float(error)
    explained = [float(v / trace) if trace > 0 else None for v in found.values]
    residual = [float(r / found.values[0]) if found.values[0] > 0 else 0.0 for r in found.residuals[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, dim):
                # Doubles tell whether whole numbers fit.
                rough = ((x * float(n) - sums) ** 2).sum(axis=1)
                fits = rough < 9e18
                apart = (x * n - sums) ** 2
                m = len(x)
                w = ((x - mean) @ turn).ravel()
                some = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(some),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        pa.array(np.repeat(apart.sum(axis=1), k), mask=np.repeat(~fits, k)),
                        pa.array(w, mask=np.tile(~real, m)),
                        pa.array(explained * m, pa.float64()),
                        pa.array([error] * (m * k), pa.float64()),
                        pa.array(residual * m, pa.float64()),
                    ],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
                )

    return clean.where(F.size("x") == dim).mapInArrow(returned(run), schema)
