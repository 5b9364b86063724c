"""Whitening of vectors by the leading components of their covariance, found by LOBPCG (Knyazev, 2001).

The covariance is never formed. What Spark computes is its product with a block of directions: each task sums C'(C Y) over its
centred rows C, and the tasks' small sums are added up in two steps. The driver holds blocks of (dimensions x components) alone: it takes
the Rayleigh-Ritz vectors of the block, its residuals and its previous directions, and asks for the product of the new residuals, until
the residuals of a product computed afresh are certified. A last pass measures the covariance of the whitened rows.

Entries are fixed-point integers, so sums are exact and the same in any order; n * x - S is exact before it is divided.

Defined results: a vector that is null, or holds a null, not a finite number or a number whose fixed-point value is beyond LARGEST, takes no
part; nor does one shorter than the longest. A null key and repeated rows take part, each by itself. Components whose eigenvalue is
not above RANK times the trace have no scale and are left out, so equal vectors alone give no rows, as does an empty table. A deviation
that a long can't hold is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Fixed-point numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 50
#: Directions beyond the wanted ones; they only speed up convergence.
GUARDS = 8
#: Residuals, in parts of the greatest eigenvalue: certified below GOAL, an error if passes end above ENOUGH.
GOAL, ENOUGH = 1e-12, 1e-7
PASSES = 400
#: A product is computed afresh after so many updates of it.
AFRESH = 20
RANK = 1e-12
#: Tasks that add up the sums of others.
SUMMERS = 16
#: Vectors that a worker holds at a time.
ROWS = 2048


@dataclass
class Components:
    """n, sums S, and the leading components: values (falling), vectors (a column each), trace, and the largest certified residual in parts of the first value."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def fixed_points(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key and x, the entries as integers, of the rows that take part; written, for every pass reads it."""
    entry: Callable[[Column], Column] = lambda c: F.floor(c.cast("double") * SCALE)
    fits = lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < float(LARGEST), F.lit(False))  # noqa: E731  NaN is greater than any number
    v = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).filter(F.col("v").isNotNull() & F.forall("v", fits))
    rows = cut(v.select("key", F.transform("v", lambda c: (entry(c) + SHIFT).cast("long")).alias("x")))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return rows.filter((F.size("x") == longest) & (F.size("x") > 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The rows x as one matrix."""
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy().reshape(len(x), -1)


def _added(rows: DataFrame, shape: tuple[int, ...], kind: type, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows x of part(matrix of rows), which has a fixed shape."""
    small_batches(rows.sparkSession, ROWS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for b in batches:
            if len(b):
                total += part(_matrix(b))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for b in batches:
            for s in b.column(0):
                total += np.frombuffer(s.as_py(), kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    done = rows.select("x").mapInArrow(sums, "s binary").repartition(SUMMERS).mapInArrow(again, "s binary")
    return np.sum([np.frombuffer(r.s, kind).reshape(shape) for r in done.collect()], axis=0)  # at most SUMMERS


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, where n * x - S is exact."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        return (n * x - sums.astype(np.int64)) / n
    return ((n * x.astype(object) - sums) / n).astype(float)


def _sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """n, and S as exact integers, summed in two halves so that no sum overflows."""
    first = rows.select(F.size("x").alias("d")).limit(1).first()
    if first is None:
        return 0, np.zeros(0, object)
    got = _added(rows, (3, first.d), np.int64, lambda x: np.stack([(x >> 20).sum(0), (x & 0xFFFFF).sum(0), np.full(first.d, len(x))]))
    return int(got[2, 0]), got[0].astype(object) * (1 << 20) + got[1].astype(object)


def _orthonormal(new: np.ndarray, against: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """An orthonormal basis of what the columns of new add to an orthonormal block; columns that add nothing are dropped."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), 1e-300)
    for _ in range(2):
        new = new - against @ (against.T @ new)
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    new = u[:, s > least]
    new = new - against @ (against.T @ new)
    return np.linalg.qr(new)[0] if new.shape[1] else new


def fit_components(rows: DataFrame, components: int = 32, seed: int = 7) -> Components:
    """The leading eigenvectors of the covariance (divisor n) of rows, as fixed_points() gives them."""
    n, sums = _sums(rows)
    d = len(sums)
    if not n:
        return Components(0, sums, np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0)
    count, width = min(components, d), min(components + GUARDS, d)
    passes = 0

    def product(y: np.ndarray) -> tuple[np.ndarray, float]:
        """V y, and the trace of V, in one pass over the rows."""
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return np.append((c.T @ (c @ y)).ravel(), (c * c).sum())

        got = _added(rows, (d * y.shape[1] + 1,), np.float64, part) / n
        return got[:-1].reshape(d, -1), float(got[-1])

    y = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    ay, trace = product(y)
    p = ap = np.zeros((d, 0))
    fresh, last = True, np.inf
    while True:
        # Rayleigh-Ritz within the iterate alone, so that the residuals are those of its best vectors
        values, turn = np.linalg.eigh((y.T @ ay + ay.T @ y) / 2)
        turn = turn[:, ::-1]
        y, ay, values = y @ turn, ay @ turn, values[::-1]
        residuals = ay - y * values
        scale = max(float(values[0]), 1e-300)
        worst = float(np.linalg.norm(residuals[:, :count], axis=0).max()) / scale
        if trace <= 0 or fresh and (worst <= GOAL or worst <= ENOUGH and worst > 0.5 * last):
            break
        if passes >= PASSES:
            raise RuntimeError(f"residuals of {worst:.1e} after {passes} passes")
        if not fresh and (worst <= GOAL or passes % AFRESH == 0):
            ay, _ = product(y)
            fresh = True
            continue
        if fresh:
            last = worst
        w = _orthonormal(residuals, np.hstack([y, p]))
        if not w.shape[1] and not p.shape[1]:
            break
        aw = product(w)[0] if w.shape[1] else w
        basis, image = np.hstack([y, p, w]), np.hstack([ay, ap, aw])
        _, best = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        best = best[:, ::-1][:, :width]
        # the part of the new block outside the old iterate is the next previous direction
        outside = best.copy()
        outside[:width] = 0
        turned = _orthonormal(outside, best)
        p, ap = basis @ turned, image @ turned
        y, ay = basis @ best, image @ best
        y, r = np.linalg.qr(y)
        ay = np.linalg.solve(r.T, ay.T).T
        fresh = False
    there = values[:count] > RANK * max(trace, 1e-300)
    return Components(n, sums, values[:count][there], y[:, :count][:, there], trace, worst, passes)


def _whitened(x: np.ndarray, c: Components) -> np.ndarray:
    return (_centred(x, c.n, c.sums) @ c.vectors) / np.sqrt(c.values)


def identity_error(rows: DataFrame, c: Components) -> float:
    """The largest absolute entry of the whitened rows' covariance, centred, minus the identity; measured over all rows."""
    k = len(c.values)
    if not k:
        return 0.0
    # whitened rows have mean 0 up to rounding; their own mean is taken out first all the same
    mean = _added(rows, (k,), np.float64, lambda x: _whitened(x, c).sum(0)) / c.n

    def part(x: np.ndarray) -> np.ndarray:
        w = _whitened(x, c) - mean
        return w.T @ w

    return float(np.abs(_added(rows, (k, k), np.float64, part) / c.n - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sums of (n * x - S)^2 as exact longs; null where a long can't hold it."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        d = n * x - sums.astype(np.int64)
        if int(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return pa.array((d * d).sum(1))
        d = d.astype(object)
    else:
        d = n * x.astype(object) - sums
    return pa.array([int(s) if s < 1 << 63 else None for s in (d * d).sum(1)], pa.int64())


def whiten(rows: DataFrame, c: Components, key: str = "vec_id") -> DataFrame:
    """A row for each vector and component: key, component from 1, n, deviation, whitened, explained."""
    small_batches(rows.sparkSession, ROWS)
    k, share = len(c.values), c.values / c.trace if c.trace else c.values
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b) and k:
                x, m = _matrix(b), len(b)
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [b.column("key").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, c.n)), _deviations(x, c.n, c.sums).take(each), pa.array(_whitened(x, c).ravel()), pa.array(np.tile(share, m))]
                yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double")
