"""Linear regression: the normal equations are one aggregation, whatever the number of rows; the rest is small algebra.

Squaring the columns' condition costs half of the digits, so near-dependent columns are fitted from a QR factor instead: each task
reduces its rows to a small triangle by Householder reflections, and triangles are merged like rows (a tall-skinny QR).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import f_pq, student_pq, student_quantile
from ..sources.folders import cut
from .joins import join_groups


@dataclass(frozen=True)
class Fit:
    names: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    t: np.ndarray
    p: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: int
    r2: float
    adjusted: float
    sigma: float
    f: float
    f_p: float
    vif: np.ndarray
    inverse: np.ndarray

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        terms = [F.lit(float(c)) if n == "(intercept)" else F.col(n) * float(c) for n, c in zip(self.names, self.coefficients, strict=True)]
        return df.withColumn(name, sum(terms[1:], terms[0]))

    def half_width(self, x: list[float], level: float = 0.95, new: bool = True) -> float:
        """Half width of the interval of the mean, or of a new observation, at x."""
        v = np.array(([1.0] if self.names[0] == "(intercept)" else []) + x)
        spread = self.sigma * np.sqrt(v @ self.inverse @ v + (1 if new else 0))
        return float(student_quantile(np.array([(1 + level) / 2]), np.array([self.n - len(v)]))[0] * spread)


def moments(df: DataFrame, y: str, x: list[str]) -> tuple[int, np.ndarray]:
    """Row count and the cross products of (1, x..., y) over complete rows, centred first at their means for accuracy."""
    names = [*x, y]
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]).dropna()
    k = len(names)
    pairs = [F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]
    r = rows.agg(F.count("*").alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(k)], *pairs).first()
    n, m = r["n"], np.array([r[f"m{i}"] for i in range(k)], float)
    c = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            c[i, j] = c[j, i] = r[f"c{i}_{j}"] * n
    full = np.zeros((k + 1, k + 1))
    full[0, 0], full[0, 1:], full[1:, 0] = n, n * m, n * m
    full[1:, 1:] = c + n * np.outer(m, m)
    return n, full


def solve(n: int, full: np.ndarray, names: list[str], chosen: list[int], intercept: bool = True, level: float = 0.95) -> Fit:
    """A fit of the chosen columns from the one matrix of moments."""
    at = ([0] if intercept else []) + [c + 1 for c in chosen]
    a, b, yy = full[np.ix_(at, at)], full[at, -1], full[-1, -1]
    scale = np.sqrt(np.diag(a))
    if np.linalg.cond(a / np.outer(scale, scale)) > 1e14:
        raise ValueError("the regressors are linearly dependent")
    inverse = np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ b
    sse = max(yy - beta @ b, 0.0)
    sst = yy - (full[0, -1] ** 2 / n if intercept else 0.0)
    dof, k = n - len(at), len(at) - intercept
    sigma = np.sqrt(sse / dof)
    errors = sigma * np.sqrt(np.diag(inverse))
    t = beta / errors
    half = student_quantile(np.array([(1 + level) / 2]), np.array([float(dof)]))[0] * errors
    f = (sst - sse) / max(k, 1) / (sse / dof) if k else np.nan
    inner = full[np.ix_([c + 1 for c in chosen], [c + 1 for c in chosen])] - np.outer(full[0, [c + 1 for c in chosen]], full[0, [c + 1 for c in chosen]]) / n
    s = np.sqrt(np.diag(inner))
    vif = np.diag(np.linalg.inv(inner / np.outer(s, s))) if len(chosen) else np.zeros(0)
    return Fit(
        (["(intercept)"] if intercept else []) + [names[c] for c in chosen], beta, errors, t, 2 * student_pq(np.abs(t), float(dof))[1], beta - half, beta + half, n, float(1 - sse / sst), float(1 - (sse / dof) / (sst / (n - intercept))), float(sigma), float(f), float(f_pq(f, float(k), float(dof))[1]) if k else float("nan"), vif, inverse,
    )


#: Tasks that merge the triangles of others; condition of the scaled normal equations from which a QR factor is used.
MERGERS, ILL = 16, 1e8
#: A column whose part beyond the earlier ones is below this, in parts of its length, depends on them.
DEPENDENT = 1e-11


def qr_factor(df: DataFrame, columns: list[str], intercept: bool = True) -> tuple[int, np.ndarray]:
    """Rows that are complete, and the triangle R of (1, columns...) over them, of fixed size whatever the rows."""
    k = len(columns) + intercept
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).dropna()

    def merged(parts: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, k))
        for part in parts:
            r = np.linalg.qr(np.vstack([r, part]), mode="r")
        return r

    def out(n: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["n", "r"])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def parts() -> Iterator[np.ndarray]:
            nonlocal n
            for b in batches:
                n += len(b)
                yield np.stack([*([np.ones(len(b))] if intercept else []), *[c.to_numpy(zero_copy_only=False) for c in b.columns]], axis=1)

        r = merged(parts())
        yield out(n, r)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for b in batches for x in b.to_pylist()]  # small triangles
        yield out(sum(x["n"] for x in found), merged(np.frombuffer(x["r"]).reshape(-1, k) for x in found))

    done = rows.mapInArrow(reduced, "n long, r binary").repartition(MERGERS).mapInArrow(again, "n long, r binary").collect()
    return sum(x.n for x in done), merged(np.frombuffer(x.r).reshape(-1, k) for x in done)


def qr_fit(df: DataFrame, y: str, x: list[str], intercept: bool = True, level: float = 0.95) -> Fit:
    """Least squares from the triangle of (1, x..., y). Raises an error where there are fewer rows than columns or a column depends on the others."""
    n, r = qr_factor(df, [*x, y], intercept)
    p = len(x) + intercept
    if n < p or len(r) < p:
        raise ValueError("there are fewer rows than coefficients")
    r = np.vstack([r, np.zeros((p + 1 - len(r), p + 1))]) if len(r) <= p else r
    lengths = np.linalg.norm(r[:p, :p], axis=0)
    if (np.abs(np.diag(r)[:p]) <= DEPENDENT * np.maximum(lengths, 1e-300)).any():
        raise ValueError("the regressors are linearly dependent")
    inner = np.linalg.inv(r[:p, :p] / lengths) / lengths[:, None]
    beta = np.linalg.solve(r[:p, :p] / lengths, r[:p, p]) / lengths
    inverse = inner @ inner.T
    sse, sst = float(r[p, p] ** 2), float((r[int(intercept) :, p] ** 2).sum())
    dof, k = n - p, len(x)
    sigma = np.sqrt(sse / dof) if dof else np.nan
    errors = sigma * np.sqrt(np.diag(inverse))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / errors
        f = (sst - sse) / max(k, 1) / (sse / dof) if k and dof and sse else np.nan
    half = student_quantile(np.array([(1 + level) / 2]), np.array([float(dof)]))[0] * errors if dof else np.full(p, np.nan)
    spread = (r[int(intercept) : p, int(intercept) : p] ** 2).sum(axis=0)
    return Fit(
        (["(intercept)"] if intercept else []) + x, beta, errors, t, 2 * student_pq(np.abs(t), float(dof))[1] if dof else t, beta - half, beta + half, n, 1 - sse / sst if sst else np.nan, 1 - (sse / dof) / (sst / (n - intercept)) if dof and sst else np.nan, float(sigma), float(f), float(f_pq(f, float(k), float(dof))[1]) if np.isfinite(f) else float("nan"), spread * np.diag(inverse)[int(intercept) :], inverse,
    )


def ols(df: DataFrame, y: str, x: list[str], intercept: bool = True, level: float = 0.95) -> Fit:
    """From the normal equations, or from a QR factor where their columns nearly depend on each other."""
    n, full = moments(df, y, x)
    at = [*range(0 if intercept else 1, len(x) + 1)]
    scale = np.sqrt(np.diag(full)[at])
    a = full[np.ix_(at, at)] / np.outer(scale, scale) if (scale > 0).all() else None
    if a is None or np.linalg.cond(a) > ILL:
        return qr_fit(df, y, x, intercept, level)
    return solve(n, full, x, [*range(len(x))], intercept, level)


def stepwise(df: DataFrame, y: str, x: list[str], enter: float = 0.05, remove: float = 0.1) -> Fit:
    """Adds the regressor of least p below `enter`, drops that of largest p above `remove`; all steps share one pass over the data.

    If none enters, the fit is that of the intercept alone.
    """
    n, full = moments(df, y, x)
    chosen: list[int] = []
    for _ in range(4 * len(x) + 4):
        rest = [c for c in range(len(x)) if c not in chosen]
        tried = sorted((float(solve(n, full, x, [*chosen, c]).p[-1]), c) for c in rest)
        moved = bool(tried) and tried[0][0] < enter
        if moved:
            chosen.append(tried[0][1])
        p = solve(n, full, x, chosen).p[1:] if chosen else np.zeros(0)
        if len(p) and p.max() > remove:
            chosen.pop(int(p.argmax()))
            moved = True
        if not moved:
            break
    return solve(n, full, x, chosen)


def durbin_watson(df: DataFrame, residual: str, t: str, by: list[str]) -> DataFrame:
    """dw of each group's residuals in the order of t: rows are sorted by ranges of (by, t), and the last residual of a range goes before the next one's first.

    So one group of all rows is spread over the ranges. Rows without a residual are left out; a null group is a group.
    """
    rows = df.filter(F.col(residual).isNotNull()).select(*by, F.col(t).alias("__t"), F.col(residual).cast("double").alias("__e"))
    dealt = cut(rows.repartitionByRange(*by, "__t").withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "__part").orderBy("__t")
    ends = dealt.groupBy(*by, "__part").agg(F.max_by("__e", "__t").alias("__last"))
    before = ends.select(*by, "__part", F.lag("__last").over(Window.partitionBy(*by).orderBy("__part")).alias("__before"))  # a row for each range
    step = F.col("__e") - F.coalesce(F.lag("__e").over(inside), F.col("__before"))
    stepped = join_groups(dealt, before, [*by, "__part"]).withColumn("__d", step)
    return stepped.groupBy(*by).agg((F.sum(F.col("__d") * F.col("__d")) / F.sum(F.col("__e") * F.col("__e"))).alias("dw"))


def table(spark, fit: Fit) -> DataFrame:
    """term, coefficient, error, t, p, low, high."""
    rows = [tuple([n, *map(float, v)]) for n, *v in zip(fit.names, fit.coefficients, fit.errors, fit.t, fit.p, fit.low, fit.high, strict=True)]
    return spark.createDataFrame(rows, "term string, coefficient double, error double, t double, p double, low double, high double")
