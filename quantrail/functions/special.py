"""Special functions in numpy, and columns of them by Arrow batches.

Incomplete gamma and beta functions by series and continued fractions (Press et al.), each with its complement; their inverses
by Chandrupatla's bracketed interpolation. All are vectorised.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
erf = np.vectorize(math.erf, otypes=[float])
erfc = np.vectorize(math.erfc, otypes=[float])
Pair = tuple[np.ndarray, np.ndarray]


def lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    if x.size > 1 and (x == x.flat[0]).all():  # a parameter
        return np.full(x.shape, math.lgamma(x.flat[0]))
    return _lgamma(x)


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(np.add(a, b))


def log_factorial(n: np.ndarray) -> np.ndarray:
    return lgamma(np.add(n, 1.0))


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_factorial(n) - log_factorial(k) - log_factorial(np.subtract(n, k))


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 10, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros(x.shape)
    for _ in range(10):
        low = x < 10
        out = out - np.where(low, 1 / x, 0.0)
        x = np.where(low, x + 1, x)
    z = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros(x.shape)
    for _ in range(10):
        low = x < 10
        out = out + np.where(low, 1 / (x * x), 0.0)
        x = np.where(low, x + 1, x)
    z = 1 / (x * x)
    return out + 1 / x + z / 2 + z / x * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z * (1 / 30 - z * 5 / 66))))


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(x, float) / math.sqrt(2))


def gamma_pq(a: np.ndarray, x: np.ndarray) -> Pair:
    """Regularised lower and upper incomplete gamma functions."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    x = np.maximum(x, 0.0)
    p, q = np.zeros(a.shape), np.ones(a.shape)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - lgamma(a))
        low = (x < a + 1) & (x > 0)
        if low.any():
            al, xl = a[low], x[low]
            term, total, k = 1 / al, 1 / al, al.copy()
            while True:
                k = k + 1
                term = term * xl / k
                total = total + term
                if (np.abs(term) <= np.abs(total) * 1e-17).all():
                    break
            p[low] = np.minimum(total * front[low], 1.0)
            q[low] = 1 - p[low]
        high = (x >= a + 1) & np.isfinite(x)
        if high.any():
            al, xl = a[high], x[high]
            b = xl + 1 - al
            c, d = np.full(al.shape, 1e300), 1 / b
            h = d.copy()
            i = 0
            while True:
                i += 1
                an = -i * (i - al)
                b = b + 2
                d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
                c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
                h = h * d * c
                if (np.abs(d * c - 1) < 1e-15).all():
                    break
            q[high] = np.clip(front[high] * h, 0, 1)
            p[high] = 1 - q[high]
        p, q = np.where(np.isposinf(x), 1.0, p), np.where(np.isposinf(x), 0.0, q)
    return p, q


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return gamma_pq(a, x)[0]


def beta_pq(x: np.ndarray, a: np.ndarray, b: np.ndarray, rest: np.ndarray | None = None) -> Pair:
    """Regularised incomplete beta function and its complement; rest is 1 - x where that is known more precisely."""
    rest = np.subtract(1.0, x) if rest is None else rest
    x, rest, a, b = (v.astype(float) for v in np.broadcast_arrays(x, rest, a, b))
    x, rest = np.clip(x, 0, 1), np.clip(rest, 0, 1)
    with np.errstate(all="ignore"):
        front = np.exp(-log_beta(a, b) + a * np.log(x) + b * np.log(rest))
        swap = x > (a + 1) / (a + b + 2)
        p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, rest, x)
        tiny = 1e-300
        c, d = np.ones(x.shape), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        m, open_ = 0, (x > 0) & (rest > 0)
        while open_.any():
            m += 1
            for an in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + an * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + an / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            open_ &= ~(np.abs(d * c - 1) < 1e-15)
        value = np.clip(front * h / p, 0, 1)
    lower = np.where(x <= 0, 0.0, np.where(rest <= 0, 1.0, np.where(swap, 1 - value, value)))
    upper = np.where(x <= 0, 1.0, np.where(rest <= 0, 0.0, np.where(swap, value, 1 - value)))
    return lower, upper


def beta_i(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return beta_pq(x, a, b)[0]


def inverse(rising: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The roots of a rising function within [low, high], ends of which may be infinite (the bracket is then widened).

    Chandrupatla's method: inverse quadratic interpolation where it is safe, else halves.
    """
    lo, hi = (np.array(v, float) for v in np.broadcast_arrays(low, high))
    for end, other, sign in ((hi, lo, 1.0), (lo, hi, -1.0)):
        open_, step = ~np.isfinite(end), np.ones(end.shape)
        end[open_] = np.where(np.isfinite(other[open_]), other[open_], 0.0) + sign
        while (short := open_ & (sign * rising(end) < 0) & (np.abs(end) < 1e300)).any():
            other[short], step[short] = end[short], step[short] * 2
            end[short] += sign * step[short]
    x1, x2 = hi.copy(), lo.copy()
    f1, f2 = rising(x1), rising(x2)
    t = np.full(x1.shape, 0.5)
    with np.errstate(all="ignore"):
        for _ in range(200):
            x = x1 + t * (x2 - x1)
            f = rising(x)
            same = np.sign(f) == np.sign(f1)
            x3, f3 = np.where(same, x1, x2), np.where(same, f1, f2)
            x2, f2 = np.where(same, x2, x1), np.where(same, f2, f1)
            x1, f1 = x, f
            best = np.where(np.abs(f1) < np.abs(f2), x1, x2)
            least = (4e-16 * np.abs(best) + 1e-300) / np.abs(x2 - x1)
            if ((least > 0.5) | (f1 == 0) | (f2 == 0) | ~np.isfinite(least)).all():
                break
            xi, phi = (x1 - x2) / (x3 - x2), (f1 - f2) / (f3 - f2)
            quadratic = (phi * phi < xi) & ((1 - phi) ** 2 < 1 - xi)
            t = np.where(quadratic, f1 / (f2 - f1) * f3 / (f2 - f3) + (x3 - x1) / (x2 - x1) * f1 / (f3 - f1) * f2 / (f3 - f2), 0.5)
            t = np.where(np.isfinite(t), np.clip(t, least, 1 - least), 0.5)
    return np.where(f2 == 0, x2, np.where(f1 == 0, x1, best))


def student_pq(t: np.ndarray, df: np.ndarray) -> Pair:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(all="ignore"):
        square = np.where(np.isfinite(t), t * t, np.inf)
        share = np.where(np.isfinite(square), df / (df + square), 0.0)
        tail = 0.5 * beta_pq(share, df / 2, 0.5, np.where(np.isfinite(square), square / (df + square), 1.0))[0]
    return np.where(t > 0, 1 - tail, tail), np.where(t > 0, tail, 1 - tail)


def student_cdf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return student_pq(t, df)[0]


def student_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    tail = np.minimum(p, 1 - p)
    upper = inverse(lambda t: tail - student_pq(t, df)[1], np.zeros(p.shape), np.full(p.shape, np.inf))
    return np.where(p < 0.5, -upper, upper)


def chi_square_pq(x: np.ndarray, df: np.ndarray) -> Pair:
    return gamma_pq(np.divide(df, 2), np.divide(x, 2))


def f_pq(x: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> Pair:
    x = np.maximum(x, 0.0)
    with np.errstate(all="ignore"):
        share = np.where(np.isfinite(x), np.multiply(d1, x) / (np.multiply(d1, x) + d2), 1.0)
    return beta_pq(share, np.divide(d1, 2), np.divide(d2, 2), np.where(np.isfinite(x), np.divide(d2, np.multiply(d1, x) + d2), 0.0))


def _column(f: Callable[..., np.ndarray]) -> Callable[..., Column]:
    """A column of a vectorised function; rows with a null or NaN argument are null."""

    def build(*arguments: Column) -> Column:
        @F.pandas_udf("double")
        def run(*series: pd.Series) -> pd.Series:
            values = [s.to_numpy(float) for s in series]
            good = ~np.isnan(np.sum(values, axis=0))
            out = np.full(len(good), np.nan)
            if good.any():
                out[good] = f(*[v[good] for v in values])
            return pd.Series(out).where(~np.isnan(out), None).astype("Float64") if not good.all() else pd.Series(out)

        return run(*[a.cast("double") for a in arguments])

    return build


student_t_cdf = _column(student_cdf)
student_t_tail = _column(lambda t, df: student_pq(t, df)[1])
student_t_quantile = _column(student_quantile)
gamma_p_column = _column(gamma_p)
gamma_q_column = _column(lambda a, x: gamma_pq(a, x)[1])
beta_i_column = _column(beta_i)
normal_cdf_column = _column(normal_cdf)
erf_column, erfc_column, lgamma_column = _column(erf), _column(erfc), _column(lgamma)
log_beta_column, digamma_column, trigamma_column = _column(log_beta), _column(digamma), _column(trigamma)
log_factorial_column, log_choose_column = _column(log_factorial), _column(log_choose)
chi_square_cdf = _column(lambda x, df: chi_square_pq(x, df)[0])
chi_square_tail = _column(lambda x, df: chi_square_pq(x, df)[1])
f_cdf = _column(lambda x, d1, d2: f_pq(x, d1, d2)[0])
f_tail = _column(lambda x, d1, d2: f_pq(x, d1, d2)[1])
