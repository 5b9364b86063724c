"""Distributions without closed-form quantiles: columns by Arrow batches of numpy functions.

A continuous quantile starts from a table of a fixed number of knots, evenly spaced on the normal scale, and is finished
by a few Newton steps inside its bracket; beyond the knots the share is inverted with the bracket alone. Shares above the median
are those of the upper tail. Discrete families search the table of cumulative shares around their mean, whose length grows
with the standard deviation and which holds all but 1e-15 of the probability.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .distributions import CENTRE, SHOULDER, TAIL, check
from .special import beta_pq, f_pq, gamma_pq, inverse, lgamma, log_beta, log_choose, normal_cdf, student_pq

Shares = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Knots of a quantile table: normal scores from -KNOT_END to KNOT_END.
KNOTS, KNOT_END = 401, 8.0


def normal_score(u: np.ndarray) -> np.ndarray:
    """Quantile of the standard normal distribution (the fixed values of distributions.py)."""
    u = np.asarray(u, float)
    q = u - 0.5
    with np.errstate(all="ignore"):
        r = np.sqrt(-np.log(np.minimum(u, 1 - u)))
        of = lambda x, pair: np.polyval(pair[0], x) / np.polyval(pair[1], x)
        far = np.where(r <= 5, of(r - 1.6, SHOULDER), of(r - 5, TAIL))
        return np.where(np.abs(q) <= 0.425, q * of(0.180625 - q * q, CENTRE), np.copysign(far, q))


@dataclass(frozen=True)
class NumericFamily:
    """shares gives the lower and the upper tail."""

    shares: Shares
    log_pdf: Callable[[np.ndarray], np.ndarray]
    mean: float
    variance: float
    low: float = -math.inf
    high: float = math.inf
    discrete: bool = False
    table: Callable[[np.ndarray], np.ndarray] | None = None  # quantiles, where they are searched in a table

    def cdf(self, x: np.ndarray) -> np.ndarray:
        return self.shares(x)[0]

    def survival(self, x: np.ndarray) -> np.ndarray:
        return self.shares(x)[1]

    def pdf(self, x: np.ndarray) -> np.ndarray:
        return np.exp(self.log_pdf(x))

    def _inverted(self, u: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        def rising(x: np.ndarray) -> np.ndarray:
            lower, upper = self.shares(x)
            return np.where(u <= 0.5, lower - u, (1 - u) - upper)

        return inverse(rising, low, high)

    @functools.cached_property
    def _knots(self) -> tuple[np.ndarray, np.ndarray]:
        z = np.linspace(-KNOT_END, 0, KNOTS // 2 + 1)
        tail = normal_cdf(z)
        full = lambda v: np.full(len(z), v)
        left = inverse(lambda x: self.shares(x)[0] - tail, full(self.low), full(self.high))
        right = inverse(lambda x: tail - self.shares(x)[1], full(self.low), full(self.high))
        return np.concatenate([z, -z[-2::-1]]), np.maximum.accumulate(np.concatenate([left, right[-2::-1]]))

    def quantile(self, u: np.ndarray) -> np.ndarray:
        u = np.asarray(u, float)
        if self.table:
            return self.table(u)
        z, x = self._knots
        score = normal_score(u)
        at = np.clip(np.searchsorted(z, score, side="right") - 1, 0, len(z) - 2)
        inside = np.abs(score) < KNOT_END
        low, high = np.where(inside, x[at], np.where(score < 0, self.low, x[-1])), np.where(inside, x[at + 1], np.where(score < 0, x[0], self.high))
        with np.errstate(all="ignore"):
            now = x[at] + (x[at + 1] - x[at]) * (score - z[at]) / (z[at + 1] - z[at])
            good = np.zeros(u.shape, bool)
            for _ in range(6):
                lower, upper = self.shares(now)
                miss = np.where(u <= 0.5, lower - u, (1 - u) - upper)
                step = miss / self.pdf(now)
                good = inside & (np.abs(step) <= 4e-15 * np.abs(now) + 1e-300) | (inside & (miss == 0))
                after = now - step
                now = np.where(good, now, np.where((after >= low) & (after <= high), after, (low + high) / 2))
                if good.all():
                    return now
        rest = ~good
        now[rest] = self._at(rest, u, low, high)
        return now

    def _at(self, where: np.ndarray, u: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self._inverted(u[where], low[where], high[where])

    def _column(self, f: Callable[[np.ndarray], np.ndarray], name: str, open_unit: bool = False) -> Column:
        low, high = self.low, self.high

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            x = x.to_numpy(float)
            good = (x > 0) & (x < 1) if open_unit else ~np.isnan(x)
            out = np.full(len(x), np.nan)
            if good.any():
                out[good] = f(x[good])
            if open_unit:
                out[x == 0], out[x == 1] = low if np.isfinite(low) else np.nan, high if np.isfinite(high) else np.nan
            return pd.Series(out).astype("Float64").where(~np.isnan(out), None)

        return run(F.col(name))

    def sample(self, u: str) -> Column:
        if not self.table:
            _ = self._knots  # computed once, on the driver, and shipped with the function
        return self._column(self.quantile, u, True)

    def cdf_column(self, x: str) -> Column:
        return self._column(self.cdf, x)

    def survival_column(self, x: str) -> Column:
        return self._column(self.survival, x)

    def pdf_column(self, x: str) -> Column:
        return self._column(self.pdf, x)

    def log_pdf_column(self, x: str) -> Column:
        return self._column(self.log_pdf, x)


def _within(f: Callable[[np.ndarray], np.ndarray], low: float, high: float = math.inf) -> Callable[[np.ndarray], np.ndarray]:
    """f inside a support, minus infinity outside."""

    def run(x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        with np.errstate(all="ignore"):
            return np.where((x >= low) & (x <= high), f(x), -np.inf)

    return run


def _xlog(a: float, x: np.ndarray) -> np.ndarray:
    """a * ln x, and 0 for a = 0."""
    return a * np.log(x) if a else np.zeros(np.shape(x))


def gamma(shape: float, scale: float) -> NumericFamily:
    check(shape > 0 and scale > 0, "shape and scale must be positive")
    log = _within(lambda x: _xlog(shape - 1, x / scale) - x / scale - math.lgamma(shape) - math.log(scale), 0.0)
    return NumericFamily(lambda x: gamma_pq(shape, np.asarray(x, float) / scale), log, shape * scale, shape * scale**2, 0.0)


def erlang(k: int, rate: float) -> NumericFamily:
    check(k >= 1 and k == int(k) and rate > 0, "k must be a positive integer and rate positive")
    return gamma(k, 1 / rate)


def chi_square(df: float) -> NumericFamily:
    check(df > 0, "df must be positive")
    return gamma(df / 2, 2)


def beta(alpha: float, beta_: float, low: float = 0.0, high: float = 1.0) -> NumericFamily:
    check(alpha > 0 and beta_ > 0 and low < high, "alpha and beta must be positive and low below high")
    w, total = high - low, alpha + beta_
    log = _within(lambda x: _xlog(alpha - 1, (x - low) / w) + _xlog(beta_ - 1, (high - x) / w) - float(log_beta(alpha, beta_)) - math.log(w), low, high)
    shares = lambda x: beta_pq((np.asarray(x, float) - low) / w, alpha, beta_, (high - np.asarray(x, float)) / w)
    return NumericFamily(shares, log, low + w * alpha / total, w * w * alpha * beta_ / (total * total * (total + 1)), low, high)


def pert(low: float, mode: float, high: float) -> NumericFamily:
    check(low <= mode <= high and low < high, "low <= mode <= high")
    w = high - low
    base = beta(1 + 4 * (mode - low) / w, 1 + 4 * (high - mode) / w, low, high)
    mean = (low + 4 * mode + high) / 6
    return NumericFamily(base.shares, base.log_pdf, mean, (mean - low) * (high - mean) / 7, low, high)


def student_t(df: float, mean: float = 0.0, scale: float = 1.0) -> NumericFamily:
    check(df > 0 and scale > 0, "df and scale must be positive")
    variance = scale**2 * df / (df - 2) if df > 2 else math.inf if df > 1 else math.nan
    front = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - math.log(scale)
    z = lambda x: (np.asarray(x, float) - mean) / scale
    return NumericFamily(lambda x: student_pq(z(x), df), lambda x: front - (df + 1) / 2 * np.log1p(z(x) ** 2 / df), mean if df > 1 else math.nan, variance)


def f(df1: float, df2: float) -> NumericFamily:
    check(df1 > 0 and df2 > 0, "both df must be positive")
    variance = 2 * df2**2 * (df1 + df2 - 2) / (df1 * (df2 - 2) ** 2 * (df2 - 4)) if df2 > 4 else math.inf if df2 > 2 else math.nan
    front = df1 / 2 * math.log(df1 / df2) - float(log_beta(df1 / 2, df2 / 2))
    log = _within(lambda x: front + _xlog(df1 / 2 - 1, x) - (df1 + df2) / 2 * np.log1p(df1 * x / df2), 0.0)
    return NumericFamily(lambda x: f_pq(np.asarray(x, float), df1, df2), log, df2 / (df2 - 2) if df2 > 2 else math.inf, variance, 0.0)


def _table(log_pmf: Callable[[np.ndarray], np.ndarray], low: int, most: int | None, mean: float, variance: float) -> NumericFamily:
    sd = math.sqrt(variance)
    start, end = max(low, math.floor(mean - 40 * sd - 40)), math.ceil(mean + 60 * sd + 80)
    end = end if most is None else min(most, end)
    k = np.arange(start, end + 1)
    share = np.exp(log_pmf(k.astype(float)))
    share /= share.sum()
    below = np.minimum(np.cumsum(share), 1.0)
    above = np.append(np.cumsum(share[:0:-1])[::-1], 0.0)  # beyond k
    fuzz = 64 * np.finfo(float).eps

    def quantile(u: np.ndarray) -> np.ndarray:
        # A share that the sum reaches up to rounding counts as reached; above the median the upper tail is searched.
        left = np.searchsorted(below, u * (1 - fuzz))
        right = np.searchsorted(-above, -(1 - u) * (1 + fuzz) - 1e-300)
        return k[np.minimum(np.where(u <= 0.5, left, right), len(k) - 1)].astype(float)

    def shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip(np.floor(x), start - 1, end).astype(np.int64) - start
        return np.where(at < 0, 0.0, below[np.maximum(at, 0)]), np.where(at < 0, 1.0, above[np.maximum(at, 0)])

    log = _within(lambda x: np.where(x == np.floor(x), log_pmf(x), -np.inf), low, math.inf if most is None else most)
    return NumericFamily(shares, log, mean, variance, low, math.inf if most is None else most, True, quantile)


def _point(at: int) -> NumericFamily:
    """All probability at one whole number."""
    return _table(lambda k: np.where(k == at, 0.0, -np.inf), at, at, at, 0.0)


def binomial(n: int, p: float) -> NumericFamily:
    check(n >= 0 and 0 <= p <= 1, "n must not be negative, p in [0, 1]")
    if p in (0, 1):
        return _point(n if p else 0)
    return _table(lambda k: log_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p), 0, n, n * p, n * p * (1 - p))


def poisson(rate: float) -> NumericFamily:
    check(rate > 0, "rate must be positive")
    return _table(lambda k: k * math.log(rate) - rate - lgamma(k + 1), 0, None, rate, rate)


def negative_binomial(r: float, p: float) -> NumericFamily:
    """Failures before the r-th success; r need not be whole."""
    check(r > 0 and 0 < p < 1, "r must be positive, p in (0, 1)")
    return _table(lambda k: lgamma(k + r) - lgamma(k + 1) - math.lgamma(r) + r * math.log(p) + k * math.log1p(-p), 0, None, r * (1 - p) / p, r * (1 - p) / p**2)


def hypergeometric(population: int, successes: int, draws: int) -> NumericFamily:
    check(0 <= successes <= population and 0 <= draws <= population, "successes and draws within the population")
    low, high = max(0, draws + successes - population), min(draws, successes)
    p = successes / population if population else 0.0
    total = float(log_choose(population, np.array(float(draws))))
    return _table(lambda k: log_choose(successes, k) + log_choose(population - successes, draws - k) - total, low, high, draws * p, draws * p * (1 - p) * (population - draws) / max(1, population - 1))


def truncated(base: NumericFamily, low: float | None = None, high: float | None = None) -> NumericFamily:
    """base between bounds, which belong to it; shares are those of the upper tail where the lower bound is above the median."""
    a, b = (base.low if low is None else max(float(low), base.low)), (base.high if high is None else min(float(high), base.high))
    check(a <= b and (a < b or base.discrete), "the range holds no probability")
    (la,), (ua,) = base.shares(np.array([math.ceil(a) - 1.0 if base.discrete and math.isfinite(a) else a]))
    (lb,), (ub,) = base.shares(np.array([b]))
    late = la > 0.5
    mass = float(ua - ub if late else lb - la)
    check(mass > 0, "the range holds no probability")

    def shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower, upper = base.shares(np.clip(x, a, b))
        under, over = x < a, x >= b
        low_, high_ = ((ua - upper) / mass, (upper - ub) / mass) if late else ((lower - la) / mass, (lb - lower) / mass)
        return np.where(under, 0.0, np.where(over, 1.0, np.clip(low_, 0, 1))), np.where(under, 1.0, np.where(over, 0.0, np.clip(high_, 0, 1)))

    log = _within(lambda x: base.log_pdf(x) - math.log(mass), a, b)
    if not base.discrete:
        return NumericFamily(shares, log, math.nan, math.nan, a, b)
    quantile = lambda u: np.clip(base.quantile(1 - (ua - u * mass) if late else la + u * mass), math.ceil(a), math.floor(b))
    return NumericFamily(shares, log, math.nan, math.nan, a, b, True, quantile)


EXAMPLES: dict[str, Callable[[], NumericFamily]] = {
    "beta": lambda: beta(2.5, 0.8, 10, 20),
    "gamma": lambda: gamma(2.5, 3),
    "pert": lambda: pert(80, 100, 130),
    "erlang": lambda: erlang(4, 0.5),
    "chiSquare": lambda: chi_square(7),
    "studentT": lambda: student_t(4.5, 1, 2),
    "f": lambda: f(5, 12),
    "binomial": lambda: binomial(20, 0.35),
    "poisson": lambda: poisson(4.2),
    "negativeBinomial": lambda: negative_binomial(3, 0.4),
    "hypergeometric": lambda: hypergeometric(50, 15, 10),
}
