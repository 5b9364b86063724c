"""Distribution fitting: maximum likelihood, ranked by information criteria, with tests of fit.

The data are counted by distinct value once. Families whose likelihood needs only sums (moments, moments of logarithms, ends,
median) are fitted from one aggregation, with root finding on the driver. The others are searched in lockstep: in each
pass over the counts every family's candidate parameters are evaluated together, as sums within the tasks, and a few
numbers for each candidate reach the driver, which makes a Newton step of each family.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as d
from ..functions import numeric as nf
from ..functions.distributions import Family
from ..functions.numeric import NumericFamily
from ..functions.special import chi_square_pq, digamma, lgamma, log_choose, normal_cdf, trigamma
from ..sources.folders import cut
from .joins import join_groups
from .ranking import passed, cumulative

Any = Family | NumericFamily
#: Families for whole numbers from 0 on; the others are continuous.
DISCRETE = ("bernoulli", "binomial", "poisson", "geometric", "negativeBinomial", "discreteUniform")
#: Passes of the search over the counted values, at most; it ends when no family gains.
PASSES = 40


def summary(df: DataFrame, value: str) -> dict[str, float]:
    """n, min, max, mean, population variance, moments of the logarithm, the median and the mean distance from it, of finite values."""
    x = F.col(value).cast("double")
    counts = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)).groupBy(x.alias("x")).agg(F.count("*").alias("count"))
    return _summary(cut(cumulative_counts(counts)))


def cumulative_counts(counts: DataFrame) -> DataFrame:
    """x, count, upto for counted values."""
    return cumulative(counts.select("x", "count"), "x", weight="count")


def _summary(placed: DataFrame) -> dict[str, float]:
    x, c = F.col("x"), F.col("count")
    log = F.ln(F.when(x > 0, x))
    s = placed.agg(
        F.sum(c).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), (F.sum(c * x) / F.sum(c)).alias("mean"), (F.sum(c * x * x) / F.sum(c)).alias("square"),
        (F.sum(c * log) / F.sum(c)).alias("log"), F.count("*").alias("distinct"), F.min((x == F.floor(x)).cast("int")).alias("whole"),
    ).first().asDict()
    if not s["n"]:
        return s
    n = s["n"]
    half = placed.agg(F.min(F.when(F.col("upto") >= (n + 1) // 2, x)).alias("a"), F.min(F.when(F.col("upto") >= n // 2 + 1, x)).alias("b")).first()
    s["median"] = (half["a"] + half["b"]) / 2
    pad = (s["max"] - s["min"]) / (n - 1) if n > 1 else 0.0
    s |= {"low": s["min"] - pad, "high": s["max"] + pad}
    z = (x - s["low"]) / (s["high"] - s["low"] or 1.0)
    more = placed.agg(
        (F.sum(c * F.pow(x - s["mean"], 2)) / n).alias("var"), (F.sum(c * F.pow(log - s["log"], 2)) / n if s["log"] is not None and s["min"] > 0 else F.lit(None)).alias("logvar"),
        (F.sum(c * F.abs(x - s["median"])) / n).alias("distance"), (F.sum(c * F.ln(z)) / n).alias("logz"), (F.sum(c * F.ln(1 - z)) / n).alias("logrest"),
    ).first().asDict()
    return s | more


def _newton(f: Callable[[float], float], slope: Callable[[float], float], x: float) -> float:
    """A root of f for positive x, by Newton steps on the logarithm of x."""
    for _ in range(100):
        step = f(x) / (slope(x) * x)
        x *= math.exp(-max(-2.0, min(2.0, step)))
        if abs(step) < 1e-14:
            break
    return x


def _psi(x: float) -> float:
    return float(digamma(np.array(x)))


def _psi1(x: float) -> float:
    return float(trigamma(np.array(x)))


def gamma_shape(mean: float, log: float) -> float:
    """Shape of the gamma law with this mean and mean logarithm."""
    gap = math.log(mean) - log
    start = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    return _newton(lambda k: math.log(k) - _psi(k) - gap, lambda k: 1 / k - _psi1(k), start)


def beta_shapes(logz: float, logrest: float, start: tuple[float, float]) -> tuple[float, float]:
    """Both shapes of the beta law with these mean logarithms of z and 1 - z, by Newton steps on their logarithms."""
    t = np.log(start)
    value = lambda t: float(np.sum(np.exp(t) * [logz, logrest]) - (lgamma(np.exp(t)).sum() - lgamma(np.exp(t).sum())))
    for _ in range(100):
        a, b = np.exp(t)
        g = np.array([a * (logz - _psi(a) + _psi(a + b)), b * (logrest - _psi(b) + _psi(a + b))])
        both = a * b * _psi1(a + b)
        h = np.array([[g[0] - a * a * (_psi1(a) - _psi1(a + b)), both], [both, g[1] - b * b * (_psi1(b) - _psi1(a + b))]])
        step = np.linalg.solve(h, g) if np.linalg.eigvalsh(h).max() < 0 else -g / (1 + np.abs(g).max())
        scale = min(1.0, 2 / max(1e-300, float(np.abs(step).max())))
        while scale > 1e-6 and value(t - scale * step) < value(t):
            scale /= 2
        t = t - scale * step
        if np.abs(step).max() < 1e-12:
            break
    return float(np.exp(t[0])), float(np.exp(t[1]))


def _best(f: Callable[[float], float], low: float, high: float) -> float:
    """The maximum of a one-humped function by golden section."""
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    while b - a > 1e-12 * max(1.0, abs(a) + abs(b)):
        c, e = b - g * (b - a), a + g * (b - a)
        a, b = (a, e) if f(c) > f(e) else (c, b)
    return (a + b) / 2


def _pert_mode(s: dict[str, float]) -> float:
    def value(t: float) -> float:
        a, b = 1 + 4 * t, 1 + 4 * (1 - t)
        return (a - 1) * s["logz"] + (b - 1) * s["logrest"] + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)

    return s["low"] + _best(value, 0.0, 1.0) * (s["high"] - s["low"])


def from_sums(s: dict[str, float]) -> dict[str, tuple[Any, int]]:
    """Families fitted from the summary alone, with their numbers of parameters."""
    mean, var, out = s["mean"], s["var"], {}
    if s["whole"] and s["min"] >= 0:
        out["poisson"] = (nf.poisson(mean), 1)
        out["geometric"] = (d.geometric(1 / (1 + mean)), 1)
        out["discreteUniform"] = (d.discrete_uniform(int(s["min"]), int(s["max"])), 2)
        if s["max"] <= 1:
            out["bernoulli"] = (d.bernoulli(mean), 1)
    low, high = s["low"], s["high"]
    out |= {"normal": (d.normal(mean, math.sqrt(var)), 2), "uniform": (d.uniform(s["min"], s["max"]), 2), "laplace": (d.laplace(s["median"], s["distance"]), 2), "arcsine": (d.arcsine(low, high), 2)}
    share = (mean - low) / (high - low)
    size = share * (1 - share) / (var / (high - low) ** 2) - 1
    a, b = beta_shapes(s["logz"], s["logrest"], (max(0.1, share * size), max(0.1, (1 - share) * size)))
    out |= {"beta": (nf.beta(a, b, low, high), 4), "pert": (nf.pert(low, _pert_mode(s), high), 3), "powerFunction": (d.power_function(-1 / s["logz"], low, high), 3)}
    if s["min"] > 0:
        m = math.exp(s["log"] + s["logvar"] / 2)
        shape = gamma_shape(mean, s["log"])
        value = lambda k: (k - 1) * s["log"] - k * math.log(mean / k) - k - math.lgamma(k)
        k = max((max(1, math.floor(shape)), max(1, math.ceil(shape))), key=value)
        chi = _newton(lambda v: _psi(v / 2) + math.log(2) - s["log"], lambda v: _psi1(v / 2) / 2, max(0.5, mean))
        out |= {"lognormal": (d.lognormal(m, m * math.sqrt(math.expm1(s["logvar"]))), 2), "pareto": (d.pareto(1 / (s["log"] - math.log(s["min"])), s["min"]), 2), "gamma": (nf.gamma(shape, mean / shape), 2), "erlang": (nf.erlang(k, k / mean), 2), "chiSquare": (nf.chi_square(chi), 1)}
    if s["min"] >= 0:
        out |= {"exponential": (d.exponential(1 / mean), 1), "rayleigh": (d.rayleigh(math.sqrt(s["square"] / 2)), 1)}
    return out


@dataclass
class Search:
    """A family searched by passes: log density of values at free coordinates, first guesses of these, and the family at them."""

    log_pdf: Callable[[np.ndarray, np.ndarray], np.ndarray]
    starts: list[list[float]]
    make: Callable[[np.ndarray], Any]
    k: int


def _sigmoid(t: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, t))))


def searched(s: dict[str, float]) -> dict[str, Search]:
    """Families whose likelihood needs every value."""
    mean, sd, low, high = s["mean"], math.sqrt(s["var"]), s["low"], s["high"]
    w, edge = high - low, math.log((high - low) / s["n"])
    e, lse = np.exp, np.logaddexp
    out: dict[str, Search] = {}
    scale = sd * math.sqrt(3) / math.pi
    out["logistic"] = Search(lambda x, t: -(x - t[0]) / e(t[1]) - t[1] - 2 * lse(0, -(x - t[0]) / e(t[1])), [[mean, math.log(scale)]], lambda t: d.logistic(t[0], math.exp(t[1])), 2)
    spread = math.log(max(s["distance"], 1e-12 * max(1.0, abs(mean))))
    out["cauchy"] = Search(lambda x, t: -math.log(math.pi) - t[1] - np.log1p(((x - t[0]) / e(t[1])) ** 2), [[s["median"], spread - 0.5], [s["median"], spread]], lambda t: d.cauchy(t[0], math.exp(t[1])), 2)

    def student(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        v = e(t[2])
        return lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * np.log(v * math.pi) - t[1] - (v + 1) / 2 * np.log1p(((x - t[0]) / e(t[1])) ** 2 / v)

    out["studentT"] = Search(student, [[s["median"], spread, math.log(v)] for v in (1.5, 5, 30)], lambda t: nf.student_t(math.exp(t[2]), t[0], math.exp(t[1])), 3)
    b = sd * math.sqrt(6) / math.pi
    gumbel = lambda x, t: -(x - t[0]) / e(t[1]) - e(np.minimum(-(x - t[0]) / e(t[1]), 700)) - t[1]
    out["gumbel"] = Search(gumbel, [[mean - 0.5772156649015329 * b, math.log(b)]], lambda t: d.gumbel(t[0], math.exp(t[1])), 2)

    def cosine(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        a, c = s["min"] - e(t[0]), s["max"] + e(t[1])
        return np.log(math.pi / 2 / (c - a)) + np.log(np.sin(math.pi * (x - a) / (c - a)))

    out["cosine"] = Search(cosine, [[edge, edge], [math.log(w / 10), math.log(w / 10)]], lambda t: d.cosine(s["min"] - math.exp(t[0]), s["max"] + math.exp(t[1])), 2)

    def corners(t: np.ndarray) -> tuple[float, float, float, float]:
        a, c = s["min"] - math.exp(t[0]), s["max"] + math.exp(t[1])
        one = a + (c - a) * _sigmoid(t[2])
        return a, one, one + (c - one) * _sigmoid(t[3]), c

    def trapezoid(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        a, m1, m2, c = corners(t)
        with np.errstate(all="ignore"):
            shape = np.where(x < m1, (x - a) / (m1 - a), np.where(x <= m2, 1.0, (c - x) / (c - m2)))
        return np.log(shape) + math.log(2 / (c + m2 - a - m1))

    out["trapezoidal"] = Search(trapezoid, [[edge, edge, p, q] for p, q in ((-1.0, 0.7), (-2.5, 2.0), (-0.5, 0.0))], lambda t: d.trapezoidal(*corners(t)), 4)

    def triangle(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        m = low + w * _sigmoid(t[0])
        return np.log(2 / w) + np.log(np.where(x < m, (x - low) / (m - low), (high - x) / (high - m)))

    out["triangular"] = Search(triangle, [[t] for t in np.linspace(-4, 4, 33)], lambda t: d.triangular(low, low + w * _sigmoid(t[0]), high), 3)
    if s["min"] > 0:
        k = 1.2 / math.sqrt(max(s["logvar"], 1e-12))
        out["weibull"] = Search(lambda x, t: t[0] - t[1] + (e(t[0]) - 1) * (np.log(x) - t[1]) - e(np.minimum(e(t[0]) * (np.log(x) - t[1]), 700)), [[math.log(k), s["log"] + 0.57 / k]], lambda t: d.weibull(math.exp(t[0]), math.exp(t[1])), 2)
        out["frechet"] = Search(lambda x, t: t[0] - t[1] - (1 + e(t[0])) * (np.log(x) - t[1]) - e(np.minimum(-e(t[0]) * (np.log(x) - t[1]), 700)), [[math.log(k), s["log"] - 0.57 / k]], lambda t: d.frechet(math.exp(t[0]), math.exp(t[1])), 2)

        def ratio(x: np.ndarray, t: np.ndarray) -> np.ndarray:
            p, q = e(t[0]) / 2, e(t[1]) / 2
            return lgamma(p + q) - lgamma(p) - lgamma(q) + p * (t[0] - t[1]) + (p - 1) * np.log(x) - (p + q) * np.log1p(x * e(t[0] - t[1]))

        out["f"] = Search(ratio, [[math.log(a), math.log(b)] for a, b in ((3, 6), (10, 20), (2, 40))], lambda t: nf.f(math.exp(t[0]), math.exp(t[1])), 2)
    if s["whole"] and s["min"] >= 0 and mean > 0:
        most = int(s["max"])

        def trials(t: np.ndarray) -> int:
            return most + round(math.expm1(max(0.0, float(t[0]))))

        def binomial(x: np.ndarray, t: np.ndarray) -> np.ndarray:
            n = trials(t)
            p = mean / n
            return log_choose(float(n), x) + x * math.log(p) + (n - x) * math.log1p(-p) if p < 1 else np.where(x == n, 0.0, -np.inf)

        out["binomial"] = Search(binomial, [[math.log1p(i)] for i in [*range(0, 12), *(2**j for j in range(4, 14))]], lambda t: nf.binomial(trials(t), min(1.0, mean / trials(t))), 2)
        r = mean * mean / max(s["var"] - mean, 0.01 * mean)

        def negative(x: np.ndarray, t: np.ndarray) -> np.ndarray:
            size = e(t[0])
            return lgamma(x + size) - lgamma(x + 1) - lgamma(size) + size * np.log(size / (size + mean)) + x * np.log(mean / (size + mean))

        out["negativeBinomial"] = Search(negative, [[math.log(r)]], lambda t: nf.negative_binomial(math.exp(t[0]), math.exp(t[0]) / (math.exp(t[0]) + mean)), 2)
    return out


def _likelihoods(placed: DataFrame, jobs: list[tuple[str, Search, np.ndarray]]) -> dict[str, np.ndarray]:
    """One pass: for each family the log-likelihood of each of its candidate points."""
    work = [(name, search.log_pdf, points) for name, search, points in jobs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(len(points)) for _, _, points in work]
        with np.errstate(all="ignore"):
            for rows in batches:
                x, c = rows["x"].to_numpy(float), rows["count"].to_numpy(float)
                for i, (_, log_pdf, points) in enumerate(work):
                    for j, t in enumerate(points):
                        v = log_pdf(x, t)
                        total[i][j] += float((c * v).sum()) if np.isfinite(v).all() else -np.inf
        yield pd.DataFrame([(i, j, v) for i, t in enumerate(total) for j, v in enumerate(t)], columns=["i", "j", "ll"])

    got = placed.select("x", "count").mapInPandas(run, "i int, j int, ll double").groupBy("i", "j").agg(F.sum("ll").alias("ll")).collect()  # a row for each candidate
    out = {name: np.full(len(points), -np.inf) for name, _, points in work}
    for r in got:
        out[work[r["i"]][0]][r["j"]] = r["ll"]
    return out


def _around(t: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The point, its neighbours along each axis, and one for each pair of axes."""
    k = len(t)
    out = [t]
    for i in range(k):
        for sign in (1, -1):
            out.append(t + sign * h * np.eye(k)[i])
    for i in range(k):
        for j in range(i):
            out.append(t + h * (np.eye(k)[i] + np.eye(k)[j]))
    return np.array(out)


def _step(values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The Newton step of the quadratic through the points of _around, uphill even where the surface is not a hump."""
    k = len(h)
    f0, up, down = values[0], values[1 : 2 * k + 1 : 2], values[2 : 2 * k + 1 : 2]
    g = (up - down) / (2 * h)
    m = np.diag((up + down - 2 * f0) / (h * h))
    at = 2 * k + 1
    for i in range(k):
        for j in range(i):
            m[i, j] = m[j, i] = (values[at] - up[i] - up[j] + f0) / (h[i] * h[j])
            at += 1
    if not np.isfinite(m).all() or not np.isfinite(g).all():
        return h * np.nan_to_num(np.sign(np.nan_to_num(up, neginf=-1e300) - np.nan_to_num(down, neginf=-1e300)))
    values_, axes = np.linalg.eigh(m)
    size = np.maximum(np.abs(values_), 1e-12 * max(1.0, np.abs(values_).max()))
    return axes @ ((axes.T @ g) / size)


def maximise(placed: DataFrame, searches: dict[str, Search], passes: int = PASSES) -> dict[str, np.ndarray]:
    """The best coordinates of each family, found in lockstep."""
    first = _likelihoods(placed, [(n, s, np.array(s.starts, float)) for n, s in searches.items()])
    at = {n: np.array(searches[n].starts[int(v.argmax())], float) for n, v in first.items() if np.isfinite(v.max())}
    best = {n: float(first[n].max()) for n in at}
    h = {n: np.full(len(t), 0.05) * np.maximum(1.0, np.abs(t) * 1e-3) for n, t in at.items()}
    for n in at:
        if searches[n].k == 2 and n in ("logistic", "cauchy", "gumbel") or n == "studentT":
            h[n][0] = 0.05 * math.exp(at[n][1])  # a location is measured in scales
    open_, step, falls = set(at), {}, {}
    for number in range(passes):
        jobs = [(n, searches[n], _around(at[n], h[n]) if number % 2 == 0 else at[n] + np.outer([2, 1, 0.5, 0.25, 0.05], step[n])) for n in sorted(open_)]
        if not jobs:
            break
        got = _likelihoods(placed, jobs)
        for n, _, points in jobs:
            top = int(got[n].argmax())
            gain = got[n][top] - best[n]
            if number % 2 == 0:
                move = _step(got[n], h[n])
                limit = np.abs(move / h[n]).max()
                step[n] = move * min(1.0, 60 / max(limit, 1e-300))
            elif gain <= 1e-10 * max(1.0, abs(best[n])):
                h[n] = h[n] / 10
                falls[n] = falls.get(n, 0) + 1
                if falls[n] == 2:
                    open_.discard(n)
            if gain > 0:
                if number % 2 == 0:
                    step[n] = step[n] + at[n] - points[top]
                at[n], best[n] = points[top], float(got[n][top])
    return at


def kolmogorov_p(d_: float, n: int) -> float:
    """P of a larger distance: the exact matrix power of Marsaglia, Tsang and Wang (2003) up to 100 rows, else the limit series."""
    if not 0 < d_ < 1:
        return 1.0 if d_ <= 0 else 0.0
    k = int(n * d_) + 1
    m = 2 * k - 1
    if m > 100:
        z = d_ * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
        return max(0.0, min(1.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * z * z) for j in range(1, 101))))
    h = k - n * d_
    a = np.tri(m, m, 1)
    powers = h ** np.arange(1, m + 1)
    a[:, 0] -= powers
    a[-1, :] -= powers[::-1]
    a[-1, 0] += max(0.0, 2 * h - 1) ** m
    gap = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    a = a / np.exp(lgamma(np.maximum(gap, 1) + 1.0)) * (gap >= 0)
    # a^n by squares, with an exponent kept apart; times n! / n^n
    out, shift, square, own, left = np.eye(m), 0.0, a, 0.0, n
    while left:
        if left & 1:
            out, shift = out @ square, shift + own
        square, own, left = square @ square, 2 * own, left >> 1
        size = square.max()
        square, own = square / size, own + math.log(size)
        size = out.max()
        out, shift = out / size, shift + math.log(size)
    inside = out[k - 1, k - 1]
    return max(0.0, min(1.0, 1 - math.exp(math.log(inside) + shift + math.lgamma(n + 1) - n * math.log(n)))) if inside > 0 else 1.0


def anderson_p(a2: float, n: int, name: str = "") -> float:
    """P of a larger statistic: for normal and lognormal fits with estimated parameters (D'Agostino and Stephens, 1986), else for a known law (Marsaglia and Marsaglia, 2004)."""
    if name in ("normal", "lognormal"):
        a = a2 * (1 + 0.75 / n + 2.25 / n**2)
        #: Published quadratics by range.
        for most, rest, c in ((0.2, True, (-13.436, 101.14, -223.73)), (0.34, True, (-8.318, 42.796, -59.938)), (0.6, False, (0.9177, -4.279, -1.38)), (math.inf, False, (1.2937, -5.709, 0.0186))):
            if a < most:
                p = math.exp(c[0] + c[1] * a + c[2] * a * a) if a < 150 else 0.0
                return max(0.0, min(1.0, 1 - p if rest else p))
    if a2 <= 0:
        return 1.0
    #: Published polynomials of the limit law and of its correction, lowest power first.
    power = lambda c, x: sum(v * x**i for i, v in enumerate(c))
    if a2 < 2:
        limit = math.exp(-1.2337141 / a2) / math.sqrt(a2) * power((2.00012, 0.247105, -0.0649821, 0.0347962, -0.0116720, 0.00168691), a2)
    else:
        limit = math.exp(-math.exp(power((1.0776, -2.30695, 0.43424, -0.082433, 0.008056, -0.0003146), min(a2, 30.0))))
    edge = 0.01265 + 0.1757 / n
    if limit > 0.8:
        fix = power((-130.2137, 745.2337, -1705.091, 1950.646, -1116.360, 255.7844), limit) / n
    elif limit < edge:
        t = limit / edge
        fix = math.sqrt(t) * (1 - t) * (49 * t - 102) * (0.0037 / n**2 + 0.00078 / n + 0.00006) / n
    else:
        t = (limit - edge) / (0.8 - edge)
        fix = power((-0.00022633, 6.54034, -14.6538, 14.458, -8.259, 1.91864), t) * (0.04213 + 0.01365 / n) / n
    return max(0.0, min(1.0, 1 - limit - fix))


def candidates(df: DataFrame, value: str, only: tuple[str, ...] | None = None, discrete: bool | None = None) -> tuple[DataFrame, dict[str, float], dict[str, tuple[Any, int]]]:
    """(counted values, summary, fitted families with their numbers of parameters). Whole numbers from 0 on take the discrete families, unless told."""
    x = F.col(value).cast("double")
    counts = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)).groupBy(x.alias("x")).agg(F.count("*").alias("count"))
    placed = cut(cumulative_counts(counts))
    s = _summary(placed)
    if (s["n"] or 0) < 2:
        return placed, s, {}
    if s["min"] == s["max"]:
        return placed, s, {"fixed": (d.fixed(s["min"]), 1)}
    whole = bool(s["whole"] and s["min"] >= 0) if discrete is None else discrete
    wanted = lambda name: name in only if only else (name in DISCRETE) == whole
    found = {n: f for n, f in from_sums(s).items() if wanted(n)}
    searches = {n: x for n, x in searched(s).items() if wanted(n)}
    for n, t in (maximise(placed, searches) if searches else {}).items():
        found[n] = (searches[n].make(t), searches[n].k)
    return placed, s, found


def _fits(family: Any) -> list[Column]:
    """Log density, shares up to and beyond x, and share below x."""
    below = family.cdf_column("x") - family.pdf_column("x") if family.discrete else family.cdf_column("x")
    return [family.log_pdf_column("x"), family.cdf_column("x"), family.survival_column("x"), below]


def fit(df: DataFrame, value: str, rank_by: str = "aic", only: tuple[str, ...] | None = None, discrete: bool | None = None) -> DataFrame:
    """family, k, log_likelihood, aic, bic, ks, ks_p, ad, ad_p for each candidate, the best first. NULL where a test does not apply."""
    placed, s, found = candidates(df, value, only, discrete)
    spark, n = df.sparkSession, s["n"]
    rows = placed
    for name, (family, _) in found.items():
        rows = rows.withColumns({f"{k}_{name}": c for k, c in zip(("ll", "f", "s", "b"), _fits(family), strict=True)})
    c, upto = F.col("count").cast("double"), F.col("upto").cast("double")
    low, high = upto * upto - (upto - c) * (upto - c), (n - upto + c) * (n - upto + c) - (n - upto) * (n - upto)
    aggs = []
    for name in found:
        at, over, below = F.col(f"f_{name}"), F.col(f"s_{name}"), F.col(f"b_{name}")
        aggs += [
            F.sum(c * F.col(f"ll_{name}")).alias(f"ll_{name}"),
            F.max(F.greatest(F.abs(upto / n - at), F.abs(below - (upto - c) / n))).alias(f"ks_{name}"),
            (-F.lit(float(n or 0)) - F.sum(low * F.ln(at) + high * F.ln(over)) / n).alias(f"ad_{name}"),
            F.min((at > 0) & (over > 0)).alias(f"ok_{name}"),
        ]
    r = rows.agg(*aggs).first() if aggs else None
    out = []
    for name, (family, k) in found.items():
        ll, ks = r[f"ll_{name}"], r[f"ks_{name}"]
        ad = r[f"ad_{name}"] if not family.discrete and r[f"ok_{name}"] else None
        out.append((name, k, ll, 2 * k - 2 * ll, k * math.log(n) - 2 * ll, ks, None if family.discrete else kolmogorov_p(ks, n), ad, None if ad is None else anderson_p(ad, n, name), n))
    order = ["family", "k", "log_likelihood", "aic", "bic", "ks", "ks_p", "ad", "ad_p", "n"]
    at = order.index(rank_by)
    worst = rank_by.endswith("_p") or rank_by == "log_likelihood"
    key = lambda v: (v is None, (-v if worst else v) if v is not None else 0.0)
    out.sort(key=lambda row: (key(row[at]), key(row[3])))
    return spark.createDataFrame(out, "family string, k int, log_likelihood double, aic double, bic double, ks double, ks_p double, ad double, ad_p double, n long")


#: Whole numbers whose shares are asked for at a time; where none of them ends a bin, the quantile tells where the next one ends.
AHEAD = 2048


def _united_values(counts: DataFrame, n: int, family: Any) -> tuple[int, float]:
    """(bins, statistic) over the whole numbers of the sample's range, neighbours united until 5 are expected.

    Bins end where the distribution says, so no row is needed for a number that no value has: shares are taken ahead of the last end,
    and a quantile leaps over what they don't reach. There are at most n / 5 bins. Values are counted by bin in one aggregation.
    """
    spark = counts.sparkSession
    least, most = (int(v) for v in counts.agg(F.min("x"), F.max("x")).first())

    def shares(x: list[int]) -> list[float]:
        df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", family.cdf_column("x").alias("s"))
        found = {r.x: r.s for r in df.collect()}  # at most AHEAD numbers
        return [found[float(v)] for v in x]

    ends: list[int] = []
    upto: list[float] = []
    at, before = least, 0.0
    while at <= most:
        ahead = [*range(at, min(most, at + AHEAD - 1) + 1)]
        for x, share in zip(ahead, shares(ahead), strict=True):
            share = 1.0 if x == most else share
            if n * (share - before) >= 5:
                ends.append(x)
                upto.append(share)
                before = share
        at = ahead[-1] + 1
        if at <= most and (not ends or ends[-1] < ahead[0]):
            u = before + 5 / n
            leap = spark.createDataFrame([(min(u, 1.0 - 1e-16),)], "u double").select(family.sample("u").alias("x")).first().x if u < 1 else most
            at = max(at, min(most, int(leap)) - AHEAD // 2)
    if not ends:
        return 0, 0.0
    if upto[-1] < 1.0:
        ends[-1], upto[-1] = most, 1.0
    expected = [n * (b - a) for a, b in zip([0.0, *upto], upto, strict=False)]
    rows = spark.createDataFrame([([float(e) for e in ends],)], "__ends array<double>")
    placed = join_groups(counts, rows, []).groupBy(F.least(passed(F.col("__ends"), F.col("x"), len(ends), False), F.lit(len(ends) - 1)).alias("bin")).agg(F.sum("c").alias("c"))
    observed = {r.bin: r.c for r in placed.collect()}  # a row for each bin
    return len(ends), sum((observed.get(i, 0) - e) ** 2 / e for i, e in enumerate(expected))


def chi_square(df: DataFrame, value: str, family: Any, bins: int | None = None, k: int = 0) -> DataFrame:
    """statistic, bins, n, df, p.

    Continuous: over equiprobable bins of the distribution, ceil(2 n^0.4) of them but no more than n / 5. Discrete: over values,
    neighbours united until 5 are expected. df is bins - 1 - k for k fitted parameters; without any left, df and p are NULL.
    """
    x = F.col(value).cast("double")
    counts = df.filter(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("c"))
    n = counts.agg(F.sum("c")).first()[0] or 0
    if family.discrete:
        bins, statistic = _united_values(counts, n, family) if n else (0, None)
    else:
        bins = bins or max(1, min(math.ceil(2 * n**0.4), n // 5))
        share = F.least(F.floor(family.cdf_column("x") * bins), F.lit(bins - 1)).cast("int")
        placed = counts.withColumn("bin", share).groupBy("bin").agg(F.sum("c").alias("c"))
        statistic = float((placed.agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0) * bins / n - n) if n else None
    free = bins - 1 - k
    p = float(chi_square_pq(np.array(statistic), np.array(float(free)))[1]) if free >= 1 and statistic is not None else None
    return df.sparkSession.createDataFrame([(statistic, bins, n, free if free >= 1 else None, p)], "statistic double, bins int, n long, df int, p double")


def moments(spark: SparkSession, family: Any) -> tuple[float, float]:
    """Mean and variance by Gauss-Legendre quadrature of the quantile over graded intervals: of truncated families, too."""
    nodes, weights = np.polynomial.legendre.leggauss(20)
    ends = np.concatenate([[0.0], 10.0 ** np.arange(-14, -1), np.linspace(0.1, 0.9, 9), (1 - 10.0 ** np.arange(-2, -15, -1)), [1.0]])
    u = [(float((a + b) / 2 + (b - a) / 2 * x), float((b - a) / 2 * w)) for a, b in zip(ends[:-1], ends[1:], strict=True) for x, w in zip(nodes, weights, strict=True)]
    rows = spark.createDataFrame(u, "u double, w double").withColumn("x", family.sample("u"))
    r = rows.agg(F.sum(F.col("w") * F.col("x")).alias("m"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("q"), F.sum("w").alias("w")).first()
    mean = r["m"] / r["w"]
    return mean, max(0.0, r["q"] / r["w"] - mean * mean)


def curve(spark: SparkSession, family: Any, points: int = 200) -> DataFrame:
    """x, pdf, cdf from the quantile at 0.001 to that at 0.999; discrete families at whole numbers, in steps beyond 2000 of them."""
    ends = spark.createDataFrame([(0.001,), (0.999,)], "u double").withColumn("x", family.sample("u")).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    if family.discrete:
        step = F.greatest(F.lit(1.0), F.ceil((F.col("b") - F.col("a")) / 2000))
        x = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("b") - F.col("a")) / step).cast("int")), lambda k: F.col("a") + k * step))
        grid = ends.select(x.alias("x"))
    else:
        grid = ends.select("a", "b", i.alias("i")).select((F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (points - 1)).alias("x"))
    return grid.select("x", family.pdf_column("x").alias("pdf"), family.cdf_column("x").alias("cdf"))


__all__ = ["anderson_p", "candidates", "chi_square", "curve", "fit", "kolmogorov_p", "maximise", "moments", "normal_cdf", "summary"]
