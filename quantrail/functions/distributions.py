"""Distributions with closed-form quantiles, as expressions that Spark SQL and DuckDB both read.

A family has a quantile in `u`, a cumulative function, a survival function and a density in `x`, and its mean and variance.
Parameters are numbers and become literals. Quantiles of `u` outside the unit interval are null, at its ends those of the support.
The other families are in numeric.py; they have the same columns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of AS 241 (Wichura, 1988), highest power first: centre, shoulder and tail.
CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
SHOULDER = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


#: Rational approximations of the error function (Cody, 1969), highest power first: near 0, to 4, beyond.
ERF_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def num(x: float) -> str:
    """A double literal for both engines."""
    x = float(x)
    return f"CAST({x!r} AS DOUBLE)" if math.isfinite(x) else f"CAST('{x}' AS DOUBLE)"


def horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = num(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {num(c)})"
    return out


def ratio(x: str, pair: tuple[tuple[float, ...], tuple[float, ...]]) -> str:
    return f"({horner(x, pair[0])} / {horner(x, pair[1])})"


def normal_quantile(u: str) -> str:
    q = f"({u} - {num(0.5)})"
    low = f"(CASE WHEN {u} < {num(0.5)} THEN {u} ELSE {num(1.0)} - {u} END)"
    r = f"sqrt(-ln({low}))"
    far = f"(CASE WHEN {r} <= {num(5.0)} THEN {ratio(f'({r} - {num(1.6)})', SHOULDER)} ELSE {ratio(f'({r} - {num(5.0)})', TAIL)} END)"
    near = f"({q} * {ratio(f'({num(0.180625)} - {q} * {q})', CENTRE)})"
    return f"(CASE WHEN abs({q}) <= {num(0.425)} THEN {near} WHEN {u} < {num(0.5)} THEN -{far} ELSE {far} END)"


def erfc(x: str) -> str:
    """The complementary error function, to about 1e-13 of its value."""
    a, z = f"abs({x})", f"(1 / ({x} * {x}))"
    far = f"(exp(-{x} * {x}) * ({num(1 / math.sqrt(math.pi))} - {z} * {ratio(z, ERFC_FAR)}) / {a})"
    tail = f"(CASE WHEN {a} <= 4 THEN exp(-{x} * {x}) * {ratio(a, ERFC_MIDDLE)} ELSE {far} END)"
    return f"(CASE WHEN {a} <= {num(0.46875)} THEN 1 - {x} * {ratio(f'({x} * {x})', ERF_NEAR)} WHEN {x} > 0 THEN {tail} ELSE 2 - {tail} END)"


def normal_cdf(z: str) -> str:
    return f"({num(0.5)} * {erfc(f'(-({z}) * {num(math.sqrt(0.5))})')})"


def normal_survival(z: str) -> str:
    return f"({num(0.5)} * {erfc(f'(({z}) * {num(math.sqrt(0.5))})')})"


@dataclass(frozen=True)
class Family:
    """Expressions of a distribution; survival and upper (the quantile of a survival share) are the precise ones of the upper tail, where a family has them."""

    quantile: Callable[[str], str]
    cdf: Callable[[str], str]
    pdf: Callable[[str], str]
    mean: float
    variance: float
    low: float = -math.inf
    high: float = math.inf
    discrete: bool = False
    survival: Callable[[str], str] | None = None
    upper: Callable[[str], str] | None = None

    def quantile_sql(self, u: str) -> str:
        low, high = (num(float(e)) if math.isfinite(e) else "NULL" for e in (self.low, self.high))
        return f"(CASE WHEN {u} > 0 AND {u} < 1 THEN {self.quantile(u)} WHEN {u} = 0 THEN {low} WHEN {u} = 1 THEN {high} END)"

    def survival_sql(self, x: str) -> str:
        return self.survival(x) if self.survival else f"(1 - {self.cdf(x)})"

    def upper_sql(self, q: str) -> str:
        return self.upper(q) if self.upper else self.quantile(f"(1 - {q})")

    def sample(self, u: str) -> Column:
        """The quantile at the named column of uniform numbers."""
        return F.expr(self.quantile_sql(u))

    def cdf_column(self, x: str) -> Column:
        return F.expr(self.cdf(x))

    def survival_column(self, x: str) -> Column:
        return F.expr(self.survival_sql(x))

    def pdf_column(self, x: str) -> Column:
        return F.expr(self.pdf(x))

    def log_pdf_column(self, x: str) -> Column:
        """Minus infinity where the density is 0."""
        return F.coalesce(F.ln(F.expr(self.pdf(x))), F.when(F.col(x).isNotNull(), F.lit(-math.inf)))


def check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def normal(mean: float, sd: float) -> Family:
    check(sd > 0, "sd must be positive")
    z = lambda x: f"(({x} - {num(mean)}) / {num(sd)})"
    return Family(
        lambda u: f"({num(mean)} + {num(sd)} * {normal_quantile(u)})",
        lambda x: normal_cdf(z(x)),
        lambda x: f"(exp(-0.5 * power({z(x)}, 2)) / {num(sd * math.sqrt(2 * math.pi))})",
        mean,
        sd * sd,
        survival=lambda x: normal_survival(z(x)),
        upper=lambda q: f"({num(mean)} - {num(sd)} * {normal_quantile(q)})",
    )


def lognormal(mean: float, sd: float) -> Family:
    """mean and sd are those of the variable itself."""
    check(mean > 0 and sd > 0, "mean and sd must be positive")
    s2 = math.log1p((sd / mean) ** 2)
    mu, s = math.log(mean) - s2 / 2, math.sqrt(s2)
    pdf = lambda x: f"(CASE WHEN {x} > 0 THEN exp(-0.5 * power((ln({x}) - {num(mu)}) / {num(s)}, 2)) / ({x} * {num(s * math.sqrt(2 * math.pi))}) ELSE 0 END)"
    side = lambda of, none: lambda x: f"(CASE WHEN {x} > 0 THEN {of(f'((ln({x}) - {num(mu)}) / {num(s)})')} ELSE {num(none)} END)"
    return Family(lambda u: f"exp({num(mu)} + {num(s)} * {normal_quantile(u)})", side(normal_cdf, 0.0), pdf, mean, sd * sd, 0.0, survival=side(normal_survival, 1.0), upper=lambda q: f"exp({num(mu)} - {num(s)} * {normal_quantile(q)})")


def _clipped(inside: Callable[[str], str], low: float, high: float) -> Callable[[str], str]:
    return lambda x: f"(CASE WHEN {x} <= {num(low)} THEN {num(0.0)} WHEN {x} >= {num(high)} THEN {num(1.0)} ELSE {inside(x)} END)"


def _inside(f: Callable[[str], str], low: float, high: float) -> Callable[[str], str]:
    return lambda x: f"(CASE WHEN {x} < {num(low)} OR {x} > {num(high)} THEN {num(0.0)} ELSE {f(x)} END)"


def uniform(low: float, high: float) -> Family:
    check(low < high, "low must be below high")
    w = high - low
    return Family(lambda u: f"({num(low)} + {u} * {num(w)})", _clipped(lambda x: f"(({x} - {num(low)}) / {num(w)})", low, high), _inside(lambda _: num(1 / w), low, high), (low + high) / 2, w * w / 12, low, high)


def triangular(low: float, mode: float, high: float) -> Family:
    check(low <= mode <= high and low < high, "low <= mode <= high")
    w, left, right = high - low, mode - low, high - mode
    at = left / w
    q = lambda u: f"(CASE WHEN {u} < {num(at)} THEN {num(low)} + sqrt({u} * {num(w * left)}) ELSE {num(high)} - sqrt((1 - {u}) * {num(w * right)}) END)"
    up = f"/ {num(w * left)}" if left else "* 0"
    down = f"/ {num(w * right)}" if right else "* 0"
    cdf = _clipped(lambda x: f"(CASE WHEN {x} < {num(mode)} THEN power({x} - {num(low)}, 2) {up} ELSE 1 - power({num(high)} - {x}, 2) {down} END)", low, high)
    pdf = _inside(lambda x: f"(CASE WHEN {x} < {num(mode)} THEN 2 * ({x} - {num(low)}) {up} ELSE 2 * ({num(high)} - {x}) {down if right else f'* 0 + {num(2 / w)}'} END)", low, high)
    return Family(q, cdf, pdf, (low + mode + high) / 3, (low * low + mode * mode + high * high - low * mode - low * high - mode * high) / 18, low, high)


def exponential(rate: float) -> Family:
    check(rate > 0, "rate must be positive")
    return Family(lambda u: f"(-ln(1 - {u}) / {num(rate)})", lambda x: f"(CASE WHEN {x} <= 0 THEN {num(0.0)} ELSE 1 - exp(-{num(rate)} * {x}) END)", lambda x: f"(CASE WHEN {x} < 0 THEN {num(0.0)} ELSE {num(rate)} * exp(-{num(rate)} * {x}) END)", 1 / rate, 1 / rate**2, 0.0, survival=lambda x: f"(CASE WHEN {x} <= 0 THEN {num(1.0)} ELSE exp(-{num(rate)} * {x}) END)", upper=lambda q: f"(-ln({q}) / {num(rate)})")


def weibull(shape: float, scale: float, location: float = 0.0) -> Family:
    check(shape > 0 and scale > 0, "shape and scale must be positive")
    z = lambda x: f"(({x} - {num(location)}) / {num(scale)})"
    g1, g2 = math.gamma(1 + 1 / shape), math.gamma(1 + 2 / shape)
    return Family(
        lambda u: f"({num(location)} + {num(scale)} * power(-ln(1 - {u}), {num(1 / shape)}))",
        lambda x: f"(CASE WHEN {x} <= {num(location)} THEN {num(0.0)} ELSE 1 - exp(-power({z(x)}, {num(shape)})) END)",
        lambda x: f"(CASE WHEN {x} <= {num(location)} THEN {num(0.0)} ELSE {num(shape / scale)} * power({z(x)}, {num(shape - 1)}) * exp(-power({z(x)}, {num(shape)})) END)",
        location + scale * g1,
        scale**2 * (g2 - g1 * g1),
        location,
        survival=lambda x: f"(CASE WHEN {x} <= {num(location)} THEN {num(1.0)} ELSE exp(-power({z(x)}, {num(shape)})) END)",
        upper=lambda q: f"({num(location)} + {num(scale)} * power(-ln({q}), {num(1 / shape)}))",
    )


def logistic(mean: float, scale: float) -> Family:
    check(scale > 0, "scale must be positive")
    e = lambda x: f"exp(-({x} - {num(mean)}) / {num(scale)})"
    return Family(lambda u: f"({num(mean)} + {num(scale)} * (ln({u}) - ln(1 - {u})))", lambda x: f"(1 / (1 + {e(x)}))", lambda x: f"({e(x)} / ({num(scale)} * power(1 + {e(x)}, 2)))", mean, (math.pi * scale) ** 2 / 3, survival=lambda x: f"({e(x)} / (1 + {e(x)}))", upper=lambda q: f"({num(mean)} - {num(scale)} * (ln({q}) - ln(1 - {q})))")


def cauchy(location: float, scale: float) -> Family:
    check(scale > 0, "scale must be positive")
    z = lambda x: f"(({x} - {num(location)}) / {num(scale)})"
    return Family(lambda u: f"({num(location)} + {num(scale)} * tan({num(math.pi)} * ({u} - {num(0.5)})))", lambda x: f"({num(0.5)} + atan({z(x)}) / {num(math.pi)})", lambda x: f"(1 / ({num(math.pi * scale)} * (1 + {z(x)} * {z(x)})))", math.nan, math.nan)


def gumbel(location: float, scale: float) -> Family:
    check(scale > 0, "scale must be positive")
    z = lambda x: f"exp(-({x} - {num(location)}) / {num(scale)})"
    return Family(lambda u: f"({num(location)} - {num(scale)} * ln(-ln({u})))", lambda x: f"exp(-{z(x)})", lambda x: f"({z(x)} * exp(-{z(x)}) / {num(scale)})", location + scale * 0.5772156649015329, (math.pi * scale) ** 2 / 6)


def frechet(shape: float, scale: float, location: float = 0.0) -> Family:
    check(shape > 0 and scale > 0, "shape and scale must be positive")
    z = lambda x: f"(({x} - {num(location)}) / {num(scale)})"
    g = lambda k: math.gamma(1 - k / shape) if shape > k else math.inf
    return Family(
        lambda u: f"({num(location)} + {num(scale)} * power(-ln({u}), {num(-1 / shape)}))",
        lambda x: f"(CASE WHEN {x} <= {num(location)} THEN {num(0.0)} ELSE exp(-power({z(x)}, {num(-shape)})) END)",
        lambda x: f"(CASE WHEN {x} <= {num(location)} THEN {num(0.0)} ELSE {num(shape / scale)} * power({z(x)}, {num(-1 - shape)}) * exp(-power({z(x)}, {num(-shape)})) END)",
        location + scale * g(1),
        scale**2 * (g(2) - g(1) ** 2) if shape > 2 else math.inf,
        location,
    )


def pareto(shape: float, scale: float) -> Family:
    check(shape > 0 and scale > 0, "shape and scale must be positive")
    return Family(
        lambda u: f"({num(scale)} * exp(-ln(1 - {u}) / {num(shape)}))",
        lambda x: f"(CASE WHEN {x} <= {num(scale)} THEN {num(0.0)} ELSE 1 - power({num(scale)} / {x}, {num(shape)}) END)",
        lambda x: f"(CASE WHEN {x} < {num(scale)} THEN {num(0.0)} ELSE {num(shape)} * power({num(scale)} / {x}, {num(shape)}) / {x} END)",
        shape * scale / (shape - 1) if shape > 1 else math.inf,
        shape * scale**2 / ((shape - 1) ** 2 * (shape - 2)) if shape > 2 else math.inf,
        scale,
        survival=lambda x: f"(CASE WHEN {x} <= {num(scale)} THEN {num(1.0)} ELSE power({num(scale)} / {x}, {num(shape)}) END)",
        upper=lambda q: f"({num(scale)} * power({q}, {num(-1 / shape)}))",
    )


def laplace(location: float, scale: float) -> Family:
    check(scale > 0, "scale must be positive")
    e = lambda x: f"exp(-abs({x} - {num(location)}) / {num(scale)})"
    return Family(
        lambda u: f"(CASE WHEN {u} < 0.5 THEN {num(location)} + {num(scale)} * ln(2 * {u}) ELSE {num(location)} - {num(scale)} * ln(2 * (1 - {u})) END)",
        lambda x: f"(CASE WHEN {x} < {num(location)} THEN 0.5 * {e(x)} ELSE 1 - 0.5 * {e(x)} END)",
        lambda x: f"({e(x)} / {num(2 * scale)})",
        location,
        2 * scale**2,
    )


def rayleigh(scale: float) -> Family:
    check(scale > 0, "scale must be positive")
    e = lambda x: f"exp(-{x} * {x} / {num(2 * scale**2)})"
    return Family(lambda u: f"({num(scale)} * sqrt(-2 * ln(1 - {u})))", lambda x: f"(CASE WHEN {x} <= 0 THEN {num(0.0)} ELSE 1 - {e(x)} END)", lambda x: f"(CASE WHEN {x} <= 0 THEN {num(0.0)} ELSE {x} / {num(scale**2)} * {e(x)} END)", scale * math.sqrt(math.pi / 2), (2 - math.pi / 2) * scale**2, 0.0)


def arcsine(low: float, high: float) -> Family:
    check(low < high, "low must be below high")
    w = high - low
    return Family(
        lambda u: f"({num(low)} + {num(w)} * power(sin({num(math.pi / 2)} * {u}), 2))",
        _clipped(lambda x: f"({num(2 / math.pi)} * asin(sqrt(({x} - {num(low)}) / {num(w)})))", low, high),
        lambda x: f"(CASE WHEN {x} <= {num(low)} OR {x} >= {num(high)} THEN {num(0.0)} ELSE 1 / ({num(math.pi)} * sqrt(({x} - {num(low)}) * ({num(high)} - {x}))) END)",
        (low + high) / 2,
        w * w / 8,
        low,
        high,
    )


def cosine(low: float, high: float) -> Family:
    """F(x) = sin^2(pi/2 * (x - low)/(high - low)): density a half wave of the sine."""
    check(low < high, "low must be below high")
    w = high - low
    return Family(
        lambda u: f"({num(low)} + {num(2 * w / math.pi)} * asin(sqrt({u})))",
        _clipped(lambda x: f"power(sin({num(math.pi / 2 / w)} * ({x} - {num(low)})), 2)", low, high),
        _inside(lambda x: f"({num(math.pi / 2 / w)} * sin({num(math.pi / w)} * ({x} - {num(low)})))", low, high),
        (low + high) / 2,
        w * w * (0.25 - 2 / math.pi**2),
        low,
        high,
    )


def power_function(alpha: float, low: float, high: float) -> Family:
    check(alpha > 0 and low < high, "alpha must be positive and low below high")
    w = high - low
    z = lambda x: f"(({x} - {num(low)}) / {num(w)})"
    return Family(
        lambda u: f"({num(low)} + {num(w)} * power({u}, {num(1 / alpha)}))",
        _clipped(lambda x: f"power({z(x)}, {num(alpha)})", low, high),
        lambda x: f"(CASE WHEN {x} <= {num(low)} OR {x} > {num(high)} THEN {num(0.0)} ELSE {num(alpha / w)} * power({z(x)}, {num(alpha - 1)}) END)",
        low + w * alpha / (alpha + 1),
        w * w * alpha / ((alpha + 1) ** 2 * (alpha + 2)),
        low,
        high,
    )


def trapezoidal(low: float, mode1: float, mode2: float, high: float) -> Family:
    check(low <= mode1 <= mode2 <= high and low < high, "low <= mode1 <= mode2 <= high")
    a, b, c, d = low, mode1, mode2, high
    h = 2 / (d + c - a - b)
    f1, f2 = h * (b - a) / 2, 1 - h * (d - c) / 2
    q = lambda u: f"(CASE WHEN {u} < {num(f1)} THEN {num(a)} + sqrt({u} * {num(2 * (b - a) / h)}) WHEN {u} <= {num(f2)} THEN {num(b)} + ({u} - {num(f1)}) / {num(h)} ELSE {num(d)} - sqrt((1 - {u}) * {num(2 * (d - c) / h)}) END)"
    up, down = (h / (2 * (b - a)) if b > a else 0.0), (h / (2 * (d - c)) if d > c else 0.0)
    cdf = _clipped(lambda x: f"(CASE WHEN {x} < {num(b)} THEN {num(up)} * power({x} - {num(a)}, 2) WHEN {x} <= {num(c)} THEN {num(f1)} + {num(h)} * ({x} - {num(b)}) ELSE 1 - {num(down)} * power({num(d)} - {x}, 2) END)", a, d)
    pdf = _inside(lambda x: f"(CASE WHEN {x} < {num(b)} THEN {num(2 * up)} * ({x} - {num(a)}) WHEN {x} <= {num(c)} THEN {num(h)} ELSE {num(2 * down)} * ({num(d)} - {x}) END)", a, d)
    cube = lambda p, q_, k: sum(p ** (k - i) * q_**i for i in range(k + 1))
    mean = h / 6 * (cube(d, c, 2) - cube(b, a, 2))
    return Family(q, cdf, pdf, mean, h / 12 * (cube(d, c, 3) - cube(b, a, 3)) - mean**2, a, d)


def bernoulli(p: float) -> Family:
    check(0 <= p <= 1, "p must be in [0, 1]")
    return Family(lambda u: f"(CASE WHEN {u} <= {num(1 - p)} THEN {num(0.0)} ELSE {num(1.0)} END)", lambda x: f"(CASE WHEN {x} < 0 THEN {num(0.0)} WHEN {x} < 1 THEN {num(1 - p)} ELSE {num(1.0)} END)", lambda x: f"(CASE WHEN {x} = 0 THEN {num(1 - p)} WHEN {x} = 1 THEN {num(p)} ELSE {num(0.0)} END)", p, p * (1 - p), 0, 1, True)


def geometric(p: float) -> Family:
    """Failures before the first success."""
    check(0 < p < 1, "p must be in (0, 1)")
    log = math.log1p(-p)
    cdf = lambda x: f"(CASE WHEN {x} < 0 THEN {num(0.0)} ELSE 1 - power({num(1 - p)}, floor({x}) + 1) END)"
    return Family(lambda u: f"greatest({num(0.0)}, ceil(ln(1 - {u}) / {num(log)} - 1))", cdf, lambda x: f"(CASE WHEN {x} < 0 OR {x} <> floor({x}) THEN {num(0.0)} ELSE {num(p)} * power({num(1 - p)}, {x}) END)", (1 - p) / p, (1 - p) / p**2, 0, math.inf, True)


def discrete_uniform(low: int, high: int) -> Family:
    check(low <= high, "low <= high")
    n = high - low + 1
    return Family(
        lambda u: f"({num(float(low))} + ceil({u} * {num(float(n))}) - 1)",
        lambda x: f"(CASE WHEN {x} < {num(float(low))} THEN {num(0.0)} WHEN {x} >= {num(float(high))} THEN {num(1.0)} ELSE (floor({x}) - {num(float(low - 1))}) / {num(float(n))} END)",
        lambda x: f"(CASE WHEN {x} < {num(float(low))} OR {x} > {num(float(high))} OR {x} <> floor({x}) THEN {num(0.0)} ELSE {num(1 / n)} END)",
        (low + high) / 2,
        (n * n - 1) / 12,
        low,
        high,
        True,
    )


def _lookup(x: str, keys: list[float], values: list[float], strict: bool) -> str:
    """values at how many sorted keys lie below x (or at it, unless strict): nested halves, so that a table of n keys is log2(n) comparisons deep."""

    def half(lo: int, hi: int) -> str:
        if lo == hi:
            return num(values[lo])
        mid = (lo + hi) // 2
        return f"(CASE WHEN {x} {'<=' if strict else '<'} {num(keys[mid])} THEN {half(lo, mid)} ELSE {half(mid + 1, hi)} END)"

    return half(0, len(keys))


def weighted(values: list[float], weights: list[float]) -> Family:
    """A finite table: duplicates are merged, weights normalised."""
    table: dict[float, float] = {}
    for v, w in zip(values, weights, strict=True):
        check(w >= 0, "weights must not be negative")
        if w:
            table[float(v)] = table.get(float(v), 0.0) + w
    check(bool(table), "a positive weight is needed")
    total, keys, sums = sum(table.values()), sorted(table), [0.0]
    for v in keys:
        sums.append(sums[-1] + table[v] / total)
    sums[-1] = 1.0
    mean = sum(v * w for v, w in table.items()) / total
    return Family(
        lambda u: _lookup(u, sums[1:-1], keys, True),
        lambda x: _lookup(x, keys, sums, False),
        lambda x: f"(CASE WHEN {x} = {_lookup(x, keys[1:], keys, False)} THEN {_lookup(x, keys[1:], [table[v] / total for v in keys], False)} ELSE {num(0.0)} END)",
        mean,
        sum(w * (v - mean) ** 2 for v, w in table.items()) / total,
        keys[0],
        keys[-1],
        True,
    )


def empirical(values: list[float]) -> Family:
    """Interpolates linearly between the sorted values; the density is constant between two values, infinite at repeated ones."""
    v = sorted(map(float, values))
    check(bool(v), "values are needed")
    n = len(v)
    if n == 1:
        return fixed(v[0])
    slope = [(v[i + 1] - v[i]) * (n - 1) for i in range(n - 1)]
    ends = [(i + 1) / (n - 1) for i in range(n - 2)]
    base = [v[i] - slope[i] * (i / (n - 1)) for i in range(n - 1)]
    keep = [i for i in range(n - 1) if slope[i]]  # steps with room
    twice = {v[i] for i in range(n - 1) if not slope[i]}
    inner = [v[i + 1] for i in keep[:-1]]
    rise = [1 / slope[i] for i in keep] or [0.0]
    start = [i / (n - 1) - v[i] / slope[i] for i in keep] or [0.0]
    cdf = _clipped(lambda x: f"({_lookup(x, inner, start, False)} + {x} * {_lookup(x, inner, rise, False)})", v[0], v[-1])
    cdf_top = lambda x: f"(CASE WHEN {x} >= {num(v[-1])} THEN {num(1.0)} ELSE {cdf(x)} END)"
    density = _inside(lambda x: _lookup(x, inner, rise, False), v[0], v[-1])
    pdf = (lambda x: f"(CASE WHEN {x} IN ({', '.join(map(num, sorted(twice)))}) THEN {num(math.inf)} ELSE {density(x)} END)") if twice else density
    second = sum((v[i] ** 2 + v[i] * v[i + 1] + v[i + 1] ** 2) / 3 for i in range(n - 1)) / (n - 1)
    mean = sum((v[i] + v[i + 1]) / 2 for i in range(n - 1)) / (n - 1)
    return Family(lambda u: f"({_lookup(u, ends, base, True)} + {u} * {_lookup(u, ends, slope, True)})", cdf_top, pdf, mean, second - mean**2, v[0], v[-1])


def fixed(value: float) -> Family:
    return Family(lambda _: num(float(value)), lambda x: f"(CASE WHEN {x} < {num(float(value))} THEN {num(0.0)} ELSE {num(1.0)} END)", lambda x: f"(CASE WHEN {x} = {num(float(value))} THEN {num(1.0)} ELSE {num(0.0)} END)", value, 0.0, value, value, True)


#: How an expression of this module reads in Python; a CASE becomes a call with its conditions and values as functions.
_PYTHON = (
    (r"CAST\('?([^' ]+)'? AS DOUBLE\)", r"float('\1')"),
    (r"\bCASE WHEN\b", "_case(lambda: ("),
    (r"\b(WHEN|THEN)\b", "), lambda: ("),
    (r"\bELSE\b", "), lambda: True, lambda: ("),
    (r"\bEND\b", "))"),
    (r"\bAND\b", "and"),
    (r"\bOR\b", "or"),
    (r"\bIN\b", "in"),
    (r"\bNULL\b", "None"),
    (r"<>", "!="),
    (r"(?<![<>!=])=(?!=)", "=="),
)


def _case(*steps: Callable[[], object]) -> object:
    return next((value() for when, value in zip(steps[::2], steps[1::2], strict=True) if when()), None)


def value(expression: str) -> float:
    """A constant expression as a number, on the driver."""
    for pattern, by in _PYTHON:
        expression = re.sub(pattern, by, expression)
    names = {n: getattr(math, n) for n in ("exp", "sqrt", "sin", "asin", "atan", "tan", "floor", "ceil")}
    names |= {"_case": _case, "float": float, "abs": abs, "ln": math.log, "power": pow, "greatest": max, "least": min, "__builtins__": {}}
    return float(eval(expression, names))  # noqa: S307 - an expression of this module


def truncated(base: Family, low: float | None = None, high: float | None = None) -> Family:
    """base between bounds, which belong to it. Moments are those of operators.fitting.moments.

    Where the lower bound is above the median, shares are those of the upper tail, which keep their digits.
    """
    a, b = (base.low if low is None else max(float(low), base.low)), (base.high if high is None else min(float(high), base.high))
    check(a <= b and (a < b or base.discrete), "the range holds no probability")
    at = value(base.pdf(num(a))) if base.discrete else 0.0
    late = math.isfinite(a) and value(base.cdf(num(a))) > 0.5
    # Shares beside the range, of the lower tail, or of the upper tail where the range lies in it.
    side = base.survival_sql if late else base.cdf
    first = (value(side(num(a))) + (at if late else -at)) if math.isfinite(a) else float(late)
    last = value(side(num(b))) if math.isfinite(b) else float(not late)
    mass = abs(last - first)
    check(mass > 0, "the range holds no probability")
    within = lambda x: f"least(greatest({x}, {num(a)}), {num(b)})"
    inverse = base.upper_sql if late else base.quantile

    def share(x: str, upper: bool) -> str:
        part = f"abs({side(x)} - {num(last if upper else first)}) / {num(mass)}"
        edge = "<" if base.discrete else "<="
        return f"(CASE WHEN {x} {edge} {num(a)} THEN {num(float(upper))} WHEN {x} >= {num(b)} THEN {num(float(not upper))} ELSE least({part}, {num(1.0)}) END)"

    return Family(
        lambda u: within(inverse(f"({num(first)} + {u} * {num(last - first)})")),
        lambda x: share(x, False),
        lambda x: f"(CASE WHEN {x} < {num(a)} OR {x} > {num(b)} THEN {num(0.0)} ELSE {base.pdf(x)} / {num(mass)} END)",
        math.nan,
        math.nan,
        a,
        b,
        base.discrete,
        lambda x: share(x, True),
        lambda q: within(inverse(f"({num(last)} - {q} * {num(last - first)})")),
    )


#: One example of each family, used by the catalogue query and the tests.
EXAMPLES: dict[str, Family] = {
    "normal": normal(10, 2),
    "lognormal": lognormal(100, 30),
    "uniform": uniform(-2, 5),
    "triangular": triangular(1, 3, 8),
    "exponential": exponential(0.25),
    "weibull": weibull(1.7, 50, 5),
    "logistic": logistic(3, 1.5),
    "cauchy": cauchy(-1, 0.5),
    "gumbel": gumbel(20, 4),
    "frechet": frechet(3.5, 10, 2),
    "pareto": pareto(2.5, 3),
    "laplace": laplace(5, 2),
    "rayleigh": rayleigh(3),
    "arcsine": arcsine(2, 6),
    "cosine": cosine(-3, 3),
    "powerFunction": power_function(2.5, 1, 4),
    "trapezoidal": trapezoidal(0, 2, 5, 10),
    "bernoulli": bernoulli(0.3),
    "geometric": geometric(0.2),
    "discreteUniform": discrete_uniform(1, 6),
    "weighted": weighted([1, 2, 5], [2, 1, 1]),
    "empirical": empirical([1, 2, 4, 8]),
    "fixed": fixed(7),
}
