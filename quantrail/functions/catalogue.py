"""The catalogue of distributions: parameters with their defaults and bounds, all errors of a specification, and the family that it stands for."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import distributions as d
from . import numeric

#: Parameters with their defaults by family; what a number must be is said by a mark behind the name: + above 0, % from 0 to 1, %+ above 0 up to 1, # whole, #1 whole and at least 1, #0 whole and at least 0.
FAMILIES: dict[str, dict[str, float]] = {
    "normal": {"mean": 100, "stdDev+": 10},
    "lognormal": {"mean+": 100, "stdDev+": 30},
    "uniform": {"min": 80, "max": 120},
    "triangular": {"min": 80, "mode": 100, "max": 130},
    "pert": {"min": 80, "mode": 100, "max": 130},
    "beta": {"alpha+": 2, "beta+": 5, "min": 0, "max": 1},
    "gamma": {"shape+": 2, "scale+": 10},
    "exponential": {"rate+": 0.1},
    "weibull": {"shape+": 2, "scale+": 100, "location": 0},
    "logistic": {"mean": 100, "scale+": 5},
    "studentT": {"df+": 5, "mean": 0, "scale+": 1},
    "chiSquare": {"df+": 5},
    "f": {"df1+": 5, "df2+": 10},
    "cauchy": {"location": 0, "scale+": 1},
    "gumbel": {"location": 100, "scale+": 10},
    "frechet": {"shape+": 3, "scale+": 100, "location": 0},
    "pareto": {"shape+": 3, "scale+": 100},
    "laplace": {"location": 100, "scale+": 10},
    "rayleigh": {"scale+": 10},
    "erlang": {"k#1": 3, "rate+": 0.5},
    "arcsine": {"min": 0, "max": 1},
    "cosine": {"min": 0, "max": 100},
    "powerFunction": {"alpha+": 2, "min": 0, "max": 100},
    "trapezoidal": {"min": 0, "mode1": 30, "mode2": 70, "max": 100},
    "bernoulli": {"p%": 0.5},
    "binomial": {"n#1": 10, "p%": 0.5},
    "poisson": {"lambda+": 5},
    "geometric": {"p%+": 0.2},
    "negativeBinomial": {"r+": 5, "p%+": 0.5},
    "hypergeometric": {"population#1": 50, "successes#0": 15, "draws#0": 10},
    "discreteUniform": {"min#": 1, "max#": 6},
    "fixed": {"value": 100},
}
MARKS = "+%#01"
#: What must not be greater: (smaller, greater, whether equal will do), in the order in which they are looked at; the key with the error is the second, or a mode.
ORDERED: dict[str, list[tuple[str, str, bool, str]]] = {
    **{f: [("min", "max", False, "max")] for f in ("uniform", "beta", "arcsine", "cosine", "powerFunction")},
    **{f: [("min", "max", False, "max"), ("min", "mode", True, "mode"), ("mode", "max", True, "mode")] for f in ("triangular", "pert")},
    "trapezoidal": [("min", "max", False, "max"), ("min", "mode1", True, "mode1"), ("mode1", "mode2", True, "mode1"), ("mode2", "max", True, "mode2")],
    "discreteUniform": [("min", "max", True, "max")],
    "hypergeometric": [("successes", "population", True, "successes"), ("draws", "population", True, "draws")],
}
#: Families whose constructor has another name.
MADE: dict[str, Callable[..., object]] = {
    "powerFunction": d.power_function, "discreteUniform": d.discrete_uniform, "studentT": numeric.student_t, "chiSquare": numeric.chi_square, "negativeBinomial": numeric.negative_binomial,
}


def parameters(family: str) -> dict[str, tuple[str, float]]:
    """(mark, default) of each parameter of a family."""
    out = {}
    for key, default in FAMILIES[family].items():
        name = key.rstrip(MARKS) if not key.startswith(("mode1", "mode2", "df1", "df2")) else key.rstrip("+%#")
        out[name] = (key[len(name) :], float(default))
    return out


def _fault(name: str, mark: str, v: object) -> str | None:
    if v is None:
        return f"{name} is missing"
    if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v):
        return f"{name} must be a finite number"
    if "#" in mark and v != int(v):
        return f"{name} must be whole"
    least = float(mark[1:]) if mark[:1] == "#" and mark[1:] else None
    if least is not None and v < least:
        return f"{name} must be at least {least:g}"
    if "+" in mark and v <= 0:
        return f"{name} must be above 0"
    if "%" in mark and not 0 <= v <= 1:
        return f"{name} must be from 0 to 1"
    return None


def errors_of(family: str, values: dict[str, float] | None, low: float | None = None, high: float | None = None) -> list[tuple[str, str]]:
    """(key, message) of everything that is wrong with a specification; none if it can be built. Parameters that are absent are missing: defaults() has them.

    Parameters are held against each other once each by itself is right, and bounds of truncation against the family once nothing else is wrong.
    """
    if family not in FAMILIES:
        return [("id", f"unknown distribution {family}")]
    values = values or {}
    out = [(n, m) for n, (mark, _) in parameters(family).items() if (m := _fault(n, mark, values.get(n)))]
    if not out:
        for a, b, equal, key in ORDERED.get(family, []):
            if values[a] > values[b] or values[a] == values[b] and not equal:
                out.append((key, f"{a} must {'not be above' if equal else 'be below'} {b}"))
                if family != "hypergeometric":  # elsewhere what follows depends on what comes first
                    break
    ends = [x for x in (low, high) if x is not None]
    if any(isinstance(x, bool) or not isinstance(x, int | float) or math.isnan(x) for x in ends):
        out.append(("truncate", "bounds must be numbers"))
    elif len(ends) == 2 and low > high:
        out.append(("truncate", "the lower bound must not be above the upper one"))
    elif ends and not out:
        try:
            built(family, values, low, high)
        except ValueError:
            out.append(("truncate", "the range holds no probability"))
    return out


def defaults(family: str) -> dict[str, float]:
    return {n: default for n, (_, default) in parameters(family).items()}


def built(family: str, values: dict[str, float], low: float | None = None, high: float | None = None) -> object:
    """The family of a right specification, truncated if a bound is given."""
    make = MADE.get(family) or getattr(d, family, None) or getattr(numeric, family)
    given = [values[n] for n in parameters(family)]
    whole = [int(v) if "#" in mark else float(v) for v, (mark, _) in zip(given, parameters(family).values(), strict=True)]
    base = make(*whole)
    if low is None and high is None:
        return base
    return d.truncated(base, low, high) if isinstance(base, d.Family) else numeric.truncated(base, low, high)


ERRORS = "array<struct<key:string,message:string>>"


def errors_column(family: Column, values: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """All errors of specifications in rows: a family's name, a map of parameters and bounds of truncation. A null family is an unknown one."""

    def found(families: pd.Series, maps: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        known = lambda v: None if v is None or pd.isna(v) else float(v)
        out = []
        for f, m, a, b in zip(families, maps, lows, highs, strict=True):
            given = {k: known(v) for k, v in (m.items() if isinstance(m, dict) else m or [])}
            out.append([{"key": k, "message": t} for k, t in errors_of(f or "", given, known(a), known(b))])
        return pd.Series(out, dtype=object)

    none = F.lit(None).cast("double")
    return F.pandas_udf(found, ERRORS)(family, values, none if low is None else low, none if high is None else high)
