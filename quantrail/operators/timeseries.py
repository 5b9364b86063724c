"""Time series: windows and aggregations for many series at once; smoothing and ARIMA by series in Arrow groups.

A series is the rows of a key, ordered by an integer period. Groups that go to Python are single series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import normal_score
from ..functions.special import chi_square_tail, normal_cdf, student_t_quantile


def _order(by: list[str], t: str) -> Window:
    return Window.partitionBy(*by).orderBy(t)


def moving_average(df: DataFrame, y: str, t: str, window: int, by: list[str]) -> DataFrame:
    """df with fitted: the mean of the `window` values before."""
    w = _order(by, t)
    before = w.rowsBetween(-window, -1)
    return df.withColumn("fitted", F.when(F.row_number().over(w) > window, F.avg(y).over(before)))


def centred_average(df: DataFrame, y: str, t: str, period: int, by: list[str]) -> DataFrame:
    """df with trend: the centred mean over a period, of two for an even one; NULL at the ends."""
    w, half = _order(by, t), period // 2
    n, i = F.count("*").over(Window.partitionBy(*by)), F.row_number().over(w)
    inside = (i > half) & (i <= n - half)
    if period % 2:
        value = F.avg(y).over(w.rowsBetween(-half, half))
    else:
        value = (F.sum(y).over(w.rowsBetween(-half, half - 1)) + F.sum(y).over(w.rowsBetween(-half + 1, half))) / (2.0 * period)
    return df.withColumn("trend", F.when(inside, value))


def decompose(df: DataFrame, y: str, t: str, period: int, by: list[str], kind: str = "additive") -> DataFrame:
    """df with trend, seasonal (normalised) and residual."""
    mul = kind == "multiplicative"
    d = centred_average(df, y, t, period, by).withColumn("phase", F.pmod((F.row_number().over(_order(by, t)) - 1), F.lit(period)))
    raw = (F.col(y) / F.col("trend")) if mul else (F.col(y) - F.col("trend"))
    phases = d.groupBy(*by, "phase").agg(F.avg(raw).alias("__s"))
    mean = F.avg("__s").over(Window.partitionBy(*by))
    phases = phases.withColumn("seasonal", F.col("__s") / mean if mul else F.col("__s") - mean).drop("__s")
    d = d.join(phases, [*by, "phase"])
    rest = F.col(y) / (F.col("trend") * F.col("seasonal")) if mul else F.col(y) - F.col("trend") - F.col("seasonal")
    return d.withColumn("residual", rest)


def difference(df: DataFrame, y: str, t: str, by: list[str], times: int = 1) -> DataFrame:
    for _ in range(times):
        df = df.withColumn(y, F.col(y) - F.lag(y).over(_order(by, t))).filter(F.col(y).isNotNull())
    return df


def acf(df: DataFrame, y: str, t: str, lags: int, by: list[str]) -> DataFrame:
    """lag, r: autocovariance over the variance of the whole series."""
    w = _order(by, t)
    centred = df.withColumn("__e", F.col(y) - F.avg(y).over(Window.partitionBy(*by)))
    parts = [F.sum(F.col("__e") * F.col(f"__l{k}")).alias(f"c{k}") for k in range(lags + 1)]
    sums = centred.withColumns({f"__l{k}": F.lag("__e", k).over(w) if k else F.col("__e") for k in range(lags + 1)}).groupBy(*by).agg(*parts)
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("c0") > 0, F.col(f"c{k}") / F.col("c0")).alias("r")) for k in range(lags + 1)]))
    return sums.select(*by, long.alias("a")).select(*by, "a.*")


def ljung_box(df: DataFrame, y: str, t: str, lags: int, by: list[str]) -> DataFrame:
    """q, lags, p_value: the portmanteau statistic."""
    n = df.groupBy(*by).agg(F.count("*").cast("double").alias("n"))
    r = acf(df, y, t, lags, by).filter("lag > 0").join(n, by)
    return r.groupBy(*by).agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag")))).alias("q"), F.lit(lags).alias("lags")).withColumn("p_value", chi_square_tail(F.col("q"), F.col("lags").cast("double")))


def error_metrics(df: DataFrame, actual: str, fitted: str, t: str, by: list[str]) -> DataFrame:
    """mae, mse, rmse, mape (zeros skipped), smape, theil_u, r2 of complete pairs."""
    a, f = F.col(actual), F.col(fitted)
    pairs = df.filter(a.isNotNull() & f.isNotNull()).withColumn("__before", F.lag(actual).over(_order(by, t)))
    e = a - f
    out = pairs.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.avg(F.when(a != 0, F.abs(e / a))).alias("mape"),
        F.avg(F.when(F.abs(a) + F.abs(f) > 0, 2 * F.abs(e) / (F.abs(a) + F.abs(f)))).alias("smape"),
        F.sum(F.when(F.col("__before") != 0, F.pow(e / F.col("__before"), 2))).alias("__u"),
        F.sum(F.when(F.col("__before") != 0, F.pow((a - F.col("__before")) / F.col("__before"), 2))).alias("__d"),
        F.sum(e * e).alias("__sse"),
        (F.var_pop(a) * F.count("*")).alias("__sst"),
    )
    return out.withColumns({"rmse": F.sqrt("mse"), "theil_u": F.when(F.col("__d") > 0, F.sqrt(F.col("__u") / F.col("__d"))), "r2": F.when(F.col("__sst") > 0, 1 - F.col("__sse") / F.col("__sst"))}).drop("__u", "__d", "__sse", "__sst")


def _line(x: Column, y: Column) -> tuple[Column, Column]:
    slope = F.covar_pop(x, y) / F.var_pop(x)
    return F.avg(y) - slope * F.avg(x), slope


def trend(df: DataFrame, y: str, t: str, by: list[str], kind: str = "linear") -> DataFrame:
    """a, b of the curve over periods 1, 2, ...: linear a + b t, exponential a e^(b t), logarithmic a + b ln t, power a t^b."""
    x = F.row_number().over(_order(by, t)).cast("double")
    rows = df.withColumn("__t", x)
    u = F.ln("__t") if kind in ("logarithmic", "power") else F.col("__t")
    v = F.ln(F.when(F.col(y) > 0, F.col(y))) if kind in ("exponential", "power") else F.col(y)
    rows = rows.withColumns({"__u": u, "__v": v}).filter("__v IS NOT NULL")
    a, b = _line(F.col("__u"), F.col("__v"))
    out = rows.groupBy(*by).agg(a.alias("a"), b.alias("b"), F.corr("__u", "__v").alias("__r"))
    return out.select(*by, (F.exp("a") if kind in ("exponential", "power") else F.col("a")).alias("a"), "b", (F.col("__r") * F.col("__r")).alias("r2"))


def trend_forecast(df: DataFrame, y: str, t: str, by: list[str], steps: int, kind: str = "linear", level: float = 0.95) -> DataFrame:
    """by, step, forecast, error, low, high: the curve of trend() beyond the last period, with Student t intervals for a new value.

    error is that of the fitted scale, which is of logarithms for exponential and power curves. One aggregation for each series.
    """
    logs = kind in ("exponential", "power")
    rows = df.withColumn("__t", F.row_number().over(_order(by, t)).cast("double"))
    u = F.ln("__t") if kind in ("logarithmic", "power") else F.col("__t")
    v = F.ln(F.when(F.col(y) > 0, F.col(y))) if logs else F.col(y)
    rows = rows.withColumns({"__u": u, "__v": v})
    s = rows.filter("__v IS NOT NULL").groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.max("__t").alias("m"), F.avg("__u").alias("u"), F.avg("__v").alias("v"), F.regr_sxx("__v", "__u").alias("uu"), F.regr_sxy("__v", "__u").alias("uv"), F.regr_syy("__v", "__u").alias("vv"))
    b = F.col("uv") / F.col("uu")
    s = s.filter("n > 2 AND uu > 0").withColumns({"b": b, "a": F.col("v") - b * F.col("u"), "s2": F.greatest(F.lit(0.0), F.col("vv") - b * F.col("uv")) / (F.col("n") - 2)})
    at = F.col("m") + F.col("step")
    x = F.ln(at) if kind in ("logarithmic", "power") else at
    out = s.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("x", x)
    out = out.withColumns({"mu": F.col("a") + F.col("b") * F.col("x"), "error": F.sqrt(F.col("s2") * (1 + 1 / F.col("n") + (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) / F.col("uu")))})
    half = student_t_quantile(F.lit((1 + level) / 2), F.col("n") - 2) * F.col("error")
    back = F.exp if logs else (lambda c: c)
    return out.select(*by, "step", back(F.col("mu")).alias("forecast"), "error", back(F.col("mu") - half).alias("low"), back(F.col("mu") + half).alias("high"))


def ses(df: DataFrame, y: str, t: str, by: list[str], alpha: float) -> DataFrame:
    """level: the exponentially smoothed value after the last period, as a fold over the series' array."""
    series = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(y).alias("y")))).alias("s"))
    fold = F.aggregate(F.slice("s", F.lit(2), F.greatest(F.size("s"), F.lit(1))), F.col("s")[0]["y"], lambda a, v: a + alpha * (v["y"] - a))
    return series.select(*by, fold.alias("level"))


# Smoothing, ARIMA and unit-root tests need an optimiser or small regressions for each series.


def centred(y: np.ndarray, m: int) -> np.ndarray:
    """Mean over a period around each value, of two means for an even one; NaN at the ends."""
    w = np.full(m, 1 / m) if m % 2 else np.append(np.append(0.5, np.ones(m - 1)), 0.5) / m
    out = np.full(len(y), np.nan)
    if len(y) >= len(w):
        half = len(w) // 2
        out[half : len(y) - half] = np.convolve(y, w, "valid")
    return out


@dataclass(frozen=True)
class Smoother:
    """Exponential smoothing in its error-correction form; period 0: no season."""

    trended: bool = False
    damped: bool = False
    period: int = 0
    multiplicative: bool = False

    def start(self, y: np.ndarray) -> tuple[float, float, np.ndarray]:
        """Level and slope of a line through the first values, and seasonal indices from their centred means."""
        line = lambda v: np.polyfit(np.arange(1, len(v) + 1), v, 1)[::-1] if len(v) > 1 else (v[0], 0.0)
        if not self.period:
            if not self.trended:
                return float(y[0]), 0.0, np.zeros(1)
            level, slope = line(y[:10])
            return float(level), float(slope), np.zeros(1)
        m, none = self.period, 1.0 if self.multiplicative else 0.0
        head = y[: max(2 * m, 10)]
        base = centred(head, m)
        raw = head / base if self.multiplicative else head - base
        phase, known = np.arange(len(head)) % m, np.isfinite(raw)
        season = np.array([raw[known & (phase == j)].mean() if (known & (phase == j)).any() else none for j in range(m)])
        season = season / season.mean() if self.multiplicative else season - season.mean()
        level, slope = line(head / season[phase] if self.multiplicative else head - season[phase])
        return float(level), float(slope) if self.trended else 0.0, season

    def run(self, y: np.ndarray, alpha: float, beta: float, gamma: float, phi: float) -> tuple[np.ndarray, float, float, np.ndarray]:
        """Fitted values, and the states after the last one."""
        level, slope, season = self.start(y)
        season, m = season.copy(), max(self.period, 1)
        phi = phi if self.trended else 0.0
        fitted = np.empty(len(y))
        for i, v in enumerate(y):
            base, s = level + phi * slope, season[i % m]
            fitted[i] = base * s if self.multiplicative else base + s
            error = v - fitted[i]
            gain = error / s if self.multiplicative else error
            level, slope = base + alpha * gain, phi * slope + alpha * beta * gain
            if self.period:
                season[i % m] = s + gamma * (error / base if self.multiplicative else error)
        return fitted, level, slope, season

    def parameters(self, z: np.ndarray) -> tuple[float, float, float, float]:
        u = _unit(z)
        return float(u[0]), float(u[1]) if self.trended else 0.0, float(u[2]) if self.period else 0.0, 0.8 + 0.18 * float(u[3]) if self.damped else 1.0

    def fit(self, y: np.ndarray) -> tuple[float, float, float, float]:
        def error(z: np.ndarray) -> float:
            with np.errstate(all="ignore"):
                sse = float(np.sum((y - self.run(y, *self.parameters(z))[0]) ** 2))
            return sse if np.isfinite(sse) else 1e300

        starts = [nelder_mead(error, np.array([np.log(a / (1 - a)), -2.0, -2.0, 1.0])) for a in (0.2, 0.5, 0.8)]
        return self.parameters(min(starts, key=error))

    def forecast(self, y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fitted values, forecasts and their standard deviations (those of the linear model with the same parameters)."""
        alpha, beta, gamma, phi = self.fit(y)
        fitted, level, slope, season = self.run(y, alpha, beta, gamma, phi)
        step = np.cumsum(phi ** np.arange(1, horizon + 1)) if self.trended else np.zeros(horizon)
        s = season[(len(y) + np.arange(horizon)) % len(season)]
        base = level + slope * step
        j = np.arange(1, horizon)
        c = alpha * (1 + beta * step[: horizon - 1]) + (gamma * (j % self.period == 0) if self.period else 0.0)
        free = len(y) - 1 - self.trended - bool(self.period) - self.damped
        sigma = np.sqrt(np.sum((y - fitted) ** 2) / max(1, free))
        return fitted, base * s if self.multiplicative else base + s, sigma * np.sqrt(1 + np.append(0.0, np.cumsum(c * c)))


def nelder_mead(f, x: np.ndarray, steps: int = 200, size: float = 0.1) -> np.ndarray:
    points = np.vstack([x, x + np.diag(np.full(len(x), size))])
    values = np.array([f(p) for p in points])
    for _ in range(steps):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if abs(values[-1] - values[0]) <= 1e-10 * (abs(values[0]) + 1e-10):
            break
        centre = points[:-1].mean(axis=0)
        for k in (1.0, 2.0, -0.5):
            p = centre + k * (centre - points[-1])
            v = f(p)
            if k == 1.0:
                first, value = p, v
                if not v < values[0]:
                    if v < values[-2]:
                        points[-1], values[-1] = p, v
                        break
                    continue
            elif k == 2.0 and value < values[0]:
                points[-1], values[-1] = (p, v) if v < value else (first, value)
                break
            elif k == -0.5:
                if v < values[-1]:
                    points[-1], values[-1] = p, v
                else:
                    points[1:] = points[0] + (points[1:] - points[0]) / 2
                    values[1:] = [f(q) for q in points[1:]]
    return points[values.argmin()]


def _unit(z: np.ndarray) -> np.ndarray:
    return 1e-4 + (1 - 2e-4) / (1 + np.exp(-np.clip(z, -30, 30)))


def stationary(z: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from free numbers, by way of its partial autocorrelations: every one can be reached."""
    out = np.zeros(0)
    for r in np.tanh(z):
        out = np.append(out - r * out[::-1], r)
    return out


class Arma:
    """A zero-mean ARMA process in state-space form; its exact likelihood by the Kalman filter."""

    def __init__(self, ar: np.ndarray, ma: np.ndarray):
        self.ar, self.ma = ar, ma
        r = self.r = max(len(ar), len(ma) + 1)
        self.move = np.zeros((r, r))
        self.move[: len(ar), 0] = ar
        self.move[:-1, 1:] = np.eye(r - 1)
        self.shock = np.append(np.append(1.0, ma), np.zeros(r - 1 - len(ma)))
        noise = np.outer(self.shock, self.shock)
        self.spread = np.linalg.solve(np.eye(r * r) - np.kron(self.move, self.move), noise.ravel()).reshape(r, r)

    def filter(self, w: np.ndarray) -> tuple[float, float, np.ndarray]:
        """Variance of the shocks, log-likelihood with it put in, and the state ahead of the last value."""
        a, p, noise = np.zeros(self.r), self.spread, np.outer(self.shock, self.shock)
        square, log, steady = 0.0, 0.0, False
        for v in w:
            f = p[0, 0]
            error = v - a[0]
            square += error * error / f
            log += np.log(f)
            gain = p[:, 0] / f
            a = self.move @ (a + gain * error)
            if not steady:
                after = self.move @ (p - np.outer(gain, p[0])) @ self.move.T + noise
                steady, p = bool(np.abs(after - p).max() < 1e-12), after
        n = len(w)
        variance = max(square / n, 1e-300)
        return variance, -0.5 * (n * np.log(2 * np.pi * variance) + log + n), a

    def weights(self, count: int) -> np.ndarray:
        """How much a shock moves the next values."""
        out, state = [], self.shock
        for _ in range(count):
            out.append(state[0])
            state = self.move @ state
        return np.array(out)


def arima(y: np.ndarray, p: int, d: int, q: int, horizon: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Forecasts, standard deviations and AIC by exact maximum likelihood, with a mean (d = 0) or drift (d = 1)."""
    w = np.diff(y, d) if d else y
    mean = float(w.mean()) if d < 2 else 0.0
    scale = float(w.std()) or 1.0
    x = (w - mean) / scale

    def model(z: np.ndarray) -> Arma:
        return Arma(stationary(z[:p]), -stationary(z[p:]))

    z = nelder_mead(lambda z: -model(z).filter(x)[1], np.zeros(p + q), 150, 0.3) if p + q else np.zeros(0)
    best = model(z)
    variance, log, state = best.filter(x)
    out = []
    for _ in range(horizon):
        out.append(state[0])
        state = best.move @ state
    out, weights = np.array(out) * scale + mean, best.weights(horizon)
    for i in reversed(range(d)):
        out, weights = np.diff(y, i)[-1] + np.cumsum(out), np.cumsum(weights)
    return out, scale * np.sqrt(variance * np.cumsum(weights**2)), 2 * (p + q + 1 + (d < 2)) - 2 * (log - len(x) * np.log(scale))


def mackinnon_p(tau: float) -> float:
    """P of the Dickey-Fuller statistic with a constant."""
    if not np.isfinite(tau):
        return float("nan")
    #: Response surface of MacKinnon (1994), its ends and its powers from 0 on.
    if tau > 2.74 or tau < -18.83:
        return float(tau > 0)
    powers = (2.1659, 1.4412, 0.038269) if tau <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    return float(normal_cdf(np.array(sum(c * tau**i for i, c in enumerate(powers)))))


def dickey_fuller(y: np.ndarray) -> tuple[float, float, int]:
    """Statistic, p and lags of the augmented test with a constant; lags by AIC on a common sample. NaN for fewer than 8 values or a constant."""
    n = len(y)
    if n < 8 or np.ptp(y) == 0:
        return float("nan"), float("nan"), 0
    most = max(0, min(int(12 * (n / 100) ** 0.25), (n - 1) // 3 - 1))
    dy = np.diff(y)

    def regression(lags: int, start: int) -> tuple[float, float]:
        x = np.column_stack([np.ones(len(dy) - start), y[start:-1], *[dy[start - i : len(dy) - i] for i in range(1, lags + 1)]])
        v = dy[start:]
        q, r = np.linalg.qr(x)
        beta = np.linalg.solve(r, q.T @ v)
        sse = float(np.sum((v - x @ beta) ** 2))
        inverse = np.linalg.inv(r)
        error = np.sqrt(sse / (len(v) - x.shape[1]) * (inverse[1] @ inverse[1]))
        return float(beta[1] / error), len(v) * np.log(max(sse, 1e-300) / len(v)) + 2 * x.shape[1]

    try:
        lags = min(range(most + 1), key=lambda k: regression(k, most)[1])
        tau = regression(lags, lags)[0]
    except np.linalg.LinAlgError:
        return float("nan"), float("nan"), 0
    return tau, mackinnon_p(tau), lags


def auto_arima(y: np.ndarray, horizon: int, most: tuple[int, int, int] = (3, 2, 3)) -> tuple[np.ndarray, np.ndarray, float]:
    """The order of least AIC; differences are taken until the unit-root test rejects."""
    d = 0
    while d < most[1] and not dickey_fuller(np.diff(y, d) if d else y)[1] < 0.05 and np.ptp(np.diff(y, d)) > 0:
        d += 1
    found = [arima(y, p, d, q, horizon) for p in range(most[0] + 1) for q in range(most[2] + 1) if p + q < len(y) // 4]
    return min(found, key=lambda f: f[2] if np.isfinite(f[0]).all() else np.inf)


def adf(df: DataFrame, y: str, t: str, by: list[str]) -> DataFrame:
    """by, statistic, p, lags of the augmented Dickey-Fuller test of each series."""
    return _by_series(df, y, t, by, lambda v: pd.DataFrame([dickey_fuller(v)], columns=["statistic", "p", "lags"]), "statistic double, p double, lags int")


def seasons(df: DataFrame, y: str, t: str, by: list[str], most: int = 24) -> DataFrame:
    """by, period, strength: lags from 2 on at which the autocorrelations of the detrended series peak above 1.96 / sqrt(n)."""

    def run(v: np.ndarray) -> pd.DataFrame:
        n = len(v)
        top = max(2, min(most, n // 2))
        e = v - np.polyval(np.polyfit(np.arange(n), v, 1), np.arange(n)) if n > 1 else v * 0
        e = e - e.mean()
        size = float(e @ e)
        r = np.array([float(e[k:] @ e[: n - k]) / size for k in range(min(top + 2, n))]) if size > 0 else np.zeros(1)
        after = lambda k: r[k + 1] if k + 1 < len(r) else -np.inf
        found = [(k, float(r[k])) for k in range(2, min(top + 1, len(r))) if n >= 6 and r[k] > r[k - 1] and r[k] >= after(k) and r[k] > 1.96 / np.sqrt(n)]
        return pd.DataFrame(found, columns=["period", "strength"])

    return _by_series(df, y, t, by, run, "period int, strength double")


def _by_series(df: DataFrame, y: str, t: str, by: list[str], f: Callable[[np.ndarray], pd.DataFrame], columns: str) -> DataFrame:
    kinds = dict(df.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = f(group.sort_values(t)[y].to_numpy(float))
        for i, b in enumerate(by):
            out.insert(i, b, group[b].iloc[0])
        return out

    return df.select(*by, t, F.col(y).cast("double").alias(y)).filter(F.col(y).isNotNull()).groupBy(*by).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", " + columns)


def polynomial_trend(df: DataFrame, y: str, t: str, by: list[str], degree: int = 2) -> DataFrame:
    """by, coefficients (from the constant on, in periods 1, 2, ...) and r2: power sums are aggregated, a small system is solved for each series."""
    n = F.count("*").over(Window.partitionBy(*by))
    rows = df.select(*by, F.col(y).cast("double").alias("__y"), F.row_number().over(_order(by, t)).cast("double").alias("__i"), n.cast("double").alias("__n"))
    u = (2 * F.col("__i") - F.col("__n") - 1) / F.col("__n")  # between -1 and 1, which keeps the system well conditioned
    sums = [F.sum(F.pow(u, k)) for k in range(2 * degree + 1)] + [F.sum(F.col("__y") * F.pow(u, k)) for k in range(degree + 1)]
    s = rows.groupBy(*by).agg(F.array(*sums).alias("s"), F.max("__n").alias("n"), F.sum(F.col("__y") * F.col("__y")).alias("yy"))

    @F.pandas_udf("coefficients array<double>, r2 double")
    def solve(s: pd.Series, n: pd.Series, yy: pd.Series) -> pd.DataFrame:
        out = []
        for sums, count, square in zip(s, n, yy, strict=True):
            a = np.array([[sums[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
            b = np.array(sums[2 * degree + 1 :])
            c = np.linalg.lstsq(a, b, rcond=None)[0]
            total = square - b[0] ** 2 / count
            line = np.polynomial.Polynomial([-(count + 1) / count, 2 / count])
            out.append((np.polynomial.Polynomial(c)(line).coef.tolist(), 1 - (square - float(c @ b)) / total if total > 0 else None))
        return pd.DataFrame(out, columns=["coefficients", "r2"])

    return s.withColumn("f", solve("s", "n", "yy")).select(*by, "f.*")


MODELS = ("naive", "ses", "holt", "damped", "hw_additive", "hw_multiplicative", "arima")


def _forecast(y: np.ndarray, model: str, period: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and their standard deviations."""
    if model == "naive":
        return np.full(horizon, y[-1]), np.sqrt(np.mean(np.diff(y) ** 2) * np.arange(1, horizon + 1))
    if model == "arima":
        return auto_arima(y, horizon, (2, 1, 2))[:2]
    seasonal = model.startswith("hw")
    return Smoother(model != "ses", model == "damped", period if seasonal else 0, model == "hw_multiplicative").forecast(y, horizon)[1:]


def usable(y: np.ndarray, model: str, period: int) -> bool:
    if model.startswith("hw"):
        return period > 1 and len(y) >= 2 * period and (model == "hw_additive" or y.min() > 0)
    return len(y) >= (8 if model == "arima" else 3)


#: Levels of forecast intervals.
LEVELS = (0.8, 0.95)


def forecast(df: DataFrame, y: str, t: str, by: str, horizon: int, period: int = 0, models: tuple[str, ...] = MODELS, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """by, model, rmse, step, value, and low and high for each level: each model's holdout error (last fifth) and its forecast from the whole series.

    Series and models are exploded, so that a task fits one model to one series.
    """
    if any(not 0.5 <= v <= 0.999 for v in levels):
        raise ValueError("levels lie between 0.5 and 0.999")
    rows = df.select(F.col(by).alias("key"), F.col(t).alias("t"), F.col(y).cast("double").alias("y")).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    names = [f"{side}{round(100 * v)}" for v in sorted(set(levels)) for side in ("low", "high")]
    scores = [float(normal_score(np.array((1 + v) / 2))) * sign for v in sorted(set(levels)) for sign in (-1, 1)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values, model = group.sort_values("t").y.to_numpy(), group.model.iloc[0]
        hold = max(1, len(values) // 5)
        if not usable(values[:-hold], model, period):
            return pd.DataFrame({c: [] for c in ("key", "model", "rmse", "step", "value", *names)})
        rmse = float(np.sqrt(np.mean((values[-hold:] - _forecast(values[:-hold], model, period, hold)[0]) ** 2)))
        out, sd = _forecast(values, model, period, horizon)
        sides = {n: out + z * sd for n, z in zip(names, scores, strict=True)}
        return pd.DataFrame({"key": group.key.iloc[0], "model": model, "rmse": rmse, "step": np.arange(1, horizon + 1), "value": out} | sides)

    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key", "model").applyInPandas(run, f"key {kind}, model string, rmse double, step int, value double, {', '.join(f'{n} double' for n in names)}").withColumnRenamed("key", by)


def best_forecast(forecasts: DataFrame, by: str) -> DataFrame:
    """The forecast of the model with the least holdout error for each series."""
    return forecasts.withColumn("__n", F.rank().over(Window.partitionBy(by).orderBy("rmse", "model"))).filter("__n = 1").drop("__n")


def partial_autocorrelations(r: list[float]) -> Iterator[float]:
    """Durbin and Levinson's recursion on autocorrelations from lag 0."""
    phi: list[float] = []
    for k in range(1, len(r)):
        a = (r[k] - sum(p * r[k - 1 - i] for i, p in enumerate(phi))) / (1 - sum(p * r[i + 1] for i, p in enumerate(phi)))
        phi = [p - a * phi[k - 2 - i] for i, p in enumerate(phi)] + [a]
        yield a


def pacf(acf_rows: DataFrame, by: list[str]) -> DataFrame:
    """lag, r from the rows of acf: a few numbers for each series."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        r = group.sort_values("lag").r.tolist()
        out = [*partial_autocorrelations(r)]
        return pd.DataFrame({**{b: group[b].iloc[0] for b in by}, "lag": range(1, len(out) + 1), "r": out})

    schema = ", ".join(f"{b} {dict(acf_rows.dtypes)[b]}" for b in by) + ", lag int, r double"
    return acf_rows.groupBy(*by).applyInPandas(run, schema)
