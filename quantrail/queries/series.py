"""Queries of time series over the monthly totals of every order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeseries as ts
from .common import QUERIES, SQL, query, r, round_all, rounded, table

MONTHLY = "(SELECT o_orderpriority AS p, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS t, sum(o_totalprice) / 1000000 AS y FROM orders GROUP BY ALL)"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p, t, y: monthly totals of each priority."""
    t = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), t.cast("long").alias("t")).agg((F.sum("o_totalprice") / 1000000).alias("y"))


W = "(PARTITION BY p ORDER BY t)"


@query(f"SELECT p, t, {r('y')} AS y, {r('CASE WHEN row_number() OVER w > 6 THEN avg(y) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) END')} AS fitted FROM {MONTHLY} WINDOW w AS {W}")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(ts.moving_average(monthly(spark, sf_dir), "y", "t", 6, ["p"]))


CENTRED = f"SELECT *, CASE WHEN i > 6 AND i <= n - 6 THEN (sum(y) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) + sum(y) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 24 END AS trend FROM (SELECT *, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY p) AS n FROM {MONTHLY})"


@query(f"SELECT p, t, {r('y')} AS y, {r('trend')} AS trend FROM ({CENTRED})")
def centred_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(ts.centred_average(monthly(spark, sf_dir), "y", "t", 12, ["p"]))


def _decompose_sql(mul: bool) -> str:
    raw, norm = ("y / trend", "s / avg(s) OVER (PARTITION BY p)") if mul else ("y - trend", "s - avg(s) OVER (PARTITION BY p)")
    rest = "y / (trend * seasonal)" if mul else "y - trend - seasonal"
    return f"WITH c AS ({CENTRED}), s AS (SELECT p, (i - 1) % 12 AS phase, avg({raw}) AS s FROM c GROUP BY ALL), k AS (SELECT p, phase, {norm} AS seasonal FROM s) SELECT c.p, t, {r('seasonal')} AS seasonal, {r(rest)} AS residual FROM c JOIN k ON c.p = k.p AND (i - 1) % 12 = phase"


def _decompose(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_all(ts.decompose(monthly(spark, sf_dir), "y", "t", 12, ["p"], kind).select("p", "t", "seasonal", "residual"))

    QUERIES[f"decompose_{kind}"] = run
    SQL[f"decompose_{kind}"] = _decompose_sql(kind == "multiplicative")


for _kind in ("additive", "multiplicative"):
    _decompose(_kind)


@query(f"SELECT p, t, {r('d2')} AS y FROM (SELECT p, t, d - lag(d) OVER {W} AS d2 FROM (SELECT p, t, y - lag(y) OVER {W} AS d FROM {MONTHLY})) WHERE d2 IS NOT NULL")
def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(ts.difference(monthly(spark, sf_dir), "y", "t", ["p"], 2))


ACF = f"(WITH e AS (SELECT p, row_number() OVER {W} AS i, y - avg(y) OVER (PARTITION BY p) AS e FROM {MONTHLY}), v AS (SELECT p, sum(e * e) AS v, count(*) AS n FROM e GROUP BY p) SELECT a.p, k::INTEGER AS lag, any_value(n) AS n, sum(a.e * b.e) / any_value(v) AS r FROM e a, e b, v, range(13) g(k) WHERE a.p = b.p AND a.p = v.p AND a.i = b.i + k GROUP BY a.p, k)"


@query(f"SELECT p, lag, {r('r')} AS r FROM {ACF}")
def autocorrelations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(ts.acf(monthly(spark, sf_dir), "y", "t", 12, ["p"]))


@query(f"SELECT p, {r('any_value(n) * (any_value(n) + 2) * sum(r * r / (n - lag))', 4)} AS q, 12 AS lags FROM {ACF} WHERE lag > 0 GROUP BY p")
def ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(ts.ljung_box(monthly(spark, sf_dir), "y", "t", 12, ["p"]).select("p", "q", "lags"), 4)


@query()
def partial_autocorrelations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.pacf(ts.acf(monthly(spark, sf_dir), "y", "t", 12, ["p"]), ["p"])


@query(f"""
WITH f AS (SELECT p, t, y AS a, avg(y) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS f, row_number() OVER {W} AS i FROM {MONTHLY}), c AS (SELECT *, a - f AS e, lag(a) OVER {W} AS b FROM f WHERE i > 6)
SELECT p, {r('avg(abs(e))')} AS mae, {r('avg(e * e)')} AS mse, {r('avg(abs(e / a))')} AS mape, {r('avg(2 * abs(e) / (abs(a) + abs(f)))')} AS smape, {r('sqrt(avg(e * e))')} AS rmse,
  {r('sqrt(sum(power(e / b, 2)) / sum(power((a - b) / b, 2)))')} AS theil_u, {r('1 - sum(e * e) / (var_pop(a) * count(*))')} AS r2 FROM c GROUP BY p""")
def forecast_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = ts.moving_average(monthly(spark, sf_dir), "y", "t", 6, ["p"])
    return round_all(ts.error_metrics(fitted, "y", "fitted", "t", ["p"]))


def _trend(kind: str, u: str, v: str, back: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_all(ts.trend(monthly(spark, sf_dir), "y", "t", ["p"], kind))

    a = "exp(regr_intercept(v, u))" if back else "regr_intercept(v, u)"
    QUERIES[f"trend_{kind}"] = run
    SQL[f"trend_{kind}"] = f"SELECT p, {r(a)} AS a, {r('regr_slope(v, u)')} AS b, {r('regr_r2(v, u)')} AS r2 FROM (SELECT p, {u} AS u, {v} AS v FROM (SELECT p, y, row_number() OVER {W}::DOUBLE AS i FROM {MONTHLY})) GROUP BY p"


_trend("linear", "i", "y", False)
_trend("exponential", "i", "ln(y)", True)
_trend("logarithmic", "ln(i)", "y", False)
_trend("power", "ln(i)", "ln(y)", True)


@query(f"SELECT p, {r('sum(y * CASE WHEN i = 1 THEN power(0.7::DOUBLE, n - 1) ELSE 0.3 * power(0.7::DOUBLE, n - i) END)')} AS level FROM (SELECT p, y, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY p) AS n FROM {MONTHLY}) GROUP BY p")
def smoothed_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(ts.ses(monthly(spark, sf_dir), "y", "t", ["p"], 0.3))


@query()
def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.forecast(monthly(spark, sf_dir), "y", "t", "p", 6, 12)


@query()
def forecast_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.best_forecast(ts.forecast(monthly(spark, sf_dir), "y", "t", "p", 6, 12), "p").select("p", "model", rounded("rmse", 9).alias("rmse"), "step", "value")


@query(f"""
WITH m AS (SELECT o_orderpriority AS g, date_trunc('month', o_orderdate) AS d, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY ALL), n AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY d)::DOUBLE AS t FROM m),
s AS (SELECT g, count(*) AS n, max(t) AS m, avg(t) AS u, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, regr_sxx(y, t) AS uu, greatest(0, regr_syy(y, t) - regr_slope(y, t) * regr_sxy(y, t)) / (count(*) - 2) AS s2 FROM n GROUP BY g)
SELECT g, h::INTEGER AS step, {r('a + b * (m + h)', 5)} AS forecast, {r('sqrt(s2 * (1 + 1.0::DOUBLE / n + (m + h - u) * (m + h - u) / uu))', 5)} AS error FROM s, range(1, 7) x(h)""")
def trend_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a year beyond the last month of each priority, with the error of a new value."""
    months = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.trunc("o_orderdate", "month").alias("d")).agg((F.sum("o_totalprice") / 1e6).alias("y"))
    out = ts.trend_forecast(months, "y", "d", ["g"], 6)
    return out.select("g", "step", rounded("forecast", 5).alias("forecast"), rounded("error", 5).alias("error"))
