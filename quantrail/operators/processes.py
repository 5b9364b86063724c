"""Stochastic processes: every path and step is a row; shocks are hashed, sums are windows within a path."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distributions import normal
from ..functions.numeric import poisson
from ..functions.random import uniform
from .ranking import percentiles


def _total(move: Column) -> Column:
    """The sum of a path's moves so far."""
    return F.sum(move).over(Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))


def shocks(spark: SparkSession, paths: int, steps: int, seed: int, name: str = "z") -> DataFrame:
    """path, step from 1, z: independent normal shocks."""
    ids = spark.range(paths * steps).select(F.floor(F.col("id") / steps).alias("path"), (F.col("id") % steps + 1).alias("step"), uniform(seed, name, "id").alias("u"), "id")
    return ids.withColumn("z", normal(0, 1).sample("u"))


def _with_start(df: DataFrame, start: float, paths: int) -> DataFrame:
    first = df.sparkSession.range(paths).select(F.col("id").alias("path"), F.lit(0).cast("long").alias("step"), F.lit(float(start)).alias("value"))
    return df.select("path", "step", "value").union(first)


def gbm(spark: SparkSession, start: float, drift: float, volatility: float, dt: float, steps: int, paths: int, seed: int = 1) -> DataFrame:
    """Geometric Brownian motion, exact."""
    move = F.lit((drift - volatility**2 / 2) * dt) + F.lit(volatility * math.sqrt(dt)) * F.col("z")
    return _with_start(shocks(spark, paths, steps, seed).withColumn("value", F.lit(float(start)) * F.exp(_total(move))), start, paths)


def jump_diffusion(spark: SparkSession, start: float, drift: float, volatility: float, rate: float, jump_mean: float, jump_sd: float, dt: float, steps: int, paths: int, seed: int = 1) -> DataFrame:
    """Merton's jumps: a Poisson count for each step, the sum of its jumps normal given the count; the drift is compensated."""
    df = shocks(spark, paths, steps, seed).withColumns({"__u": uniform(seed, "count", "id"), "__v": uniform(seed, "jump", "id")})
    df = df.withColumn("__n", poisson(rate * dt).sample("__u") if rate * dt > 0 else F.lit(0.0)).withColumn("__j", F.expr(normal(0, 1).quantile("__v")))
    mean = math.exp(jump_mean + jump_sd**2 / 2) - 1
    move = F.lit((drift - volatility**2 / 2 - rate * mean) * dt) + F.lit(volatility * math.sqrt(dt)) * F.col("z") + F.col("__n") * jump_mean + F.sqrt(F.col("__n").cast("double")) * jump_sd * F.col("__j")
    return _with_start(df.withColumn("value", F.lit(float(start)) * F.exp(_total(move))), start, paths)


def ornstein_uhlenbeck(spark: SparkSession, start: float, mean: float, speed: float, volatility: float, dt: float, steps: int, paths: int, seed: int = 1) -> DataFrame:
    """Mean reversion, exact: the weighted sum of a path's shocks, by doubling its reach in windows over the path."""
    keep = math.exp(-speed * dt)
    sd = volatility * math.sqrt((1 - keep * keep) / (2 * speed)) if speed else volatility * math.sqrt(dt)
    path = Window.partitionBy("path").orderBy("step")
    df = shocks(spark, paths, steps, seed).withColumn("__s", F.lit(sd) * F.col("z"))
    reach = 1
    while reach < steps:
        df = df.withColumn("__s", F.col("__s") + keep**reach * F.coalesce(F.lag("__s", reach).over(path), F.lit(0.0)))
        reach *= 2
    value = F.lit(float(mean)) + F.pow(F.lit(keep), F.col("step")) * (start - mean) + F.col("__s")
    return _with_start(df.withColumn("value", value), start, paths)


def ou_parameters(df: DataFrame, value: str, t: str, by: list[str], dt: float) -> DataFrame:
    """mean, speed, volatility of each series from its first-order autoregression. NULL unless its slope is between 0 and 1."""
    rows = df.withColumn("__x", F.lag(value).over(Window.partitionBy(*by).orderBy(t))).filter("__x IS NOT NULL").withColumn("__y", F.col(value))
    s = rows.groupBy(*by).agg(F.regr_slope("__y", "__x").alias("b"), F.regr_intercept("__y", "__x").alias("a"), F.regr_syy("__y", "__x").alias("yy"), F.regr_sxy("__y", "__x").alias("xy"), F.count("*").alias("n"))
    b = F.when((F.col("b") > 0) & (F.col("b") < 1), F.col("b"))
    speed = -F.ln(b) / dt
    rest = F.greatest(F.lit(0.0), F.col("yy") - F.col("b") * F.col("xy")) / (F.col("n") - 2)
    return s.select(*by, (F.col("a") / (1 - b)).alias("mean"), speed.alias("speed"), F.sqrt(rest * 2 * speed / (1 - b * b)).alias("volatility"))


def fan(paths: DataFrame, levels: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """step, a column of each level's percentile over the paths."""
    return percentiles(paths, "value", levels, ["step"]).select("step", *[F.col("p")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(levels)])


def gbm_parameters(df: DataFrame, price: str, t: str, by: list[str], dt: float) -> DataFrame:
    """drift, volatility from log returns."""
    r = F.ln(F.col(price) / F.lag(price).over(Window.partitionBy(*by).orderBy(t)))
    s = df.withColumn("__r", r).groupBy(*by).agg(F.avg("__r").alias("m"), F.stddev_samp("__r").alias("s"))
    vol = F.col("s") / math.sqrt(dt)
    return s.select(*by, (F.col("m") / dt + vol * vol / 2).alias("drift"), vol.alias("volatility"))


