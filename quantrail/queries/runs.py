"""Queries of runs that stop, and of black-box models. Their SQL is written out, not made from the library's expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as d
from ..functions.random import uniform, uniform_sql
from ..operators import runner, sampling
from ..plans import report as reports
from ..plans.models import Model
from .common import query, r, rounded, table

#: Trials that the run may take; it takes fewer.
ASKED = 50_000


def margin_model() -> Model:
    """A year's revenue under an uncertain volume and price, against fixed costs; growth is undefined where the year is too poor."""
    return Model(
        "margin",
        {"base": 1.0, "volume": 1.0, "price": 1.0},
        [{"profit": "base * volume * price - base * 0.6D", "growth": "CASE WHEN volume * price > 0.75D THEN ln(volume * price) END"}],
        ["profit", "growth"],
        {"volume": d.uniform(0.7, 1.2), "price": d.uniform(0.9, 1.15)},
    )


def _draw(name: str) -> str:
    return f"(('0x' || substr(md5('12345|u_{name}|' || id), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0"


@query(f"""
WITH b AS (
  SELECT sum(l_extendedprice * (1 - l_discount)) / count(DISTINCT year(l_shipdate)) AS base FROM lineitem
), t AS (
  SELECT id AS trial, base, (0.7::DOUBLE + 0.5::DOUBLE * {_draw("volume")}) * (0.9::DOUBLE + 0.25::DOUBLE * {_draw("price")}) AS share FROM range({ASKED}) x(id), b
), m AS (
  SELECT trial, base * share - base * 0.6::DOUBLE AS profit, CASE WHEN share > 0.75 THEN ln(share) END AS growth FROM t
), w AS (
  SELECT trial + 1 AS done, count(profit) OVER o AS n, avg(profit) OVER o AS mean, stddev_samp(profit) OVER o AS sd FROM m WINDOW o AS (ORDER BY trial ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT coalesce(min(done) FILTER (done % 250 = 0 AND done >= 500 AND done < {ASKED} AND 1.959963984540054 * sd / sqrt(n) <= 0.01 * abs(mean)), {ASKED}) AS stop FROM w
)
SELECT stop AS trials, stop < {ASKED} AS stopped, count(profit) AS n_profit, {r("avg(profit)", 1)} AS mean_profit, {r("stddev_samp(profit)", 1)} AS sd_profit, count(growth) AS n_growth, count(*) - count(growth) AS growth_errors, {r("avg(growth)", 6)} AS mean_growth
FROM m, s WHERE trial < stop GROUP BY stop""")
def run_until_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over a base value of all lineitems that stops when the mean profit is known to one percent; later trials and their errors don't count."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    base = table(spark, sf_dir, "lineitem").agg((F.sum(net) / F.count_distinct(F.year("l_shipdate"))).alias("base"))  # one row
    done = runner.run(spark, margin_model(), ASKED, runner.Precision("profit", 0.01), given=base)
    out = done.rows.agg(F.count("profit").alias("n_profit"), F.avg("profit").alias("m"), F.stddev_samp("profit").alias("s"), F.count("growth").alias("n_growth"), F.avg("growth").alias("g"))
    return out.select(F.lit(done.trials).cast("long").alias("trials"), F.lit(done.stopped).alias("stopped"), "n_profit", rounded("m", 1).alias("mean_profit"), rounded("s", 1).alias("sd_profit"), "n_growth", F.lit(done.states["growth"].errors).cast("long").alias("growth_errors"), rounded("g").alias("mean_growth"))


def priced(frame: pd.DataFrame) -> list[list[float]]:
    """A model that fails on some orders, gives too few values for others and a value that is not finite for some."""
    if (frame["o_orderkey"] % 97 == 0).any():
        raise ValueError("an order that the model can't price")
    price = frame["o_totalprice"].to_numpy(float)
    rows = np.stack([price * 0.9 - 100.0, np.log(price)], axis=1).tolist()
    for row, key in zip(rows, frame["o_orderkey"], strict=True):
        if key % 89 == 0:
            del row[1]
        elif key % 83 == 0:
            row[0] = float("inf")
    return rows


@query(f"""
SELECT o_orderkey, {r("CASE WHEN o_orderkey % 97 <> 0 AND (o_orderkey % 83 <> 0 OR o_orderkey % 89 = 0) THEN o_totalprice::DOUBLE * 0.9::DOUBLE - 100 END", 4)} AS value,
  {r("CASE WHEN o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 THEN ln(o_totalprice::DOUBLE) END", 6)} AS size, o_orderkey % 97 = 0 AS failed
FROM orders""")
def black_box_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python model of every order; orders on which it fails are marked and have no values, and cost no others theirs."""
    out = runner.black_box(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), priced, ["o_orderkey", "o_totalprice"], ["value", "size"])
    return out.select("o_orderkey", rounded("value", 4).alias("value"), rounded("size").alias("size"), "failed")


def _place(name: str) -> str:
    return f"row_number() OVER (ORDER BY {uniform_sql(12345, name + '#o', 'trial')}, trial) AS p{name}"


def _stratified(name: str) -> str:
    return r(f"((p{name} - 1 + {uniform_sql(12345, name + '#j', f'p{name}')}) / n)", 12)


@query(f"""
WITH t AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS trial, count(*) OVER () AS n FROM events), p AS (SELECT *, {_place("a")}, {_place("b")} FROM t)
SELECT event_id, {_stratified("a")} AS a, {_stratified("b")} AS b FROM p""")
def uniforms_lhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin hypercube draws for every event, in the order of two hashes: each of as many strata as there are events has one."""
    events = sampling.numbered(table(spark, sf_dir, "events").select("event_id"), "event_id")
    n = events.count()
    drawn = sampling.uniforms(spark, n, ["a", "b"], method="lhs", mixed={m: uniform(12345, f"{m}#o", "trial") for m in "ab"})
    return events.join(drawn, "trial").select("event_id", rounded("a", 12).alias("a"), rounded("b", 12).alias("b"))


@query(f"""
WITH b AS (SELECT sum(l_extendedprice * (1 - l_discount)) / count(DISTINCT year(l_shipdate)) AS base FROM lineitem), t AS (
  SELECT id AS trial, 0.7::DOUBLE + 0.5::DOUBLE * {_draw("volume")} AS volume, 0.9::DOUBLE + 0.25::DOUBLE * {_draw("price")} AS price FROM range(2000) x(id)
), m AS (SELECT volume, price, base * volume * price - base * 0.6::DOUBLE AS profit, CASE WHEN volume * price > 0.75 THEN ln(volume * price) END AS growth FROM t, b)
SELECT 'Forecasts' AS sheet, 4 AS row, 2 AS col, {r("avg(profit)", 1)} AS number FROM m UNION ALL SELECT 'Forecasts', 4, 3, {r("avg(growth)", 1)} FROM m
UNION ALL SELECT 'Forecasts', 3, 3, (count(*) - count(growth))::DOUBLE FROM m UNION ALL SELECT 'Forecasts', 3, 2, (count(*) - count(profit))::DOUBLE FROM m
UNION ALL SELECT 'Assumptions', 1, 2, {r("avg(volume)", 1)} FROM m UNION ALL SELECT 'Assumptions', 2, 2, {r("avg(price)", 1)} FROM m
UNION ALL SELECT 'Forecasts', 37, 2, {r("avg((profit < 0)::INTEGER)", 1)} FROM m UNION ALL SELECT 'Forecasts', 27, 2, {r("quantile_cont(profit, 0.5)", 1)} FROM m
UNION ALL SELECT 'Summary', 1, 2, count(*) FROM m""")
def report_of_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some cells of the report of a run over a base value of all lineitems; the whole report is a workbook's sheets."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    base = table(spark, sf_dir, "lineitem").agg((F.sum(net) / F.count_distinct(F.year("l_shipdate"))).alias("base"))  # one row
    model = margin_model()
    cells = reports.report(model, runner.run(spark, model, 2000, given=base))
    wanted = "sheet = 'Forecasts' AND (row IN (3, 4) AND col > 1 OR row IN (27, 37) AND col = 2) OR sheet = 'Assumptions' AND col = 2 OR sheet = 'Summary' AND row = 1 AND col = 2"
    return cells.filter(wanted).select("sheet", "row", "col", rounded("number", 1).alias("number"))
