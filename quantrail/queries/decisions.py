"""Queries of decisions: optimisers and frontiers over the tables, checked by SQL that tries every point of the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import optimise as o
from .common import query, r, rounded, table


def assortment(spark: SparkSession, sf_dir: str) -> o.Problem:
    """Which sizes of parts to keep and at what mark-up, if at most 60 % may be kept and their price must rise by 4 %."""
    parts = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"))

    def model(rows: DataFrame) -> DataFrame:
        kept = rows.withColumn("kept", F.col("size") <= F.col("cut"))
        gain = F.col("price") * (1 + F.col("mark")) * F.exp(-2.5 * F.col("mark") * F.col("mark")) - F.col("price") * 0.9
        return kept.withColumns({"gain": F.when(F.col("kept"), gain).otherwise(0.0), "ratio": F.when(F.col("kept"), 1 + F.col("mark")), "share": F.when(F.col("kept"), 1.0).otherwise(0.0)})

    limits = [o.Constraint("share", "avg(share)", "<=", 0.6), o.Constraint("ratio", "avg(ratio)", ">=", 1.04)]
    return o.Problem(model, parts, [o.Variable("cut", 1, 50, 1), o.Variable("mark", 0, 0.5, 0.02)], "sum(gain)", limits)


@query(f"""
WITH p AS (
  SELECT p_size::DOUBLE AS size, p_retailprice::DOUBLE AS price FROM part
), g AS (
  SELECT c::DOUBLE AS cut, (m * 2) / 100.0::DOUBLE AS mark FROM range(1, 51) a(c), range(26) b(m)
), e AS (
  SELECT cut, mark, sum(CASE WHEN size <= cut THEN price * (1 + mark) * exp(-2.5 * mark * mark) - price * 0.9 ELSE 0 END) AS value, avg((size <= cut)::INTEGER) AS share, avg(CASE WHEN size <= cut THEN 1 + mark END) AS ratio FROM p, g GROUP BY ALL
)
SELECT cut, mark, {r("value", 2)} AS value, {r("share")} AS share FROM e WHERE share <= 0.6 AND ratio >= 1.04 - 1e-6 ORDER BY value DESC, cut, mark LIMIT 1""")
def optimise_assortment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 1,300 points under two constraints, in at most 900 evaluations."""
    best = o.optimise(assortment(spark, sf_dir), budget=900)
    row = (best.x["cut"], best.x["mark"], best.value, best.constraints["share"])
    return spark.createDataFrame([row], "cut double, mark double, value double, share double").select("cut", "mark", rounded("value", 2).alias("value"), rounded("share").alias("share"))


#: Spending per customer that a campaign may take, for its frontier.
SPENDING = [0.5, 1.0, 2.0, 4.0, 8.0]


def campaign(spark: SparkSession, sf_dir: str) -> o.Problem:
    """Whom to make an offer, by balance, and how much; segments answer differently, and a customer's spending is limited."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("double").alias("balance"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 1.4).when(F.col("c_mktsegment") == "AUTOMOBILE", 0.7).otherwise(1.0).alias("answer"))

    def model(rows: DataFrame) -> DataFrame:
        there = F.col("balance") >= F.col("least")
        gain = F.col("answer") * (F.col("balance") + 2000) / 500 * (1 - F.exp(-0.3 * F.col("offer"))) - F.col("offer")
        return rows.withColumns({"gain": F.when(there, gain).otherwise(0.0), "cost": F.when(there, F.col("offer")).otherwise(0.0)})

    return o.Problem(model, rows, [o.Variable("least", -1000, 10_000, 250), o.Variable("offer", 0, 12, 0.5)], "avg(gain)", [o.Constraint("spending", "avg(cost)", "<=", 1.0)])


@query(f"""
WITH c AS (
  SELECT c_acctbal::DOUBLE AS balance, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1.4::DOUBLE WHEN c_mktsegment = 'AUTOMOBILE' THEN 0.7 ELSE 1 END AS answer FROM customer
), g AS (
  SELECT (b * 250 - 1000)::DOUBLE AS least, f / 2.0::DOUBLE AS offer FROM range(45) x(b), range(25) y(f)
), e AS (
  SELECT least, offer, avg(CASE WHEN balance >= least THEN answer * (balance + 2000) / 500 * (1 - exp(-0.3 * offer)) - offer ELSE 0 END) AS value, avg(CASE WHEN balance >= least THEN offer ELSE 0 END) AS cost FROM c, g GROUP BY ALL
)
SELECT spending::DOUBLE AS spending, {r("max(value)", 6)} AS value FROM e, (SELECT unnest({SPENDING}) AS spending) WHERE cost <= spending * (1 + 1e-6 / greatest(spending, 1)) GROUP BY spending""")
def frontier_of_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best mean gain for each limit of spending; all limits are searched together."""
    found = o.frontier(campaign(spark, sf_dir), "spending", SPENDING, budget=1100)
    return spark.createDataFrame([(s, b.value) for s, b in found], "spending double, value double").select("spending", rounded("value").alias("value"))


def stock(spark: SparkSession, sf_dir: str, step: float) -> o.Problem:
    """How much to stock of what lineitems ask for: a piece sold earns 10 and a piece stocked costs 6."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("demand"))
    return o.Problem(lambda x: x.withColumn("profit", 10 * F.least("demand", "stocked") - 6 * F.col("stocked")), rows, [o.Variable("stocked", 1, 50, step)], "avg(profit)")


_STOCK_SQL = f"WITH e AS (SELECT q::DOUBLE AS stocked, avg(10 * least(l_quantity::DOUBLE, q) - 6 * q) AS mean FROM lineitem, range(1, 51) g(q) GROUP BY q) SELECT stocked, {r('mean', 4)} AS mean FROM e ORDER BY mean DESC, stocked LIMIT 1"


def _stocked(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    best = o.optimise(stock(spark, sf_dir, 0 if algorithm == "simplex" else 1), algorithm, budget=200)
    return spark.createDataFrame([(best.x["stocked"], best.value)], "stocked double, mean double").select(rounded("stocked", 3).alias("stocked"), rounded("mean", 4).alias("mean"))


@query(_STOCK_SQL)
def search_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stocked(spark, sf_dir, "genetic")


@query(_STOCK_SQL)
def search_annealing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stocked(spark, sf_dir, "annealing")


@query(_STOCK_SQL)
def search_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all numbers, not whole ones alone; demands are whole, so the best stock is."""
    return _stocked(spark, sf_dir, "simplex")
