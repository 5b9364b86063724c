"""Queries of finance over customers, parts and monthly cash flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance as fin
from ..functions import sheet
from .common import query, r, round_all, round_sql, rounded, table

FLOWS_SQL = """
SELECT c_mktsegment AS segment, list_prepend(-sum(v) * 0.8, list(v ORDER BY y)) AS cf FROM (
  SELECT c_mktsegment, year(o_orderdate) AS y, floor(sum(o_totalprice)) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY c_mktsegment"""
#: One row for each flow, with its period.
LONG_SQL = f"SELECT segment, t - 1 AS t, cf[t] AS v, len(cf) - 1 AS n FROM ({FLOWS_SQL}), range(1, 30) g(t) WHERE t <= len(cf)"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment, cf: yearly order totals of a market segment after an outlay of four fifths of their sum."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    years = o.groupBy(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("y")).agg(F.floor(F.sum("o_totalprice")).cast("double").alias("v"))
    s = years.groupBy("segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "v"))), lambda x: x["v"]).alias("cf"), F.sum("v").alias("total"))
    return s.select("segment", F.concat(F.array(F.col("total") * -0.8), "cf").alias("cf"))


@query(f"""
WITH f AS ({LONG_SQL}), p AS (SELECT *, sum(v) OVER (PARTITION BY segment ORDER BY t) AS total, v / power(1.05, t) AS d FROM f),
q AS (SELECT *, sum(d) OVER (PARTITION BY segment ORDER BY t) AS dtotal FROM p),
s AS (SELECT segment, max(n) AS n, sum(d) AS npv, sum(d) - max(v) FILTER (t = 0) AS later, -max(v) FILTER (t = 0) AS out, sum(greatest(v, 0) * power(1.05, n - t)) AS back,
  min(t - total / v) FILTER (total >= 0 AND total - v < 0) AS payback, min(t - dtotal / d) FILTER (dtotal >= 0 AND dtotal - d < 0) AS dpayback FROM q GROUP BY segment)
SELECT segment, {r('npv', 1)} AS npv, {r('power(back / out, 1.0::DOUBLE / n) - 1')} AS mirr, {r('payback')} AS payback, {r("coalesce(dpayback, 'inf'::DOUBLE)")} AS discounted_payback, {r('later / out')} AS pi,
  {r('npv * 0.05 / (1 - power(1.05, -n))', 1)} AS eaa FROM s""")
def cash_flow_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = flows(spark, sf_dir).select("segment", *fin.indicators(0.05, F.col("cf")))
    return one.select("segment", rounded("npv", 1).alias("npv"), rounded("mirr").alias("mirr"), rounded("payback").alias("payback"), rounded("discounted_payback").alias("discounted_payback"), rounded("pi").alias("pi"), rounded("eaa", 1).alias("eaa"))


def _irr_sql(year: str = "t") -> str:
    """Sixty halvings of an interval that holds the one root."""
    return f"""
    WITH RECURSIVE f AS ({LONG_SQL}), b(segment, k, lo, hi) AS (
      SELECT DISTINCT segment, 0, -0.9::DOUBLE, 5.0::DOUBLE FROM f UNION ALL
      SELECT b.segment, k + 1, CASE WHEN (SELECT sum(v / power(1 + (lo + hi) / 2, {year})) FROM f WHERE f.segment = b.segment) > 0 THEN (lo + hi) / 2 ELSE lo END,
        CASE WHEN (SELECT sum(v / power(1 + (lo + hi) / 2, {year})) FROM f WHERE f.segment = b.segment) > 0 THEN hi ELSE (lo + hi) / 2 END FROM b WHERE k < 60)
    SELECT segment, {r('lo')} AS rate FROM b WHERE k = 60"""


@query(_irr_sql())
def internal_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("segment", rounded(fin.irr(F.col("cf"))).alias("rate"))


@query(_irr_sql("t * 300 / 365.0::DOUBLE"))
def internal_rate_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.transform("cf", lambda _, i: (i * 300).cast("double"))
    return flows(spark, sf_dir).select("segment", rounded(fin.xirr(F.col("cf"), days)).alias("rate"))


@query(f"SELECT segment, {r('sum(v / power(1.05, t * 300 / 365.0::DOUBLE))', 1)} AS xnpv, {r('sum(v / power(1.05, t + 1))', 1)} AS npv_excel FROM ({LONG_SQL}) GROUP BY segment")
def net_present_value_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.transform("cf", lambda _, i: (i * 300).cast("double"))
    return flows(spark, sf_dir).select("segment", rounded(fin.xnpv(0.05, F.col("cf"), days), 1).alias("xnpv"), rounded(fin.npv_excel(0.05, F.col("cf")), 1).alias("npv_excel"))


@query(f"SELECT segment, {r('i * 0.05', 4)} AS rate, {r('sum(v / power(1 + i * 0.05::DOUBLE, t))', 1)} AS npv FROM ({LONG_SQL}), range(13) g(i) GROUP BY segment, i")
def npv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fin.npv_profile(flows(spark, sf_dir), "cf", 0.6, 13)
    return p.select("segment", rounded("rate", 4).alias("rate"), rounded("npv", 1).alias("npv"))


TVM = ["pmt", "pv", "fv", "nper"]


@query(round_sql("""
SELECT c_custkey, -(c_acctbal * g) * 0.01 / (g - 1) AS pmt, 100 * (1 - 1 / g) / 0.01 AS pv, -(c_acctbal * g - 100 * (g - 1) / 0.01) AS fv, ln((100 - 0) / (100 - abs(c_acctbal) * 0.001)) / ln(1.001) AS nper
FROM customer, (SELECT power(1.01::DOUBLE, 36) AS g)""", TVM, ["c_custkey"], 3))
def time_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("c_acctbal")
    df = table(spark, sf_dir, "customer").select("c_custkey", fin.pmt(0.01, 36, p).alias("pmt"), fin.pv(0.01, 36, -100).alias("pv"), fin.fv(0.01, 36, -100, p).alias("fv"), fin.nper(0.001, -100, F.abs(p)).alias("nper"))
    return round_all(df, 3)


RATES = ["effective", "nominal", "real", "wacc", "capm", "beta"]


@query(round_sql("""
SELECT c_custkey, power(1 + x / 12, 12) - 1 AS effective, (power(1 + x, 1.0::DOUBLE / 12) - 1) * 12 AS nominal, (1 + x) / 1.03 - 1 AS real, 0.6 * x + 0.4 * 0.08 * (1 - 0.25) AS wacc, 0.02 + 1.2 * x + 0.01 AS capm, x * (1 + 0.75 * 0.5) AS beta
FROM (SELECT c_custkey, abs(c_acctbal) / 100000 AS x FROM customer)""", RATES, ["c_custkey"], 8))
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    df = table(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal") / 100000).alias("x"))
    df = df.select("c_custkey", fin.effect(x, 12).alias("effective"), fin.nominal(x, 12).alias("nominal"), fin.real_rate(x, 0.03).alias("real"), fin.wacc(60, 40, x, 0.08, 0.25).alias("wacc"), fin.capm(0.02, 1.2, x, 0.01).alias("capm"), fin.levered_beta(x, 0.5, 0.25).alias("beta"))
    return round_all(df, 8)


SCHEDULE = ["payment", "interest", "amortisation", "balance"]


def _loan_sql(method: str) -> str:
    if method == "french":
        rows = """SELECT k, 0 AS period, p, 0.0::DOUBLE AS payment, 0.0::DOUBLE AS interest, p AS balance FROM c UNION ALL
        SELECT k, period + 1, p, p * 0.02 / (1 - power(1.02, -12)), balance * 0.02, balance * 1.02 - p * 0.02 / (1 - power(1.02, -12)) FROM b WHERE period < 12"""
    elif method == "german":
        rows = "SELECT k, 0 AS period, p, 0.0::DOUBLE AS payment, 0.0::DOUBLE AS interest, p AS balance FROM c UNION ALL SELECT k, period + 1, p, p / 12 + balance * 0.02, balance * 0.02, balance - p / 12 FROM b WHERE period < 12"
    else:
        rows = "SELECT k, 0 AS period, p, 0.0::DOUBLE AS payment, 0.0::DOUBLE AS interest, p AS balance FROM c UNION ALL SELECT k, period + 1, p, p * 0.02 + CASE WHEN period = 11 THEN p ELSE 0 END, p * 0.02, CASE WHEN period = 11 THEN 0 ELSE p END FROM b WHERE period < 12"
    inner = f"WITH RECURSIVE c AS (SELECT c_custkey AS k, abs(c_acctbal) AS p FROM customer), b AS ({rows}) SELECT *, payment - interest AS amortisation FROM b"
    return round_sql(inner, SCHEDULE, ["k AS c_custkey", "period"], 6)


def _loan(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.abs("c_acctbal").alias("p"))
    return round_all(fin.loan_schedule(df, "p", 0.02, 12, method).select("c_custkey", "period", *SCHEDULE), 6)


@query(_loan_sql("french"))
def loan_french(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loan(spark, sf_dir, "french")


@query(_loan_sql("german"))
def loan_german(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loan(spark, sf_dir, "german")


@query(_loan_sql("american"))
def loan_american(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loan(spark, sf_dir, "american")


def _depreciation(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.sqrt("p_retailprice").alias("c"), (F.sqrt("p_retailprice") * 0.1).alias("s"))
    return round_all(fin.depreciation(df, "c", "s", 5, method).select("p_partkey", "year", "charge", "book"), 4)


PARTS = "(SELECT p_partkey, sqrt(p_retailprice) AS c, sqrt(p_retailprice) * 0.1 AS s FROM part)"


@query(round_sql(f"SELECT p_partkey, y::INTEGER AS year, (c - s) / 5 AS charge, c - (c - s) / 5 * y AS book FROM {PARTS}, range(1, 6) g(y)", ["charge", "book"], ["p_partkey", "year"], 4))
def depreciation_straight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depreciation(spark, sf_dir, "straight_line")


@query(round_sql(f"SELECT p_partkey, y::INTEGER AS year, (c - s) * (6 - y) / 15 AS charge, c - (c - s) * y * (11 - y) / 30 AS book FROM {PARTS}, range(1, 6) g(y)", ["charge", "book"], ["p_partkey", "year"], 4))
def depreciation_sum_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depreciation(spark, sf_dir, "sum_of_years")


@query(round_sql(f"SELECT p_partkey, y::INTEGER AS year, c * power(1 - q, y - 1) * q AS charge, c * power(1 - q, y) AS book FROM (SELECT *, floor((1 - power(s / c, 0.2)) * 1000 + 0.5) / 1000 AS q FROM {PARTS}), range(1, 6) g(y)", ["charge", "book"], ["p_partkey", "year"], 4))
def depreciation_declining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depreciation(spark, sf_dir, "declining")


@query(round_sql(f"""
WITH RECURSIVE b AS (SELECT p_partkey, c, s, 0 AS year, 0.0::DOUBLE AS charge, c AS book FROM {PARTS} UNION ALL
  SELECT p_partkey, c, s, year + 1, least(greatest(book * 0.4, (book - s) / (5 - year)), book - s), book - least(greatest(book * 0.4, (book - s) / (5 - year)), book - s) FROM b WHERE year < 5)
SELECT * FROM b WHERE year > 0""", ["charge", "book"], ["p_partkey", "year"], 4))
def depreciation_double_declining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depreciation(spark, sf_dir, "double_declining")


@query(f"""
WITH x AS (SELECT c_custkey, t, c_acctbal * sin(t::DOUBLE) AS x FROM customer, range(1, 6) g(t)),
c AS (SELECT *, sum(x) OVER (PARTITION BY c_custkey ORDER BY t) AS total FROM x), m AS (SELECT *, greatest(0, max(total) OVER (PARTITION BY c_custkey ORDER BY t)) - total AS carry FROM c)
SELECT c_custkey, t::INTEGER AS t, {r('0.25 * greatest(0, x - coalesce(lag(carry) OVER (PARTITION BY c_custkey ORDER BY t), 0))', 4)} AS tax FROM m""")
def carried_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    income = F.transform(F.array(*[F.lit(float(t)) for t in range(1, 6)]), lambda t: F.col("c_acctbal") * F.sin(t))
    df = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(fin.carried_tax(income, 0.25)).alias("i", "tax"))
    return df.select("c_custkey", (F.col("i") + 1).alias("t"), rounded("tax", 4).alias("tax"))


@query(f"SELECT p_partkey, {r('CASE WHEN p_retailprice - p_size * 30 > 0 THEN 50000 / (p_retailprice - p_size * 30) ELSE CAST(1e9 AS DOUBLE) END', 4)} AS units FROM part")
def break_even_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = fin.break_even(50000, F.col("p_retailprice"), F.col("p_size") * 30.0)
    return table(spark, sf_dir, "part").select("p_partkey", rounded(F.least(u, F.lit(1e9)), 4).alias("units"))


@query(f"WITH s AS (SELECT c_mktsegment, sum(c_nationkey + 1) AS p, sum((c_nationkey + 1) * c_acctbal) AS pv, sum((c_nationkey + 1) * c_acctbal * c_acctbal) AS pvv FROM customer GROUP BY 1), m AS (SELECT c_mktsegment, pv / p AS mean, sqrt(greatest(0, pvv / p - (pv / p) * (pv / p))) AS sd FROM s) SELECT c_mktsegment, {r('mean', 4)} AS mean, {r('sd', 4)} AS sd, {r('sd / abs(mean)')} AS cv FROM m")
def scenario_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fin.scenario_summary(table(spark, sf_dir, "customer").withColumn("p", F.col("c_nationkey") + 1.0), "p", "c_acctbal", ["c_mktsegment"])
    return s.select("c_mktsegment", rounded("mean", 4).alias("mean"), rounded("sd", 4).alias("sd"), rounded("cv").alias("cv"))


SHEET = ["rounded", "up", "down", "whole", "rest", "quotient", "root", "logarithm", "branch"]


@query(round_sql("""
SELECT c_custkey, sign(x) * floor(abs(x) * 10 + 0.5) / 10 AS rounded, sign(x) * ceil(abs(x) * 10) / 10 AS up, sign(x) * floor(abs(x) * 10) / 10 AS down, sign(x) * floor(abs(x)) AS whole,
  x - 7 * trunc(x / 7) AS rest, CASE WHEN k <> 0 THEN x / k END AS quotient, CASE WHEN x >= 0 THEN sqrt(CASE WHEN x >= 0 THEN x END) END AS root, CASE WHEN x > 0 THEN ln(CASE WHEN x > 0 THEN x END) / ln(10::DOUBLE) END AS logarithm,
  CASE WHEN k <> 0 THEN CASE WHEN x / k > 100 THEN 1.0 ELSE 2.0 END END AS branch, (CASE WHEN x >= 0 THEN 1 ELSE 0 END + CASE WHEN k <> 0 THEN 1 ELSE 0 END)::INTEGER AS numbers
FROM (SELECT c_custkey, c_acctbal AS x, c_nationkey AS k FROM customer)""", SHEET, ["c_custkey", "numbers"], 5))
def sheet_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, k = F.col("c_acctbal"), F.col("c_nationkey")
    quotient, root = sheet.divide(x, k), sheet.square_root(x)
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", sheet.round_half(x, 1).alias("rounded"), sheet.round_up(x, 1).alias("up"), sheet.round_down(x, 1).alias("down"), sheet.whole(x).alias("whole"), sheet.mod(x, 7).alias("rest"), quotient.alias("quotient"), root.alias("root"), sheet.log(x).alias("logarithm"),
        sheet.branch(quotient > 100, 1, 2).alias("branch"), sheet.count_numbers(root, quotient).alias("numbers"),
    )
    return round_all(df, 5)


@query(f"""
WITH p AS (SELECT c_custkey, 1.02 + (c_custkey % 30) / 100.0::DOUBLE AS x, 1.5 + c_nationkey / 100.0::DOUBLE AS y FROM customer)
SELECT c_custkey, 2 AS n, {r('x - 1', 5)} AS first, {r('y - 1', 5)} AS last FROM p""")
def all_internal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rates of flows that change sign twice, made for every customer from the two rates that they have."""
    rows = table(spark, sf_dir, "customer").repartition(spark.sparkContext.defaultParallelism)  # little data, much arithmetic
    p = rows.select("c_custkey", (F.abs("c_acctbal") + 1).alias("a"), (1.02 + F.col("c_custkey") % 30 / 100).alias("x"), (1.5 + F.col("c_nationkey") / 100).alias("y"))
    flows = F.array(-F.col("a"), F.col("a") * (F.col("x") + F.col("y")), -F.col("a") * F.col("x") * F.col("y"))
    found = p.select("c_custkey", fin.all_irrs(flows).alias("r"))
    return found.select("c_custkey", F.size("r").alias("n"), rounded(F.element_at("r", 1), 5).alias("first"), rounded(F.element_at("r", -1), 5).alias("last"))


@query(f"""
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS units, p_retailprice AS price, p_retailprice * 10 AS investment FROM part),
y AS (SELECT *, t, units * price - units * price * 0.4 - 100 - investment / 4 AS ebt FROM p, range(1, 5) x(t)),
c AS (SELECT *, sum(ebt) OVER w AS total, min(0) OVER w AS zero FROM y WINDOW w AS (PARTITION BY p_partkey ORDER BY t)),
l AS (SELECT *, greatest(0, total) - greatest(0, total - ebt) AS taxed FROM c)
SELECT p_partkey, {r('sum(ebt)', 3)} AS ebt, {r('-0.3 * sum(taxed)', 3)} AS taxes, {r('sum(ebt) - 0.3 * sum(taxed)', 3)} AS net FROM l GROUP BY p_partkey""")
def project_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project that every part would be: four even years, whose losses are carried forward."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("double")).alias("units"), F.array("p_retailprice").alias("price"), F.array(F.col("p_retailprice") * 0.4).alias("variable_cost"), F.array(F.lit(100.0)).alias("fixed_costs"), (F.col("p_retailprice") * 10).alias("investment"), F.lit(0.0).alias("working_capital"), F.lit(0.0).alias("salvage"), F.lit(0.3).alias("tax"))
    done = fin.project_cash_flow(p, 4, 4)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return done.select("p_partkey", *[rounded(total(c), 3).alias(n) for c, n in (("ebt", "ebt"), ("taxes", "taxes"), ("net_income", "net"))])
