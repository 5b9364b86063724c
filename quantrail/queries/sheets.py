"""Queries of spreadsheet functions of dates, texts, ranges and annuities over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, sheet, texts
from ..functions import finance as fin
from .common import query, r, round_all, rounded, table

ENDS = "(SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate + to_days((o_orderkey % 90)::INTEGER))::DATE AS b FROM orders)"
WORKING = "len(list_filter(generate_series(a, b, INTERVAL 1 DAY), lambda d: isodow(d) < 6))"
DUE = "(SELECT min(d)::DATE FROM (SELECT unnest(list_filter(generate_series(a + INTERVAL 1 DAY, a + INTERVAL 20 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6)[10:10]) AS d))"


@query(f"""
SELECT o_orderkey, {WORKING}::INTEGER AS working, list_filter(generate_series(a + INTERVAL 1 DAY, a + INTERVAL 20 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6)[10]::DATE AS due,
  last_day((a + INTERVAL 2 MONTH)::DATE) AS month_end, (dayofweek(a) + 1)::INTEGER AS weekday, date_diff('day', a, b)::INTEGER AS days, ((year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END)::INTEGER AS months,
  {r('(360 * (year(b) - year(a)) + 30 * (month(b) - month(a)) + (CASE WHEN day(b) = 31 AND day(a) >= 30 THEN 30 ELSE day(b) END) - least(day(a), 30)) / 360.0::DOUBLE', 9)} AS fraction FROM {ENDS}""")
def sheet_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.to_date("o_orderdate")
    b = F.date_add(a, (F.col("o_orderkey") % 90).cast("int"))
    out = table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.working_days(a, b).alias("working"), dates.working_day(a, 10).alias("due"), dates.end_of_month(a, 2).alias("month_end"), dates.weekday(a).alias("weekday"),
        dates.days(b, a).alias("days"), dates.difference(a, b, "M").cast("int").alias("months"), dates.year_fraction(a, b).alias("fraction"),
    )
    return round_all(out, 9)


@query("""
SELECT p_partkey, left(p_name, 4) AS head, right(p_name, 3) AS tail, substr(p_name, 3, 5) AS mid, replace(p_type, 'A', '-') AS swapped, nullif(strpos(p_type, 'E'), 0)::INTEGER AS found,
  nullif(strpos(lower(p_type), 'e'), 0)::INTEGER AS seen, repeat('*', (p_size % 5)::INTEGER) AS stars, p_brand || '/' || p_type AS joined, trim(regexp_replace('  ' || p_name || '  ' || p_brand, ' +', ' ', 'g')) AS trimmed FROM part""")
def sheet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", texts.left(name, 4).alias("head"), texts.right(name, 3).alias("tail"), texts.middle(name, 3, 5).alias("mid"), texts.substitute(kind, "A", "-").alias("swapped"), texts.find("E", kind).alias("found"),
        texts.search("e", kind).alias("seen"), texts.repeated(F.lit("*"), F.col("p_size") % 5).alias("stars"), texts.joined("/", True, F.col("p_brand"), kind).alias("joined"), texts.trim(F.concat(F.lit("  "), name, F.lit("  "), F.col("p_brand"))).alias("trimmed"),
    )


@query(f"""
WITH v AS (SELECT l_orderkey, list(l_extendedprice ORDER BY l_linenumber, l_partkey) AS y, list(l_quantity ORDER BY l_linenumber, l_partkey) AS x FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, {r("CASE WHEN len(y) > 1 THEN list_sum(list_transform(y, lambda v: (v - list_sum(y) / len(y)) * (v - list_sum(y) / len(y)))) / (len(y) - 1) END", 1)} AS variance, {r("list_aggregate(y, 'median')", 4)} AS median, list_reverse_sort(y)[2] AS second,
  {r("list_sum(list_transform(y, lambda v: abs(v - list_avg(y)))) / len(y)", 4)} AS spread, {r("exp(list_avg(list_transform(y, lambda v: ln(v))))", 3)} AS geometric FROM v""")
def sheet_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the lines of an order as a range; what one line leaves undefined is null."""
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))), lambda s: s["l_extendedprice"]).alias("y"))
    y = F.col("y")
    out = v.select("l_orderkey", sheet.variance(y).alias("variance"), sheet.median(y).alias("median"), sheet.largest_of(y, 2).alias("second"), sheet.mean_deviation(y).alias("spread"), sheet.geometric_mean(y).alias("geometric"))
    digits = {"variance": 1, "median": 4, "spread": 4, "geometric": 3}
    return out.select("l_orderkey", "second", *[rounded(c, d).alias(c) for c, d in digits.items()])


@query(f"""
WITH c AS (SELECT c_custkey, abs(c_acctbal) + 100 AS p FROM customer), l AS (SELECT *, p * 0.01 / (1 - power(1.01::DOUBLE, -24)) AS level FROM c),
b AS (SELECT *, p * power(1.01::DOUBLE, 5) - level * (power(1.01::DOUBLE, 5) - 1) / 0.01 AS owed FROM l)
SELECT c_custkey, {r('-owed * 0.01', 4)} AS interest, {r('-(level - owed * 0.01)', 4)} AS principal, 0.01::DOUBLE AS rate, {r('ln(2 * p / p) / ln(1.01::DOUBLE)', 4)} AS doubling FROM b""")
def sheet_annuities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixth of 24 payments, and the rate found again from the payment."""
    p = F.abs("c_acctbal") + 100
    rows = table(spark, sf_dir, "customer").repartition(spark.sparkContext.defaultParallelism)  # little data, much arithmetic
    out = rows.select("c_custkey", fin.ipmt(0.01, 6, 24, p).alias("interest"), fin.ppmt(0.01, 6, 24, p).alias("principal"), fin.rate(24, fin.pmt(0.01, 24, p), p).alias("rate"), fin.duration(0.01, p, 2 * p).alias("doubling"))
    return round_all(out, 4)
