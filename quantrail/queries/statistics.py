"""Queries of descriptive statistics, tests, fits and regressions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as d
from ..operators import fitting, lookup, ranking, regression, resampling
from ..operators import statistics as st
from .common import query, r, round_all, round_sql, rounded, table

DESCRIBED = ["mean", "sd", "skew", "kurt", "min", "max", "var", "cv", "range", "p05", "p10", "p25", "p50", "p75", "p90", "p95"]


def _percentile(x: str, p: float) -> str:
    """PERCENTILE.INC from order statistics, by the same formula as ranking.percentiles."""
    v, h = f"list({x} ORDER BY {x}) FILTER ({x} IS NOT NULL)", f"((count({x}) - 1)::DOUBLE * {p}::DOUBLE)"
    at = lambda k: f"({v})[floor({h})::BIGINT + {k}]"
    return f"({at(1)} + (coalesce({at(2)}, {at(1)}) - {at(1)}) * ({h} - floor({h})))"


def _describe_sql(source: str, x: str, by: str) -> str:
    return f"""
    SELECT {by}, count({x}) AS n, count(*) - count({x}) AS errors, avg({x}) AS mean, stddev_samp({x}) AS sd, skewness({x}) AS skew, kurtosis({x}) AS kurt, min({x}) AS min, max({x}) AS max,
      var_samp({x}) AS var, stddev_samp({x}) / abs(avg({x})) AS cv, max({x}) - min({x}) AS range,
      {', '.join(f'{_percentile(x, p / 100)} AS p{p:02d}' for p in (5, 10, 25, 50, 75, 90, 95))}
    FROM {source} GROUP BY {by}"""


@query(round_sql(_describe_sql("lineitem", "l_extendedprice", "l_returnflag"), DESCRIBED, ["l_returnflag", "n", "errors"], 2))
def describe_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(st.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), 2)


@query(round_sql(_describe_sql("(SELECT event_type, ln(value - 5) AS x FROM events WHERE value > 5 UNION ALL SELECT event_type, NULL FROM events WHERE value <= 5)", "x", "event_type"), DESCRIBED, ["event_type", "n", "errors"], 5))
def describe_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") > 5, F.ln(F.col("value") - 5)).alias("x"))
    return round_all(st.describe(df, "x", ["event_type"]), 5)


@query(f"SELECT p / 100.0::DOUBLE AS p, {r('quantile_cont(o_totalprice, list_value(' + ', '.join(f'{p / 100}' for p in range(1, 100)) + '))[p]', 6)} AS value FROM orders, range(1, 100) t(p) GROUP BY p")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 99 percentiles of a report, interpolated."""
    shares = [p / 100 for p in range(1, 100)]
    got = ranking.percentiles(table(spark, sf_dir, "orders"), "o_totalprice", shares)
    return got.select(F.posexplode("p").alias("i", "v")).select(((F.col("i") + 1) / 100.0).alias("p"), rounded("v", 6).alias("value"))


@query("WITH k AS (SELECT l_returnflag, l_quantity AS x, count(*) AS c FROM lineitem GROUP BY l_returnflag, l_quantity), m AS (SELECT *, max(c) OVER (PARTITION BY l_returnflag) AS m FROM k) SELECT l_returnflag, min(x) AS mode, max(c) AS times FROM m WHERE c = m GROUP BY l_returnflag")
def mode_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.mode(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


@query(f"""
WITH s AS (SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type),
c AS (SELECT event_type, least(floor((value - lo) / ((hi - lo) / 25)), 24)::INTEGER AS bin, count(*) AS count FROM events JOIN s USING (event_type) GROUP BY ALL),
e AS (SELECT s.*, b::INTEGER AS bin, coalesce(count, 0) AS count FROM s CROSS JOIN range(25) t(b) LEFT JOIN c ON c.event_type = s.event_type AND c.bin = b)
SELECT event_type, bin, count, {r('lo + bin * ((hi - lo) / 25)', 4)} AS "from", {r('lo + (bin + 1) * ((hi - lo) / 25)', 4)} AS "to", {r('count / n')} AS frequency,
  {r('sum(count) OVER (PARTITION BY event_type ORDER BY bin) / n')} AS cumulative FROM e""")
def histogram_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = st.histogram(table(spark, sf_dir, "events"), "value", ["event_type"], 25)
    return h.select("event_type", "bin", "count", rounded("from", 4).alias("from"), rounded("to", 4).alias("to"), rounded("frequency").alias("frequency"), rounded("cumulative").alias("cumulative"))


@query("SELECT (l_quantity - m)::INTEGER AS bin, count(*) AS count FROM lineitem, (SELECT min(l_quantity) AS m FROM lineitem) GROUP BY ALL")
def histogram_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer values over a short range get a bin each."""
    return st.histogram(table(spark, sf_dir, "lineitem"), "l_quantity").filter("count > 0").select("bin", "count")


@query()
def histogram_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.histogram(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])


@query(f"SELECT event_type, {r('avg(CASE WHEN value BETWEEN 20 AND 80 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS certainty FROM events GROUP BY event_type")
def certainty_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(st.certainty(table(spark, sf_dir, "events"), "value", 20, 80, ["event_type"]))


@query(f"WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events), g AS (SELECT i::INTEGER AS i, lo + i * ((hi - lo) / 40.0::DOUBLE) AS x, lo, hi, n FROM e, range(41) t(i)) SELECT i, {r('g.x', 4)} AS x, {r('(SELECT count(*) FROM events WHERE value <= g.x + 1e-9) / n')} AS share FROM g")
def empirical_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.ecdf(table(spark, sf_dir, "events"), "value", 41).select("i", rounded("x", 4).alias("x"), rounded("share").alias("share"))


@query(f"SELECT l_returnflag, count(*) AS n, {r('corr(l_quantity, l_extendedprice)')} AS r FROM lineitem GROUP BY l_returnflag")
def pearson_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(st.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


RANK = "rank() OVER (PARTITION BY {g} ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0::DOUBLE"


@query(f"SELECT l_returnflag, count(*) AS n, {r('corr(a, b)')} AS r FROM (SELECT l_returnflag, {RANK.format(g='l_returnflag', x='l_quantity')} AS a, {RANK.format(g='l_returnflag', x='l_extendedprice')} AS b FROM lineitem) GROUP BY l_returnflag")
def spearman_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(st.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query(f"""
WITH i AS (SELECT 'l_quantity' AS input, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'l_discount', l_discount, l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_tax, l_extendedprice FROM lineitem),
c AS (SELECT input, corr(a, b) AS rho FROM (SELECT input, {RANK.format(g='input', x='x')} AS a, {RANK.format(g='input', x='y')} AS b FROM i) GROUP BY input)
SELECT input, {r('rho')} AS rho, {r('rho * rho / (SELECT sum(rho * rho) FROM c)')} AS share FROM c""")
def sensitivity_of_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(st.sensitivity(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


@query(f"""
WITH s AS (SELECT count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'error') AS nb, avg(value) FILTER (event_type = 'click') AS ma, avg(value) FILTER (event_type = 'error') AS mb,
  var_samp(value) FILTER (event_type = 'click') AS va, var_samp(value) FILTER (event_type = 'error') AS vb FROM events), v AS (SELECT *, va / na AS a, vb / nb AS b FROM s WHERE na > 1 AND nb > 1)
SELECT {r('(ma - mb) / sqrt(a + b)')} AS t, {r('(a + b) * (a + b) / (a * a / (na - 1) + b * b / (nb - 1))', 3)} AS df FROM v""")
def welch_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = st.welch(table(spark, sf_dir, "events"), "value", "event_type", "click", "error")
    return w.select(rounded("t").alias("t"), rounded("df", 3).alias("df"))


@query()
def welch_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.welch(table(spark, sf_dir, "events"), "value", "event_type", "click", "error").select("t", "df", "p")


@query()
def mean_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.mean_interval(table(spark, sf_dir, "events"), "value", ["event_type"])


@query(f"WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events), c AS (SELECT event_type AS grp, least(floor((value - lo) / w), 19)::INTEGER AS bin, count(*) AS n FROM events, e GROUP BY ALL) SELECT grp, bin, {r('n / sum(n) OVER (PARTITION BY grp)')} AS frequency FROM c")
def overlay_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(st.overlay(table(spark, sf_dir, "events"), "value", "event_type"))


BOOTSTRAP = f"""
WITH s AS (SELECT value AS x, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events WHERE value IS NOT NULL), n AS (SELECT count(*) AS n FROM s),
h AS (SELECT floor(id / n)::INTEGER AS replicate, floor(((('0x' || substr(md5('1|boot|' || id), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0) * n)::INTEGER AS i FROM n, range(0, 200 * (SELECT n FROM n)) t(id))
SELECT replicate, {r('avg(x)')} AS estimate FROM h JOIN s USING (i) GROUP BY replicate"""


@query(BOOTSTRAP)
def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every event."""
    return round_all(resampling.bootstrap(table(spark, sf_dir, "events"), "value", "event_id", F.avg("x"), 200))


@query(f"""
WITH u AS (SELECT rep::INTEGER AS replicate, value, (('0x' || substr(md5('1|pois' || rep || '|' || event_id), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM events, range(20) t(rep)),
p(k, share) AS (SELECT k, exp(-1.0::DOUBLE) / factorial(k::INTEGER)::DOUBLE FROM range(19) t(k)), c AS (SELECT k, sum(share) OVER (ORDER BY k) AS upto FROM p),
w AS (SELECT replicate, value, (SELECT count(*) FROM c WHERE u > upto) AS weight FROM u)
SELECT replicate, {r('sum(weight * value) / sum(weight)', 4)} AS estimate FROM w WHERE weight > 0 GROUP BY replicate""")
def poisson_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = resampling.poisson_weights(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 20)
    return w.groupBy("replicate").agg(rounded(F.sum(F.col("weight") * F.col("value")) / F.sum("weight"), 4).alias("estimate"))


@query(f"WITH b AS ({BOOTSTRAP}) SELECT {r('avg(estimate)', 9)} AS estimate, {r('quantile_cont(estimate, 0.025)', 9)} AS low, {r('quantile_cont(estimate, 0.975)', 9)} AS high FROM b")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(resampling.interval(bootstrap_means(spark, sf_dir)), 9)


@query(f"SELECT count(*) AS n, {r('avg(p_retailprice)', 4)} AS mean, {r('stddev_pop(p_retailprice)', 4)} AS sd, {r('avg(ln(p_retailprice))')} AS log, {r('var_pop(ln(p_retailprice))', 8)} AS logvar, {r('1 / avg(p_retailprice)', 9)} AS rate, {r('median(p_retailprice)', 4)} AS median FROM part")
def fit_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sufficient statistics that the maximum likelihood estimates come from."""
    s = fitting.summary(table(spark, sf_dir, "part"), "p_retailprice")
    df = spark.createDataFrame([(s["n"], s["mean"], s["var"], s["log"], s["logvar"], s["median"])], "n long, mean double, var double, log double, logvar double, median double")
    return df.select("n", rounded("mean", 4).alias("mean"), rounded(F.sqrt("var"), 4).alias("sd"), rounded("log").alias("log"), rounded("logvar", 8).alias("logvar"), rounded(1 / F.col("mean"), 9).alias("rate"), rounded("median", 4).alias("median"))


@query()
def fit_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitting.fit(table(spark, sf_dir, "part"), "p_retailprice")


@query(f"WITH b AS (SELECT least(floor((1 - exp(-0.02::DOUBLE * value)) * 12), 11)::INTEGER AS bin, count(*) AS c FROM events GROUP BY ALL) SELECT {r('sum(c * c) * 12.0::DOUBLE / sum(c) - sum(c)', 3)} AS statistic, 12 AS bins, sum(c)::BIGINT AS n FROM b")
def chi_square_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(fitting.chi_square(table(spark, sf_dir, "events"), "value", d.exponential(0.02), 12).select("statistic", "bins", "n"), 3)


@query(f"""
WITH m AS (SELECT covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS byy,
  avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my FROM lineitem),
c AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS b1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS b2, * FROM m)
SELECT '(intercept)' AS term, {r('my - b1 * ma - b2 * mb', 3)} AS coefficient FROM c UNION ALL SELECT 'l_quantity', {r('b1', 3)} FROM c UNION ALL SELECT 'l_discount', {r('b2', 3)} FROM c""")
def regression_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = regression.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return regression.table(spark, f).select("term", rounded("coefficient", 3).alias("coefficient"))


ERRORS = f"""
WITH m AS (SELECT count(*) AS n, covar_pop(l_quantity, l_quantity) * count(*) AS aa, covar_pop(l_discount, l_discount) * count(*) AS bb, covar_pop(l_quantity, l_discount) * count(*) AS ab, covar_pop(l_quantity, l_extendedprice) * count(*) AS ay,
  covar_pop(l_discount, l_extendedprice) * count(*) AS byy, covar_pop(l_extendedprice, l_extendedprice) * count(*) AS yy FROM lineitem),
c AS (SELECT *, aa * bb - ab * ab AS d, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS b1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM m),
s AS (SELECT *, (yy - b1 * ay - b2 * byy) / (n - 3) AS s2 FROM c)
SELECT 'l_quantity' AS term, {r('sqrt(s2 * bb / d)', 4)} AS error, {r('b1 / sqrt(s2 * bb / d)', 4)} AS t FROM s UNION ALL SELECT 'l_discount', {r('sqrt(s2 * aa / d)', 4)}, {r('b2 / sqrt(s2 * aa / d)', 4)} FROM s"""


@query(ERRORS)
def regression_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard errors and t of both slopes."""
    fit = regression.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return round_all(regression.table(spark, fit).filter("term <> '(intercept)'").select("term", "error", "t"), 4)


@query()
def regression_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.table(spark, regression.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


@query()
def regression_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net price from quantity, discount, tax and gross price: those that matter enter."""
    df = table(spark, sf_dir, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return regression.table(spark, regression.stepwise(df, "net", ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]))


@query(f"SELECT event_type, {r('sum(s * s) / sum(e * e)')} AS dw FROM (SELECT event_type, e, e - lag(e) OVER (PARTITION BY event_type ORDER BY event_id) AS s FROM (SELECT event_type, event_id, value - avg(value) OVER (PARTITION BY event_type) AS e FROM events)) GROUP BY event_type")
def durbin_watson(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    means = df.groupBy("event_type").agg(F.avg("value").alias("m"))
    return round_all(regression.durbin_watson(df.join(means, "event_type").withColumn("e", F.col("value") - F.col("m")), "e", "event_id", ["event_type"]))


@query("SELECT o_orderkey, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup_exact(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "c_mktsegment", "c_custkey", "segment").select("o_orderkey", "segment")


@query("SELECT o_orderkey, arg_max(p, k) AS price FROM orders LEFT JOIN (SELECT p_retailprice * 100 AS k, min(p_retailprice) AS p FROM part GROUP BY 1) ON k <= o_totalprice GROUP BY o_orderkey")
def lookup_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest price band at or below each order's total."""
    bands = table(spark, sf_dir, "part").select((F.col("p_retailprice") * 100).alias("k"), "p_retailprice").groupBy("k").agg(F.min("p_retailprice").alias("p"))
    return lookup.lookup_below(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "k", "p", "price").select("o_orderkey", "price")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, {r('coalesce(sum(l_extendedprice), 0)', 1)} AS total, count(*) AS n, {r('avg(l_extendedprice)', 3)} AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem WHERE {c}" for n, c in {"returned": "l_returnflag = 'R'", "large": "l_quantity >= 40", "large returned": "l_quantity >= 40 AND l_returnflag = 'R'"}.items()))
def conditional_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, large = F.col("l_returnflag") == "R", F.col("l_quantity") >= 40
    t = lookup.conditional_totals(table(spark, sf_dir, "lineitem"), "l_extendedprice", {"returned": flag, "large": large, "large returned": flag & large})
    return t.select("name", rounded("total", 1).alias("total"), "n", rounded("mean", 3).alias("mean"), "least", "most")


@query(f"""
WITH s AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT i, {r("(i + 0.5) / n", 9)} AS p, x FROM s WHERE i % greatest(1, n // 400) = 0""")
def plot_points_of_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order statistics of a Q-Q plot of all prices."""
    return ranking.plot_points(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("i", rounded("p", 9).alias("p"), "x")


@query(f"""
WITH e AS (SELECT *, event_type AS t FROM events), q AS (SELECT t, {_percentile('value', 0.05)} AS lo, {_percentile('value', 0.95)} AS hi FROM e GROUP BY t)
SELECT t AS event_type, {r('lo', 4)} AS low, {r('hi', 4)} AS high, {r('(SELECT avg((value BETWEEN lo AND hi)::INTEGER) FROM e WHERE e.t = q.t)')} AS within, {r('(SELECT avg((value <= 50)::INTEGER) FROM e WHERE e.t = q.t)')} AS upto, {r('(SELECT avg((value >= 50)::INTEGER) FROM e WHERE e.t = q.t)')} AS beyond FROM q""")
def certainty_of_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of nine tenths of the values, and the shares within them, up to 50 and from 50 on."""
    events = table(spark, sf_dir, "events")
    bounds = st.certainty_bounds(events, "value", "two", 0.9, ["event_type"])
    inside = events.join(F.broadcast(bounds), "event_type").groupBy("event_type").agg(F.avg(F.when(F.col("value").between(F.col("low"), F.col("high")), 1.0).otherwise(0.0)).alias("within"))  # a row for each type
    sides = [st.tail_certainty(events, "value", m, 50, 50, ["event_type"]).withColumnRenamed("certainty", n) for m, n in (("left", "upto"), ("right", "beyond"))]
    out = bounds.join(inside, "event_type").join(sides[0], "event_type").join(sides[1], "event_type")
    return out.select("event_type", *[rounded(c, d).alias(c) for c, d in (("low", 4), ("high", 4), ("within", 6), ("upto", 6), ("beyond", 6))])


@query(f"""
WITH s AS (SELECT o_orderpriority AS g, avg(x) AS mean, {_percentile('x', 0.5)} AS median, stddev_samp(x) AS sd, {_percentile('x', 0.05)} AS p5, {_percentile('x', 0.1)} AS p10, {_percentile('x', 0.9)} AS p90, {_percentile('x', 0.95)} AS p95, avg((x > 150000)::INTEGER) AS above FROM (SELECT *, o_totalprice AS x FROM orders) GROUP BY ALL)
SELECT g AS o_orderpriority, statistic, {r('result', 3)} AS result FROM (SELECT g, mean, median, sd AS "stdDev", sd / abs(mean) AS cv, p5, p10, p90, p95, above AS "probAbove", 1 - above AS "probBelow" FROM s) UNPIVOT (result FOR statistic IN (mean, median, "stdDev", cv, p5, p10, p90, p95, "probAbove", "probBelow"))""")
def forecast_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.forecast_statistics(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"], 150_000)
    return out.withColumn("result", rounded("result", 3))


@query("""
WITH s AS (SELECT o_orderpriority AS g, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders GROUP BY 1),
k AS (SELECT *, greatest(10, least(100, ceil((hi - lo) / (2 * iqr / power(n, 1 / 3.0::DOUBLE)) - 1e-9)))::INTEGER AS k FROM s),
c AS (SELECT g, least(floor((o_totalprice - lo) / ((hi - lo) / k)), k - 1)::INTEGER AS bin, lo, (hi - lo) / k AS w, count(*) AS times FROM k JOIN orders ON o_orderpriority = g GROUP BY ALL)
SELECT g AS o_orderpriority, round(arg_max(lo + (bin + 0.5) * w, times * 1000 - bin), 4) AS mode, max(times) AS times FROM c GROUP BY g""")
def mode_of_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices are not whole numbers, so the mode is the middle of the fullest bin."""
    return st.mode(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]).withColumn("mode", F.round("mode", 4))
