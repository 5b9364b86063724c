"""Queries of sampling, distributions, models, what-if analysis, processes and optimisation."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as d
from ..functions import catalogue, numeric
from ..functions.random import uniform, uniform_sql
from ..operators import processes, runner, sampling, whatif
from ..operators import statistics as st
from ..plans.models import MODELS, Model, discounted_sum
from .common import QUERIES, query, r, round_all, rounded, table

TRIALS = 2000


def revenue_model(base: float) -> Model:
    """Five years of an uncertain business: volume and price multipliers on a base revenue."""
    years = range(1, 6)
    return Model(
        "revenue",
        {"base": base, "volume": 1.0, "price": 1.0, "rate": 0.1},
        [
            {f"m{t}": f"base * volume * price * {d.num(1.02**t)} - base * volume * {d.num(0.7)} - base * {d.num(0.28)}" for t in years},
            {"npv": discounted_sum("rate", [f"(base * {d.num(-0.1)})", *[f"m{t}" for t in years]])},
        ],
        ["npv"],
        {"volume": d.triangular(0.7, 1.0, 1.2), "price": d.uniform(0.9, 1.15)},
    )


def _trials(names: list[str], trials: int, seed: int = 12345) -> str:
    return f"SELECT id AS trial, {', '.join(f'{uniform_sql(seed, n, 'id')} AS {n}' for n in names)} FROM range({trials}) t(id)"


def _flagship_sql() -> str:
    m = revenue_model(1.0)
    sampled = f"SELECT trial, base, {', '.join(f'{f.quantile_sql(f'u_{n}')} AS {n}' for n, f in m.assumptions.items())} FROM ({_trials([f'u_{n}' for n in m.assumptions], 5000)}), (SELECT sum(l_extendedprice * (1 - l_discount)) / count(DISTINCT year(l_shipdate)) AS base FROM lineitem)"
    done = m.sql(f"({sampled})", ["base", *m.assumptions])
    aggs = {"mean": "avg(npv)", "sd": "stddev_samp(npv)", "p05": "quantile_cont(npv, 0.05)", "p50": "quantile_cont(npv, 0.5)", "p95": "quantile_cont(npv, 0.95)"}
    loss = "avg(CASE WHEN npv < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"SELECT count(npv) AS n, {', '.join(f'{r(a, 1)} AS {k}' for k, a in aggs.items())}, {r(loss)} AS loss FROM ({done})"


@query(_flagship_sql())
def npv_of_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of the net present value of a year's revenue under uncertain volume and price."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    base = table(spark, sf_dir, "lineitem").agg((F.sum(net) / F.count_distinct(F.year("l_shipdate"))).alias("base"))  # one row
    m = revenue_model(1.0)
    u = sampling.uniforms(spark, 5000, [f"u_{n}" for n in m.assumptions])
    done = m.evaluate(u.select("trial", *[f.sample(f"u_{n}").alias(n) for n, f in m.assumptions.items()]).crossJoin(F.broadcast(base)))
    s = done.agg(F.count("npv").alias("n"), F.avg("npv").alias("mean"), F.stddev_samp("npv").alias("sd"), F.percentile("npv", F.array(*map(F.lit, (0.05, 0.5, 0.95)))).alias("p"), F.avg(F.when(F.col("npv") < 0, 1.0).otherwise(0.0)).alias("loss"))
    return s.select("n", rounded("mean", 1).alias("mean"), rounded("sd", 1).alias("sd"), *[rounded(F.col("p")[i], 1).alias(k) for i, k in enumerate(("p05", "p50", "p95"))], rounded("loss").alias("loss"))


def _u(name: str, key: str) -> str:
    """A keyed draw, as SQL."""
    return f"((('0x' || substr(md5('12345|{name}|' || {key}), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


@query(f"SELECT o_orderkey, {r(_u('a', 'o_orderkey'), 12)} AS a, {r(_u('b', 'o_orderkey'), 12)} AS b FROM orders")
def uniforms_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two draws for every order, keyed by it."""
    return round_all(table(spark, sf_dir, "orders").select("o_orderkey", uniform(12345, "a", "o_orderkey").alias("a"), uniform(12345, "b", "o_orderkey").alias("b")), 12)


#: Families at the lines' prices, with their quantile in u, cumulative share and density in v as published, for SQL.
CLOSED: dict[str, tuple[d.Family, str, str, str]] = {
    "uniform": (d.uniform(0, 4), "4 * u", "least(v / 4, 1)", "CASE WHEN v <= 4 THEN 0.25 ELSE 0 END"),
    "exponential": (d.exponential(0.7), "-ln(1 - u) / 0.7", "1 - exp(-0.7 * v)", "0.7 * exp(-0.7 * v)"),
    "weibull": (d.weibull(1.5, 2), "2 * pow(-ln(1 - u), 1 / 1.5)", "1 - exp(-pow(v / 2, 1.5))", "0.75 * sqrt(v / 2) * exp(-pow(v / 2, 1.5))"),
    "logistic": (d.logistic(2, 0.5), "2 + 0.5 * ln(u / (1 - u))", "1 / (1 + exp(-(v - 2) * 2))", "2 * exp(-(v - 2) * 2) / pow(1 + exp(-(v - 2) * 2), 2)"),
    "gumbel": (d.gumbel(1, 0.6), "1 - 0.6 * ln(-ln(u))", "exp(-exp(-(v - 1) / 0.6))", "exp(-(v - 1) / 0.6 - exp(-(v - 1) / 0.6)) / 0.6"),
    "frechet": (d.frechet(2.5, 1), "pow(-ln(u), -0.4)", "exp(-pow(v, -2.5))", "2.5 * pow(v, -3.5) * exp(-pow(v, -2.5))"),
    "pareto": (d.pareto(2.5, 0.5), "0.5 / pow(1 - u, 0.4)", "CASE WHEN v > 0.5 THEN 1 - pow(0.5 / v, 2.5) ELSE 0 END", "CASE WHEN v >= 0.5 THEN 2.5 * pow(0.5, 2.5) / pow(v, 3.5) ELSE 0 END"),
    "laplace": (d.laplace(1.5, 0.8), "1.5 - 0.8 * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5))", "0.5 + 0.5 * sign(v - 1.5) * (1 - exp(-abs(v - 1.5) / 0.8))", "exp(-abs(v - 1.5) / 0.8) / 1.6"),
    "rayleigh": (d.rayleigh(1.2), "1.2 * sqrt(-2 * ln(1 - u))", "1 - exp(-v * v / 2.88)", "v / 1.44 * exp(-v * v / 2.88)"),
    "triangular": (d.triangular(0, 1, 4), "CASE WHEN u < 0.25 THEN sqrt(4 * u) ELSE 4 - sqrt(12 * (1 - u)) END", "CASE WHEN v < 1 THEN v * v / 4 WHEN v < 4 THEN 1 - pow(4 - v, 2) / 12 ELSE 1 END", "CASE WHEN v < 1 THEN v / 2 WHEN v < 4 THEN (4 - v) / 6 ELSE 0 END"),
    "cauchy": (d.cauchy(1, 0.5), "1 + 0.5 * tan(pi() * (u - 0.5))", "0.5 + atan((v - 1) / 0.5) / pi()", "1 / (pi() * 0.5 * (1 + pow((v - 1) / 0.5, 2)))"),
    "power": (d.power_function(2, 0, 7), "7 * sqrt(u)", "pow(v / 7, 2)", "2 * v / 49"),
    "arcsine": (d.arcsine(0, 7), "7 * pow(sin(pi() * u / 2), 2)", "2 / pi() * asin(sqrt(v / 7))", "1 / (pi() * sqrt(v * (7 - v)))"),
    "cosine": (d.cosine(0, 7), "7 * 2 / pi() * asin(sqrt(u))", "pow(sin(pi() * v / 14), 2)", "pi() / 14 * sin(pi() * v / 7)"),
    "trapezoidal": (d.trapezoidal(0, 1, 3, 4), "CASE WHEN u < 1 / 6.0 THEN sqrt(6 * u) WHEN u <= 5 / 6.0 THEN 0.5 + 3 * u ELSE 4 - sqrt(6 * (1 - u)) END", "CASE WHEN v < 1 THEN v * v / 6 WHEN v < 3 THEN (2 * v - 1) / 6 WHEN v < 4 THEN 1 - pow(4 - v, 2) / 6 ELSE 1 END", "CASE WHEN v < 1 THEN v / 3 WHEN v < 3 THEN 1 / 3.0 WHEN v < 4 THEN (4 - v) / 3 ELSE 0 END"),
    "geometric": (d.geometric(0.2), "ceil(ln(1 - u) / ln(0.8::DOUBLE)) - 1", "1 - pow(0.8, floor(v) + 1)", "CASE WHEN v = floor(v) THEN 0.2 * pow(0.8, v) ELSE 0 END"),
    "bernoulli": (d.bernoulli(0.3), "CASE WHEN u > 0.7 THEN 1 ELSE 0 END", "CASE WHEN v < 1 THEN 0.7 ELSE 1 END", "CASE WHEN v = 0 THEN 0.7 WHEN v = 1 THEN 0.3 ELSE 0 END"),
    "discreteUniform": (d.discrete_uniform(0, 6), "ceil(7 * u) - 1", "least(1, (floor(v) + 1) / 7)", "CASE WHEN v = floor(v) AND v <= 6 THEN 1 / 7.0 ELSE 0 END"),
}
_DIGITS = {"q": 4, "c": 6, "p": 6}
_CLOSED_SQL = " UNION ALL ".join(f"SELECT '{n}' AS family, l_linenumber, count(*) AS lines, {r(f'avg(({q})::DOUBLE)', 4)} AS q, {r(f'avg(({c})::DOUBLE)', 6)} AS c, {r(f'avg(({p})::DOUBLE)', 6)} AS p FROM f GROUP BY l_linenumber" for n, (_, q, c, p) in CLOSED.items())


@query(f"WITH f AS (SELECT l_linenumber, (l_quantity - 0.5) / 50 AS u, l_extendedprice / 20000 AS v FROM lineitem) {_CLOSED_SQL}")
def distributions_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantile, cumulative share and density of every family over all lines: quantiles at the quantity's share, the others at the price."""
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", ((F.col("l_quantity") - 0.5) / 50).alias("u"), (F.col("l_extendedprice") / 20000).alias("v"))
    aggs = [F.avg(F.expr(f"CAST({e} AS DOUBLE)")).alias(f"{n}_{k}") for n, (f, *_) in CLOSED.items() for k, e in (("q", f.quantile_sql("u")), ("c", f.cdf("v")), ("p", f.pdf("v")))]
    wide = lines.groupBy("l_linenumber").agg(F.count("*").alias("lines"), *aggs)
    long = wide.select("l_linenumber", "lines", F.explode(F.array(*[F.struct(F.lit(n).alias("family"), *[F.col(f"{n}_{k}").alias(k) for k in "qcp"]) for n in CLOSED])).alias("s"))
    return long.select("l_linenumber", "lines", "s.family", *[rounded(F.col(f"s.{k}"), digits).alias(k) for k, digits in _DIGITS.items()])


#: Families found by numbers, with cumulative share and density at a quantity v (1 to 50), in closed form for these parameters.
NUMERIC: dict[str, tuple[object, str, str]] = {
    "erlang": (numeric.erlang(3, 1 / 8), "1 - exp(-v / 8) * (1 + v / 8 + pow(v / 8, 2) / 2)", "pow(v, 2) * exp(-v / 8) / 1024"),
    "gamma": (numeric.gamma(2, 10), "1 - exp(-v / 10) * (1 + v / 10)", "v * exp(-v / 10) / 100"),
    "chiSquare": (numeric.chi_square(4), "1 - exp(-v / 2) * (1 + v / 2)", "v * exp(-v / 2) / 4"),
    "studentT": (numeric.student_t(2), "0.5 + v / (2 * sqrt(2 + v * v))", "pow(2 + v * v, -1.5)"),
    "f": (numeric.f(2, 4), "1 - pow(1 + v / 2, -2)", "pow(1 + v / 2, -3)"),
    "poisson": (numeric.poisson(20), "(SELECT sum(exp(k * ln(20::DOUBLE) - 20 - lgamma(k + 1))) FROM range(0, v::BIGINT + 1) t(k))", "exp(v * ln(20::DOUBLE) - 20 - lgamma(v + 1))"),
    "binomial": (numeric.binomial(60, 0.4), "(SELECT sum(exp(lgamma(61) - lgamma(k + 1) - lgamma(61 - k) + k * ln(0.4::DOUBLE) + (60 - k) * ln(0.6::DOUBLE))) FROM range(0, v::BIGINT + 1) t(k))", "exp(lgamma(61) - lgamma(v + 1) - lgamma(61 - v) + v * ln(0.4::DOUBLE) + (60 - v) * ln(0.6::DOUBLE))"),
}
_NUMERIC_SQL = " UNION ALL ".join(f"SELECT '{n}' AS family, v AS quantity, lines, {r(f'({c})::DOUBLE', 9)} AS share, {r(f'1 - ({c})::DOUBLE', 9)} AS rest, {r(f'({p})::DOUBLE', 9)} AS density FROM q" for n, (_, c, p) in NUMERIC.items())


@query(f"WITH q AS (SELECT l_quantity AS v, count(*) AS lines FROM lineitem GROUP BY 1) {_NUMERIC_SQL}")
def distributions_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tails and density at every quantity of families without closed forms in general; quantities are counted first."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("quantity")).agg(F.count("*").alias("lines"))
    out = None
    for name, (f, *_) in NUMERIC.items():
        one = counts.select(F.lit(name).alias("family"), "quantity", "lines", f.cdf_column("quantity").alias("share"), f.survival_column("quantity").alias("rest"), f.pdf_column("quantity").alias("density"))
        out = one if out is None else out.union(one)
    return round_all(out, 9, ("quantity",))


@query(f"SELECT o_orderkey, {r('-ln(exp(-0.5::DOUBLE) - ' + _u('a', 'o_orderkey') + ' * (exp(-0.5::DOUBLE) - exp(-2::DOUBLE))) / 0.05')} AS x FROM orders")
def truncated_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order a draw of an exponential between 10 and 40."""
    f = d.truncated(d.exponential(0.05), 10, 40)
    return table(spark, sf_dir, "orders").select("o_orderkey", uniform(12345, "a", "o_orderkey").alias("a")).select("o_orderkey", rounded(f.sample("a")).alias("x"))


@query(f"""
WITH c AS (
  SELECT c_custkey, 9000 + c_acctbal / 10 AS units, 250000 + c_nationkey * 1000 AS investment FROM customer
), t AS (
  SELECT c_custkey, investment, t, units * pow(1.05::DOUBLE, t - 1) AS q, pow(1.03::DOUBLE, t - 1) AS up, (investment - 25000) / 5.0::DOUBLE AS dep FROM c, range(1, 6) x(t)
), v AS (
  SELECT *, q * 26 * up AS rev, lead(q * 26 * up) OVER (PARTITION BY c_custkey ORDER BY t) AS following FROM t
), e AS (
  SELECT *, rev - q * 12 * up - 60000 * up - dep AS ebt FROM v
), f AS (
  SELECT c_custkey, investment, t, rev, ebt - 0.25 * greatest(0, ebt) + dep + CASE WHEN t < 5 THEN -0.1 * (following - rev) ELSE 25000 + 0.1 * rev END AS flow FROM e
)
SELECT c_custkey, {r("-max(investment) - 0.1 * max(rev) FILTER (t = 1) + sum(flow / pow(1.12::DOUBLE, t))", 3)} AS npv, true AS irr_is_a_root FROM f GROUP BY c_custkey""")
def model_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project model of every customer: net present value, and whether its internal rate makes that of its flows zero."""
    given = table(spark, sf_dir, "customer").select("c_custkey", (9000 + F.col("c_acctbal") / 10).alias("units"), (250000.0 + F.col("c_nationkey") * 1000).alias("investment"))
    done = MODELS["project"]().evaluate(given)
    at = functools.reduce(lambda total, t: F.col(f"fcf{t}") + total / (1 + F.col("irr")), range(4, -1, -1), F.col("fcf5"))
    return done.select("c_custkey", rounded("npv", 3).alias("npv"), (F.abs(at) < 1e-3).alias("irr_is_a_root"))


@query(f"""
SELECT l_linenumber, count(*) AS lines, {r("avg(least(l_quantity * 4, 100) * 50 - 3000 + greatest(100 - l_quantity * 4, 0) * 10 - greatest(l_quantity * 4 - 100, 0) * 5)", 3)} AS profit, {r("avg(least(l_quantity * 4, 100) / (l_quantity * 4))")} AS fill FROM lineitem GROUP BY l_linenumber""")
def model_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean profit and fill rate over the demand of all lines."""
    done = MODELS["inventory"]().evaluate(table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_quantity") * 4).alias("demand")))
    out = done.groupBy("l_linenumber").agg(F.count("*").alias("lines"), F.avg("profit").alias("p"), F.avg("fill").alias("f"))
    return out.select("l_linenumber", "lines", rounded("p", 3).alias("profit"), rounded("f").alias("fill"))


@query(f"""
WITH w AS (SELECT c_custkey, c_acctbal + 1000 AS invested, (c_nationkey + 1)::DOUBLE AS a FROM customer)
SELECT c_custkey, {r("(a * 0.11 + 0.25 * (0.09 + 0.055 + 0.03)) / (a + 0.75)", 9)} AS portfolio_return, {r("invested * (1 + (a * 0.11 + 0.25 * (0.09 + 0.055 + 0.03)) / (a + 0.75))", 6)} AS portfolio_value FROM w""")
def model_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's money, with a weight of local assets by nation."""
    done = MODELS["portfolio"]().evaluate(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") + 1000).alias("invested"), (F.col("c_nationkey") + 1.0).alias("w_local")))
    return done.select("c_custkey", rounded("portfolio_return", 9).alias("portfolio_return"), rounded("portfolio_value", 6).alias("portfolio_value"))


@query(f"""
WITH p AS (SELECT p_partkey, p_retailprice / 40 AS price, p_size % 3 > 0 AS ok FROM part),
f AS (SELECT p_partkey, ok, t, CASE WHEN ok THEN 20000 * pow(1.06::DOUBLE, t - 1) * (price - 22) ELSE 0 END AS m FROM p, range(1, 5) x(t)),
n AS (SELECT p_partkey, -500000 - CASE WHEN bool_and(ok) THEN 150000 ELSE 0 END + sum((m - 0.25 * greatest(0, m)) / pow(1.1::DOUBLE, t)) AS npv FROM f GROUP BY p_partkey)
SELECT p_partkey, {r("npv", 3)} AS npv, CASE WHEN npv > 0 THEN 1.0::DOUBLE ELSE 0 END AS success FROM n""")
def model_launch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The launch of every part, at a price of its own, two thirds of them approved."""
    given = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 40).alias("price"), F.when(F.col("p_size") % 3 > 0, 1.0).otherwise(0.0).alias("approval"))
    return MODELS["launch"]().evaluate(given).select("p_partkey", rounded("npv", 3).alias("npv"), "success")


#: Inputs of the loan that are spread by a fifth around their base values, by a hash of the customer.
LOAN_SPREAD = {"investment": 500000.0, "debt_share": 0.6, "spread": 0.03, "growth": 0.03, "tax": 0.25, "equity_rate": 0.15}


def _spread_sql(name: str) -> str:
    return f"{LOAN_SPREAD[name]!r}::DOUBLE * (0.8::DOUBLE + 0.4::DOUBLE * {uniform_sql(12345, f'u_{name}', 'c_custkey')}) AS {name}"


@query(f"""
WITH c AS (SELECT c_custkey, 160000 + c_acctbal AS ebitda, 0.06 + c_nationkey / 1000.0::DOUBLE AS base, {", ".join(map(_spread_sql, LOAN_SPREAD))} FROM customer),
i AS (SELECT *, base + spread AS i, investment * debt_share AS debt FROM c), l AS (SELECT *, debt * i / (1 - pow(1 + i, -5)) AS pay FROM i),
y AS (SELECT *, t, ebitda * pow(1 + growth, t - 1) AS e, i * (debt * pow(1 + i, t - 1) - pay * (pow(1 + i, t - 1) - 1) / i) AS interest FROM l, range(1, 6) x(t)),
f AS (SELECT *, e - tax * greatest(0, e - investment / 5 - interest) - pay AS flow, e / pay AS cover FROM y),
g AS (SELECT c_custkey, sum(flow / pow(1 + equity_rate, t)) AS later, min(cover) AS least_cover, max(investment - debt) AS f0, {", ".join(f"max(flow) FILTER (t = {t}) AS f{t}" for t in range(1, 6))} FROM f GROUP BY c_custkey),
n AS (SELECT *, list_reduce(list_resize([1.0::DOUBLE], 40, 0.0::DOUBLE), lambda x, _: x - (x * (f1 + x * (f2 + x * (f3 + x * (f4 + x * f5)))) - f0) / (f1 + x * (2 * f2 + x * (3 * f3 + x * (4 * f4 + x * 5 * f5))))) AS factor FROM g)
SELECT c_custkey, {r("later - f0", 3)} AS npv, {r("1 / factor - 1", 6)} AS irr, {r("least_cover", 6)} AS least_cover FROM n""")
def model_loan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase for every customer, with earnings by balance, a rate by nation and all other inputs spread: value, internal rate and least cover."""
    spread = [(base * (0.8 + 0.4 * uniform(12345, f"u_{n}", "c_custkey"))).alias(n) for n, base in LOAN_SPREAD.items()]
    given = table(spark, sf_dir, "customer").select("c_custkey", (160000 + F.col("c_acctbal")).alias("ebitda"), (0.06 + F.col("c_nationkey") / 1000).alias("base_rate"), *spread)
    done = MODELS["loan"]().evaluate(sampling.cut(given))  # hashes stand in many cells
    return done.select("c_custkey", rounded("npv", 3).alias("npv"), rounded("irr").alias("irr"), rounded("least_cover").alias("least_cover"))


#: Base values of the simulated models, each one row of a table's totals.
GIVEN = {
    "project": ("lineitem", "avg(l_extendedprice) * 1.5 AS fixed_cost"),
    "inventory": ("lineitem", "avg(l_quantity) * 4 AS ordered"),
    "portfolio": ("customer", "sum(c_acctbal) AS invested"),
    "launch": ("part", "avg(p_retailprice) / 60 AS unit_cost"),
    "loan": ("orders", "avg(o_totalprice) * 2 AS investment"),
}


def _simulation(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m, (source, base) = MODELS[name](), GIVEN[name]
        given = table(spark, sf_dir, source).agg(F.expr(base))
        done = sampling.simulate(spark, m, TRIALS, method="lhs", given=given)
        long = done.select(F.explode(F.array(*[F.struct(F.lit(o).alias("forecast"), F.col(o).cast("double").alias("x")) for o in m.outputs])).alias("f")).select("f.*")
        return st.describe(long, "x", ["forecast"])

    QUERIES[f"simulate_{name}"] = run


for _name in MODELS:
    _simulation(_name)


@query("SELECT count(*) AS n, true AS near, true AS same_values FROM orders")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and customers of all orders, reordered to a rank correlation of 0.6: how near it is, and that the values stay."""
    orders = table(spark, sf_dir, "orders")
    df = sampling.numbered(orders.select("o_orderkey", F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b")), "o_orderkey").drop("o_orderkey")
    n = df.count()
    out = sampling.cut(sampling.rank_correlate(df, ["a", "b"], np.array([[1, 0.6], [0.6, 1]]), n))
    sums = [x.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n")) for x in (df, out)]
    same = sums[0].select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("n").alias("m")).join(sums[1])  # two rows of totals
    found = st.spearman(out, "a", "b").select("n", (F.abs(F.col("r") - 0.6) < 0.05).alias("near"))
    return found.join(same.select((F.abs(F.col("x") / F.col("a") - 1) + F.abs(F.col("y") / F.col("b") - 1) + F.abs(F.col("m") - F.col("n")) < 1e-9).alias("same_values")))


@query("""
WITH t AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS done, o_totalprice AS x FROM orders), n AS (SELECT count(*) AS n FROM orders),
w AS (SELECT done, avg(x) OVER o AS mean, stddev_samp(x) OVER o AS sd FROM t WINDOW o AS (ORDER BY done ROWS UNBOUNDED PRECEDING))
SELECT coalesce(min(done) FILTER (done % 250 = 0 AND done >= 500 AND done < n AND 1.959963984540054 * sd / sqrt(done) <= 0.02 * abs(mean)), max(n))::BIGINT AS trials FROM w, n""")
def precision_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders, in the order of their keys, tell the mean price to two percent."""
    df = sampling.numbered(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("x")), "o_orderkey")
    n = df.count()
    stop = runner.stop_trial(df, runner.Precision("x", 0.02), total=n)
    return spark.createDataFrame([(n if stop is None else stop,)], "trials long")


#: A credit line: what each customer brings, by four inputs around their own base values.
CREDIT = Model("credit", {"line": 1.0, "used": 0.4, "margin": 0.18, "loss": 0.05}, [{"gain": "line * used * margin - line * loss * used * (1 + used)"}], ["gain"])
CREDIT_INPUTS = [*CREDIT.inputs]
_CREDIT_SQL = "SELECT c_custkey, c_mktsegment, c_acctbal + 2000 AS line, 0.4::DOUBLE AS used, 0.18::DOUBLE AS margin, 0.05::DOUBLE AS loss FROM customer"


def _moved(by: str) -> str:
    """Every input moved by itself, as SQL."""
    value = lambda n: f"({n} * CASE WHEN input = '{n}' THEN 1 + {by} ELSE 1 END)"
    return f"({value('line')} * {value('used')} * {value('margin')} - {value('line')} * {value('loss')} * {value('used')} * (1 + {value('used')}))"


def _credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") + 2000).alias("line"))


@query(f"""
WITH c AS ({_CREDIT_SQL}), s AS (SELECT c_custkey, input, {_moved('-0.1')} AS low, {_moved('0.1')} AS high FROM c, (SELECT unnest({CREDIT_INPUTS}) AS input))
SELECT c_custkey, input, {r('low', 4)} AS low, {r('high', 4)} AS high, {r('abs(high - low)', 4)} AS swing, {r('(high - low) * (high - low) / sum((high - low) * (high - low)) OVER (PARTITION BY c_custkey)', 6)} AS share FROM s""")
def tornado_loan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tornado of every customer's credit line around their own base values."""
    t = whatif.tornado_rows(_credit(spark, sf_dir), CREDIT, "gain", CREDIT_INPUTS, "c_custkey")
    return t.select("c_custkey", "input", *[rounded(c, 4).alias(c) for c in ("low", "high", "swing")], rounded("share").alias("share"))


SPIDER = [-0.2, -0.1, 0.0, 0.1, 0.2]


@query(f"WITH c AS ({_CREDIT_SQL}) SELECT c_mktsegment, input, p::DOUBLE AS position, {r('sum(' + _moved('p') + ')', 2)} AS value FROM c, (SELECT unnest({CREDIT_INPUTS}) AS input), (SELECT unnest({SPIDER}) AS p) GROUP BY ALL")
def spider_loan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the credit lines of a segment bring as each input moves by itself."""
    done = whatif.moved_rows(_credit(spark, sf_dir), CREDIT, CREDIT_INPUTS, SPIDER)
    return done.groupBy("c_mktsegment", "input", "position").agg(F.sum("gain").alias("g")).select("c_mktsegment", "input", "position", rounded("g", 2).alias("value"))


MARGINS, LOSSES = [0.1, 0.15, 0.2, 0.25], [0.02, 0.04, 0.06, 0.08]


@query(f"WITH c AS (SELECT c_mktsegment, c_acctbal + 2000 AS line FROM customer) SELECT c_mktsegment, m::DOUBLE AS margin, l::DOUBLE AS loss, {r('sum(line * 0.4 * m - line * l * 0.56)', 2)} AS value FROM c, (SELECT unnest({MARGINS}) AS m), (SELECT unnest({LOSSES}) AS l) GROUP BY ALL")
def two_way_loan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the credit lines of a segment bring over a grid of margins and losses."""
    done = whatif.two_way_rows(_credit(spark, sf_dir), CREDIT, "margin", MARGINS, "loss", LOSSES)
    return done.groupBy("c_mktsegment", "margin", "loss").agg(F.sum("gain").alias("g")).select("c_mktsegment", "margin", "loss", rounded("g", 2).alias("value"))


INVENTORY = MODELS["inventory"]()
ORDERED = list(range(20, 201, 20))
_PROFIT = "least(l_quantity * 4, q) * 50 - q * 30 + greatest(q - l_quantity * 4, 0) * 10 - greatest(l_quantity * 4 - q, 0) * 5"
_STOCK = f"SELECT q::DOUBLE AS ordered, avg({_PROFIT}) AS mean, quantile_cont({_PROFIT}, 0.05) AS p05 FROM lineitem, (SELECT unnest({ORDERED})::DOUBLE AS q) GROUP BY q"


@query(f"SELECT ordered, {r('mean', 4)} AS mean, {r('p05', 4)} AS p05 FROM ({_STOCK})")
def optimise_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order quantity under the demand of all lines."""
    samples = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 4).alias("demand"))
    return round_all(whatif.optimise_grid(spark, INVENTORY, samples, "profit", "ordered", ORDERED), 4)


@query(f"WITH c AS (SELECT ordered, {r('mean', 4)} AS mean, {r('p05', 4)} AS p05 FROM ({_STOCK})) SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.mean >= a.mean AND -b.p05 <= -a.p05 AND (b.mean > a.mean OR -b.p05 < -a.p05))")
def efficient_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantities that no other beats in mean profit and in the bad case."""
    c = optimise_inventory(spark, sf_dir).withColumn("risk", -F.col("p05"))
    return whatif.frontier(c, "mean", "risk").drop("risk")


_MONTHS = "SELECT o_orderpriority AS g, date_trunc('month', o_orderdate) AS t, sum(o_totalprice) AS value FROM orders GROUP BY ALL"
_RETURNS = f"SELECT g, t, value, ln(value / lag(value) OVER (PARTITION BY g ORDER BY t)) AS x FROM ({_MONTHS})"
_GBM_SQL = f"""
WITH p AS (SELECT g, avg(x) AS m, stddev_samp(x) AS s, arg_min(value, t) AS start FROM ({_RETURNS}) GROUP BY g),
z AS (SELECT floor(id / 12)::BIGINT AS path, id % 12 + 1 AS step, {d.normal(0, 1).quantile_sql('u')} AS z FROM (SELECT id, {uniform_sql(1, 'z', 'id')} AS u FROM range(600) x(id))),
w AS (SELECT path, step, start * exp(m * step + s * sum(z) OVER (PARTITION BY path ORDER BY step)) AS value FROM z, p WHERE g = '1-URGENT'
  UNION ALL SELECT x, 0, start FROM range(50) y(x), p WHERE g = '1-URGENT')"""


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.trunc("o_orderdate", "month").alias("t")).agg(F.sum("o_totalprice").alias("value"))


def _urgent(spark: SparkSession, sf_dir: str) -> tuple[float, float, float]:
    """First month's total of urgent orders, and the drift and volatility of the months: three numbers."""
    months = _monthly(spark, sf_dir).filter("g = '1-URGENT'")
    found = processes.gbm_parameters(months, "value", "t", ["g"], 1 / 12).join(months.groupBy("g").agg(F.min_by("value", "t").alias("start")), "g").first()
    return found.start, found.drift, found.volatility


def _gbm(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, drift, volatility = _urgent(spark, sf_dir)
    return processes.gbm(spark, start, drift, volatility, 1 / 12, 12, 50)


@query(f"{_GBM_SQL} SELECT path, step, {r('value', 2)} AS value FROM w")
def process_gbm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of paths with the drift and volatility of the months of all urgent orders."""
    return round_all(_gbm(spark, sf_dir), 2)


@query(f"{_GBM_SQL} SELECT step, {', '.join(f'{r(f'quantile_cont(value, {p / 100})', 2)} AS p{p:02d}' for p in (5, 25, 50, 75, 95))} FROM w GROUP BY step")
def process_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(processes.fan(_gbm(spark, sf_dir)), 2)


@query(f"SELECT g, {r('avg(x) * 12 + pow(stddev_samp(x), 2) * 12 / 2')} AS drift, {r('stddev_samp(x) * sqrt(12)')} AS volatility FROM ({_RETURNS}) GROUP BY g")
def process_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift and volatility of the months of each priority."""
    return round_all(processes.gbm_parameters(_monthly(spark, sf_dir), "value", "t", ["g"], 1 / 12))


@query(f"""
WITH p AS (SELECT g, value AS y, lag(value) OVER (PARTITION BY g ORDER BY t) AS x FROM ({_MONTHS})),
s AS (SELECT g, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) AS yy, regr_sxy(y, x) AS xy, count(*) AS n FROM p WHERE x IS NOT NULL GROUP BY g),
k AS (SELECT *, CASE WHEN b > 0 AND b < 1 THEN b END AS k FROM s)
SELECT g, {r('a / (1 - k)', 2)} AS mean, {r('-ln(k) * 12')} AS speed, {r('sqrt((yy - k * xy) / (n - 2) * 2 * -ln(k) * 12 / (1 - k * k))', 2)} AS volatility FROM k""")
def process_mean_reverting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, speed and volatility of a mean reversion of the months of each priority; null where they have none."""
    out = processes.ou_parameters(_monthly(spark, sf_dir), "value", "t", ["g"], 1 / 12)
    return out.select("g", rounded("mean", 2).alias("mean"), rounded("speed").alias("speed"), rounded("volatility", 2).alias("volatility"))


@query()
def process_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fan of paths with jumps, started and moved as the months of urgent orders."""
    start, drift, volatility = _urgent(spark, sf_dir)
    return processes.fan(processes.jump_diffusion(spark, start, drift, volatility, 0.5, -0.1, 0.15, 1 / 12, 24, 200))


@query(f"""
WITH c AS ({_CREDIT_SQL}), v AS (SELECT c_custkey, line, used, margin, loss, unnest(['line+loss', 'used', 'margin']) AS input FROM c),
s AS (SELECT c_custkey, input, p, line * (CASE WHEN input = 'line+loss' THEN 1 + p ELSE 1 END) AS a, loss * (CASE WHEN input = 'line+loss' THEN 1 + p ELSE 1 END) AS b, used * (CASE WHEN input = 'used' THEN 1 + p ELSE 1 END) AS u, margin * (CASE WHEN input = 'margin' THEN 1 + p ELSE 1 END) AS m FROM v, (SELECT unnest([-0.1, 0.1]::DOUBLE[]) AS p))
SELECT c_custkey, input, {r('max(a * u * m - a * b * u * (1 + u)) FILTER (p < 0)', 4)} AS low, {r('max(a * u * m - a * b * u * (1 + u)) FILTER (p > 0)', 4)} AS high FROM s GROUP BY ALL""")
def tornado_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tornado of every customer's credit line, where the line and its losses move together."""
    t = whatif.tornado_rows(_credit(spark, sf_dir), CREDIT, "gain", CREDIT_INPUTS, "c_custkey", groups=[["line", "loss"]])
    return t.select("c_custkey", "input", *[rounded(c, 4).alias(c) for c in ("low", "high")])


@query("""
WITH p AS (SELECT p_partkey, p_size, p_retailprice AS price, p_retailprice + (p_size % 7 - 3) * 60 AS mode FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN mode < price * 0.9 OR mode > price * 1.1 THEN 'mode' ELSE '' END WHEN 1 THEN CASE WHEN p_size % 5 = 0 THEN 'stdDev' ELSE '' END
  WHEN 2 THEN concat_ws(',', CASE WHEN p_size % 2 = 1 THEN 'n' END, CASE WHEN p_size > 40 THEN 'p' END) ELSE 'id' END AS wrong FROM p""")
def specification_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's distribution, with the keys of all that is wrong with it."""
    k, size, price = F.col("p_partkey") % 4, F.col("p_size"), F.col("p_retailprice")
    family = F.when(k == 0, "triangular").when(k == 1, "normal").when(k == 2, "binomial").otherwise("other")
    pairs = lambda **v: F.create_map(*[x for n, c in v.items() for x in (F.lit(n), c.cast("double"))])
    values = F.when(k == 0, pairs(min=price * 0.9, mode=price + (size % 7 - 3) * 60, max=price * 1.1)).when(k == 1, pairs(mean=price, stdDev=size % 5)).otherwise(pairs(n=size / 2, p=size / 40))
    found = table(spark, sf_dir, "part").select("p_partkey", catalogue.errors_column(family, values).alias("e"))
    return found.select("p_partkey", F.array_join(F.transform("e", lambda x: x["key"]), ",").alias("wrong"))
