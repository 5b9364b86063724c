"""The project model against its published results, fits against known laws, and finance and series against known values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantrail.functions import distributions as d
from quantrail.functions import finance, numeric, special
from quantrail.operators import fitting, processes, ranking, regression, sampling, statistics, timeseries, whatif
from quantrail.plans.models import MODELS


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_project_with_its_base_values(spark):
    r = MODELS["project"]().evaluate(spark.range(1)).first()
    assert [round(r[f"fcf{t}"]) for t in range(6)] == [-276000, 69131, 76166, 83843, 92218, 164818]
    assert r.npv == pytest.approx(58250, abs=1) and r.irr == pytest.approx(0.191, abs=5e-4)
    assert r.pi == pytest.approx(1.21, abs=0.01) and r.eaa == pytest.approx(16159, abs=1)


def test_tornado_of_the_project(spark):
    model = MODELS["project"]()
    got = {r.input: (r.low, r.high) for r in whatif.tornado(spark, model, "npv", [*model.assumptions]).collect()}
    want = {"units": (-23374, 139874), "price": (-20586, 137086), "unit_cost": (83612, 14487), "investment": (69373, 28114), "rate": (73998, 43560)}
    for name, ends in want.items():
        assert got[name] == pytest.approx(ends, abs=3)


def test_simulated_project(spark):
    """Within sampling error of the published run of 10,000 trials."""
    model = MODELS["project"]()
    done = sampling.cut(sampling.simulate(spark, model, 10_000, method="lhs").select("trial", *model.assumptions, "npv", "irr"))
    s = statistics.describe(done, "npv").first()
    assert s.mean == pytest.approx(37387, abs=2500) and s.sd == pytest.approx(70370, rel=0.03) and s.skew == pytest.approx(0.14, abs=0.08)
    assert (s.p05, s.p50, s.p95) == pytest.approx((-74287, 35358, 157001), abs=5000)
    i = statistics.describe(done, "irr").first()
    assert (i.mean, i.sd, i.p05, i.p95) == pytest.approx((0.162, 0.082, 0.026, 0.297), abs=0.006)
    assert statistics.certainty(done, "npv", 0, math.inf).first().certainty == pytest.approx(0.697, abs=0.015)
    rho = {r.input: r.rho for r in statistics.sensitivity(done, [*model.assumptions], "npv").collect()}
    assert rho == pytest.approx({"units": 0.43, "price": 0.40, "unit_cost": -0.36, "investment": -0.20, "rate": -0.16}, abs=0.04)
    assert statistics.spearman(done, "units", "price").first().r == pytest.approx(-0.5, abs=0.03)
    strata = done.select(F.floor(d.normal(26, 2).cdf_column("price") * 10_000).alias("k")).distinct().count()
    assert strata > 9_900  # one draw in each stratum, up to rounding and truncation


def test_closed_form_families():
    """cdf inverts the quantile, tails add up to one, the density is the slope of the cdf, and the mean is that of the quantile."""
    for name, f in d.EXAMPLES.items():
        u = (np.arange(400) + 0.5) / 400
        x = [d.value(f.quantile(d.num(v))) for v in u]
        for v, at in zip(u[20::40], x[20::40], strict=True):
            below, density = d.value(f.cdf(d.num(at))), d.value(f.pdf(d.num(at)))
            assert below + d.value(f.survival_sql(d.num(at))) == pytest.approx(1)
            if f.discrete:
                assert below - density - 1e-9 < v <= below + 1e-9
            else:
                assert below == pytest.approx(v, abs=1e-9)
                h = 1e-5 * max(1.0, abs(at))
                sides = (d.value(f.cdf(d.num(at + h))) - d.value(f.cdf(d.num(at - h)))) / (2 * h)
                assert density == pytest.approx(sides, rel=1e-3)
        if math.isfinite(f.variance) and name not in ("pareto", "frechet"):
            assert np.mean(x) == pytest.approx(f.mean, abs=0.02 * math.sqrt(f.variance) + 1e-9)


def test_normal_tails():
    n = d.normal(0, 1)
    for z in (-30.0, -5.0, -0.4, 0.0, 0.3, 1.0, 5.0, 30.0):
        assert d.value(n.cdf(d.num(z))) == pytest.approx(math.erfc(-z / math.sqrt(2)) / 2, rel=1e-12)
        assert d.value(n.survival(d.num(z))) == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-12)


@pytest.mark.parametrize("name", sorted(numeric.EXAMPLES))
def test_numeric_densities(name):
    f = numeric.EXAMPLES[name]()
    x = f.quantile(np.array([0.05, 0.3, 0.5, 0.77, 0.95]))
    if f.discrete:
        assert f.pdf(x) == pytest.approx(f.cdf(x) - f.cdf(x - 1), rel=1e-9)
        assert f.survival(x) == pytest.approx(1 - f.cdf(x), abs=1e-12)
    else:
        assert f.pdf(x) == pytest.approx((f.cdf(x + 1e-5) - f.cdf(x - 1e-5)) / 2e-5, rel=1e-5)
        tail = f.quantile(np.array([1e-12, 1 - 2.0**-40]))
        assert f.cdf(tail[:1]) == pytest.approx(1e-12, rel=1e-6) and f.survival(tail[1:]) == pytest.approx(2.0**-40, rel=1e-6)


def test_truncation_by_bounds(spark):
    u = spark.range(1, 400).select((F.col("id") / 400).alias("u"))
    families = {"normal": d.truncated(d.normal(10, 2), 7, 12), "tail": d.truncated(d.normal(0, 1), 9), "geometric": d.truncated(d.geometric(0.2), 2, 6), "gamma": numeric.truncated(numeric.gamma(2.5, 3), 1, 10), "poisson": numeric.truncated(numeric.poisson(4.2), 2, 6)}
    for f in families.values():
        r = u.withColumn("x", f.sample("u")).withColumn("c", f.cdf_column("x")).withColumn("p", f.pdf_column("x")).agg(F.min("x"), F.max("x"), F.max(F.abs(F.col("c") - F.col("u"))), F.min(F.col("c") - F.col("u")), F.min("p")).first()
        assert r[0] >= f.low and r[1] <= f.high and r[4] > 0
        assert r[3] >= -1e-9 if f.discrete else r[2] < 1e-7
    mean, variance = fitting.moments(spark, families["normal"])
    a, b = -1.5, 1.0
    phi, mass = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi), (math.erf(b / math.sqrt(2)) - math.erf(a / math.sqrt(2))) / 2
    shift = (phi(a) - phi(b)) / mass
    assert mean == pytest.approx(10 + 2 * shift, abs=1e-8)
    assert variance == pytest.approx(4 * (1 + (a * phi(a) - b * phi(b)) / mass - shift**2), abs=1e-7)
    for empty in (lambda: d.truncated(d.uniform(0, 1), 2, 3), lambda: d.truncated(d.normal(0, 1), 60), lambda: numeric.truncated(numeric.beta(2, 2), 3, 4)):
        with pytest.raises(ValueError):
            empty()


def test_curves(spark):
    assert fitting.curve(spark, d.normal(0, 1)).count() == 200
    assert [r.x for r in fitting.curve(spark, numeric.binomial(4, 0.5)).orderBy("x").collect()] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("law", [("gamma", numeric.gamma(2.5, 3)), ("weibull", d.weibull(1.7, 50)), ("logistic", d.logistic(3, 1.5)), ("negativeBinomial", numeric.negative_binomial(3, 0.4))], ids=lambda law: law[0])
def test_fits_find_the_law(spark, law):
    """The fit is at least as likely as the law that the sample was made of, and no test rejects it."""
    name, f = law
    df = fitting.cut(spark.range(400).select(((F.col("id") + 0.5) / 400).alias("u")).select(f.sample("u").alias("x")))
    only = (name, "poisson") if f.discrete else (name, "normal", "exponential")
    got = fitting.fit(df, "x", only=only).collect()
    true = df.select(F.sum(f.log_pdf_column("x"))).first()[0]
    assert got[0].family == name and true - 1e-6 <= got[0].log_likelihood < true + 3
    assert got[0].aic == pytest.approx(2 * got[0].k - 2 * got[0].log_likelihood) and got[0].bic == pytest.approx(got[0].k * math.log(400) - 2 * got[0].log_likelihood)
    assert f.discrete or (got[0].ks_p > 0.99 and got[0].ad_p > 0.99 and got[-1].ad_p < 0.2)


def test_every_family_is_fitted(spark):
    x = spark.range(1, 120).select((F.col("id") * F.col("id") / 100 + 1).alias("x"))
    names = {r.family for r in fitting.fit(x, "x").collect()}
    assert names == set("normal lognormal uniform triangular pert beta gamma exponential weibull logistic studentT chiSquare f cauchy gumbel frechet pareto laplace rayleigh erlang arcsine cosine powerFunction trapezoidal".split())
    counts = spark.range(200).select((F.col("id") % 7 * (F.col("id") % 3)).cast("double").alias("x"))
    assert {r.family for r in fitting.fit(counts, "x").collect()} == {"binomial", "poisson", "geometric", "negativeBinomial", "discreteUniform"}
    assert [r.family for r in fitting.fit(spark.range(9).select(F.lit(4.0).alias("x")), "x").collect()] == ["fixed"]
    assert fitting.fit(spark.range(1).select(F.lit(4.0).alias("x")), "x").count() == 0


def test_probabilities_of_fit_tests(spark):
    assert fitting.kolmogorov_p(0.274, 10) == pytest.approx(1 - 0.6284796154565043)  # the example of the published method
    assert fitting.anderson_p(2.492, 10_000) == pytest.approx(0.05, abs=5e-4)
    df = spark.range(1000).select((-F.ln(1 - (F.col("id") + 0.5) / 1000) / 0.02).alias("x"))
    c = fitting.chi_square(df, "x", d.exponential(0.02), k=1).first()
    assert c.bins == math.ceil(2 * 1000**0.4) and c.df == c.bins - 2 and c.statistic < 1 and c.p > 0.99
    counts = spark.range(500).select(((F.col("id") + 0.5) / 500).alias("u")).select(numeric.poisson(4.2).sample("u").alias("x"))
    c = fitting.chi_square(counts, "x", numeric.poisson(4.2)).first()
    assert c.statistic < 3 and c.p > 0.9


def test_project_cash_flows(spark):
    def flows(borrowed=None, **more):
        inputs = dict(investment=100000.0, working_capital=20000.0, salvage=30000.0, tax=0.3) | more
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()], F.array(*[F.lit(float(1000 + 100 * i)) for i in range(5)]).alias("units"), *[F.array(F.lit(v)).alias(k) for k, v in (("price", 100.0), ("variable_cost", 40.0), ("fixed_costs", 20000.0))])
        return finance.project_cash_flow(df, 5, 10, loan=borrowed).first()

    r = flows()
    assert (r.free_cash_flow[0], r.free_cash_flow[1], r.free_cash_flow[5]) == pytest.approx((-120000, 31000, 103800))
    assert r.salvage_tax == pytest.approx([0, 0, 0, 0, 0, 6000])
    for method in ("french", "german", "american"):
        e = flows((method, 8), loan=60000.0, loan_rate=0.1)
        assert sum(e.repayment) == pytest.approx(-60000) and e.interest[1] == pytest.approx(-6000)
        assert e.shield[1] == pytest.approx(1800)
        assert e.equity_cash_flow == pytest.approx([a + b + c + s + p for a, b, c, s, p in zip(e.free_cash_flow, e.proceeds, e.interest, e.shield, e.repayment, strict=True)])


def test_dated_rates_and_units(spark):
    days = F.array(*map(F.lit, (0, 60, 303, 411, 456)))
    cf = F.array(*[F.lit(float(v)) for v in (-10000, 2750, 4250, 3250, 2750)])
    odd = F.array(*[F.lit(float(v)) for v in (90, -20, -50, 200, -20)])
    r = spark.range(1).select(finance.xnpv(0.09, cf, days).alias("v"), finance.xirr(cf, days).alias("r"), finance.xirr(odd, F.array(*[F.lit(365 * i) for i in range(5)])).alias("o"), finance.all_irrs(odd).alias("all"), finance.profitability(0.1, F.array(F.lit(100.0), F.lit(-110.0))).alias("pi")).first()
    assert (r.v, r.r) == pytest.approx((2086.647602, 0.373362535), abs=1e-6)
    assert r.pi == pytest.approx(-1) and any(abs(r.o - x) < 1e-6 for x in r.all)
    df = spark.createDataFrame([(1000.0, 100.0)], "c double, s double")
    got = finance.depreciation(df, "c", "s", 3, "units", [1, 2, 6]).orderBy("year").collect()
    assert [x.charge for x in got] == pytest.approx([100, 200, 600]) and got[-1].book == pytest.approx(100)


def test_special_values():
    assert special.digamma(np.array([1.0, 0.5])) == pytest.approx([-0.5772156649015329, -1.9635100260214235])
    assert special.trigamma(np.array([1.0])) == pytest.approx([math.pi**2 / 6])
    assert special.student_pq(np.array([-1.4711443212151227]), np.array([8.715682306789095]))[0] * 2 == pytest.approx([0.17641151930643237])
    assert special.chi_square_pq(np.array([7.814727903251179]), np.array([3.0]))[1] == pytest.approx([0.05])
    assert special.f_pq(np.array([4.256494729093748]), 2.0, 9.0)[1] == pytest.approx([0.05], abs=1e-6)
    assert special.gamma_pq(3.0, np.array([80.0]))[1] == pytest.approx([math.exp(-80) * (1 + 80 + 3200)], rel=1e-12)


def test_descriptive_statistics(spark):
    x = [3.2, 7.5, 1.1, 4.8, 9.9, 2.3, 6.6, 4.8, 12.4, 0.5, 5.7, 8.1]
    df = spark.createDataFrame([(v,) for v in [*x, None]], "x double")
    r = statistics.describe(df, "x").first()
    assert (r.n, r.errors, r.mean, r.sd, r.skew, r.kurt) == pytest.approx((12, 1, 5.575, 3.564758056306206, 0.3692949028619193, -0.33781554033776295))
    shares = [0, 0.01, 0.05, 0.1, 0.25, 0.33, 0.5, 0.75, 0.9, 0.95, 0.99, 1]
    assert ranking.percentiles(df, "x", shares).first().p == pytest.approx([0.5, 0.566, 0.83, 1.22, 2.975, 4.208, 5.25, 7.65, 9.72, 11.025, 12.125, 12.4])
    assert statistics.mean_interval(df, "x").first().half == pytest.approx(2.2009851600916384 * 3.564758056306206 / math.sqrt(12))
    two = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, 6.5)] + [("b", float(v)) for v in (2, 4, 6, 8, 10, 13, 1)], "g string, x double")
    w = statistics.welch(two, "x", "g", "a", "b").first()
    assert (w.t, w.df, w.p) == pytest.approx((-1.4711443212151227, 8.715682306789095, 0.17641151930643237))
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    assert [(v.t, v.p) for v in statistics.welch(flat, "x", "g", "a", "b").collect()] == [(-math.inf, 0.0)]
    assert [tuple(v) for v in statistics.histogram(flat.filter("g = 'b'"), "x").select("from", "to", "count").collect()] == [pytest.approx((1.99, 2.01, 2))]


def test_rank_correlation_with_ties_and_gaps(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 500).astype(float), rng.normal(size=500).round(1)
    gaps = [None if i % 17 == 0 else float(v) for i, v in enumerate(b)]
    df = spark.createDataFrame([(float(x), y, float(z)) for x, y, z in zip(a, gaps, a - b, strict=True)], "a double, b double, c double")

    def rho(x, y):
        keep = [i for i in range(500) if x[i] is not None and y[i] is not None]
        rank = lambda v: np.array([(sum(w < q for w in v) + (sum(w == q for w in v) + 1) / 2) for q in v])
        return np.corrcoef(rank([x[i] for i in keep]), rank([y[i] for i in keep]))[0, 1]

    c = [*(a - b)]
    assert statistics.spearman(df, "a", "b").first().r == pytest.approx(rho([*a], gaps))
    got = {r.input: r.rho for r in statistics.sensitivity(df, ["a", "b"], "c").collect()}
    assert got == pytest.approx({"a": rho([*a], c), "b": rho(gaps, c)})


def test_regression_against_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = 2 + x[:, 0] * 3 - x[:, 1] + rng.normal(size=200) * 0.5
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    fit = regression.ols(df, "y", ["a", "b", "c"])
    full = np.column_stack([np.ones(200), x])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    s2 = np.sum((y - full @ beta) ** 2) / 196
    assert fit.coefficients == pytest.approx(beta) and fit.errors == pytest.approx(np.sqrt(s2 * np.diag(np.linalg.inv(full.T @ full))))
    assert regression.stepwise(df, "y", ["a", "b", "c"]).names[1:3] == ["a", "b"]
    noise = regression.stepwise(df.withColumn("z", F.sin(F.col("c") * 1e4)), "z", ["a"], enter=1e-9)
    assert noise.names == ["(intercept)"] and noise.coefficients[0] == pytest.approx(df.agg(F.avg(F.sin(F.col("c") * 1e4))).first()[0])


def test_series_functions(spark):
    assert timeseries.Smoother().run(np.array([1.0, 2, 3]), 0.5, 0, 0, 1)[:2] == (pytest.approx([1, 1, 1.5]), pytest.approx(2.25))
    rng = np.random.default_rng(1)
    t = np.arange(1, 97)
    y = 100 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 1, 96)
    ahead = np.arange(97, 109)
    out, sd = timeseries._forecast(y, "hw_additive", 12, 12)
    assert np.abs(out - (100 + 0.5 * ahead + 10 * np.sin(2 * np.pi * ahead / 12))).max() < 1.5 and (np.diff(sd) >= -1e-12).all()
    e, w = rng.normal(size=1200), np.zeros(1200)
    for i in range(2, 1200):
        w[i] = 1.2 * w[i - 1] - 0.5 * w[i - 2] + e[i]
    z = timeseries.nelder_mead(lambda z: -timeseries.Arma(timeseries.stationary(z), np.zeros(0)).filter(w[200:])[1], np.zeros(2))
    assert timeseries.stationary(z) == pytest.approx([1.2, -0.5], abs=0.08)
    assert (timeseries.mackinnon_p(-2.86), timeseries.mackinnon_p(-3.43)) == pytest.approx((0.05, 0.01), abs=1e-3)
    rows = [("s", i, float(v)) for i, v in enumerate(y)] + [("w", i, float(v)) for i, v in enumerate(w[200:400])]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    assert {r.k: r.p < 0.05 for r in timeseries.adf(df, "y", "t", ["k"]).collect()}["w"]
    assert 12 in [r.period for r in timeseries.seasons(df.filter("k = 's'"), "y", "t", ["k"]).collect()]
    curve = spark.createDataFrame([("q", i, 3.0 + 2 * (i + 1) - 0.5 * (i + 1) ** 2) for i in range(20)], "k string, t int, y double")
    r = timeseries.polynomial_trend(curve, "y", "t", ["k"]).first()
    assert r.coefficients == pytest.approx([3, 2, -0.5]) and r.r2 == pytest.approx(1)


def test_processes(spark):
    paths = processes.ornstein_uhlenbeck(spark, 0, 5, 2, 1, 0.1, 100, 2000)
    end = paths.filter("step = 100").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).first()
    assert end.m == pytest.approx(5, abs=0.05) and end.v == pytest.approx(0.25, rel=0.1)
    jumps = processes.jump_diffusion(spark, 100, 0.05, 0.1, 60, 0.0, 0.05, 1.0, 2, 3000)
    assert jumps.filter("step = 2").agg(F.avg("value")).first()[0] == pytest.approx(100 * math.exp(0.1), rel=0.05)
    spread = jumps.filter("step = 1").agg(F.var_samp(F.ln(F.col("value") / 100))).first()[0]
    assert spread == pytest.approx(0.01 + 60 * 0.0025, rel=0.1)  # 60 jumps a step
    got = processes.ou_parameters(processes.ornstein_uhlenbeck(spark, 5, 5, 2, 1, 0.1, 4000, 1), "value", "step", ["path"], 0.1).first()
    assert (got["mean"], got["speed"], got["volatility"]) == (pytest.approx(5, abs=0.2), pytest.approx(2, rel=0.2), pytest.approx(1, rel=0.05))


def test_chi_square_of_distant_whole_numbers(spark):
    """A value far from the others costs no row for each number between; bins are those of the greedy walk over all numbers."""
    rng = np.random.default_rng(3)
    few = rng.geometric(0.02, 2000) - 1
    df = spark.createDataFrame([(float(v),) for v in few], "x double")
    family = d.geometric(0.02)
    got = fitting.chi_square(df, "x", family).first()
    sums, seen, before, n = [], 0, 0.0, len(few)
    for x in range(few.min(), few.max() + 1):
        seen += (few == x).sum()
        share = 1.0 if x == few.max() else 1 - 0.98 ** (x + 1)
        if n * (share - before) >= 5:
            sums.append([seen, n * (share - before)])
            seen, before = 0, share
    if before < 1:
        sums[-1] = [sums[-1][0] + seen, sums[-1][1] + n * (1 - before)]
    assert got.bins == len(sums) and got.statistic == pytest.approx(sum((o - e) ** 2 / e for o, e in sums))
    far = fitting.chi_square(spark.createDataFrame([(float(v),) for v in [*few, 10**10]], "x double"), "x", family).first()
    assert far.n == 2001 and far.statistic > 0
    wide = fitting.chi_square(spark.createDataFrame([(float(v),) for v in rng.geometric(1e-6, 300) - 1], "x double"), "x", d.geometric(1e-6)).first()
    assert 20 < wide.bins <= 60 and wide.p > 1e-4


def test_rank_correlation_reorders_values_by_numbers(spark):
    """Scores are hashed once, not in every shuffle of the result; ties and nulls stay; equal values are dealt to several ranges, numbered in the order of the trials."""
    from quantrail.operators import sampling

    df = spark.range(6000).selectExpr("id AS trial", "round(cos(id) * 50) AS a", "CASE WHEN id % 50 > 0 THEN sin(id * 7) END AS b", "concat('t', id) AS note").repartition(3)
    out = sampling.rank_correlate(df, ["a", "b"], np.array([[1, -0.5], [-0.5, 1]]), 6000)
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()
    before, after = df.collect(), out.collect()
    assert {r.trial: r.note for r in after} == {r.trial: r.note for r in before} and len(after) == 6000
    for c in "ab":
        assert sorted((r[c] is None, r[c] or 0) for r in after) == sorted((r[c] is None, r[c] or 0) for r in before)
    assert statistics.spearman(out, "a", "b").first().r == pytest.approx(-0.5, abs=0.05)
    flat = spark.range(20_000, -1, -1).selectExpr("id AS trial", "1.0D AS v")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        placed = sampling.numbered(flat, "v", "trial", name="place")
    finally:
        spark.conf.unset(setting)
    assert all(r.place == r.trial for r in placed.collect()) and len({*placed.inputFiles()}) == 4
