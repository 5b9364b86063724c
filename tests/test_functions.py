from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantrail.functions import distributions as d
from quantrail.functions import finance, numeric, sheet, special
from quantrail.operators import ranking, sampling, timeseries
from quantrail.sources import delimited, workbooks


def one(spark, **columns):
    return list(spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first())


def test_cash_flows(spark):
    cf = F.array(*[F.lit(float(v)) for v in (-100, 39, 59, 55, 20)])
    npv, irr, payback = one(spark, a=finance.npv(0.1, cf), b=finance.irr(cf), c=finance.payback(cf))
    assert npv == pytest.approx(-100 + 39 / 1.1 + 59 / 1.21 + 55 / 1.331 + 20 / 1.4641)
    assert irr == pytest.approx(0.2809484212)
    assert payback == pytest.approx(2 + 2 / 55)
    assert one(spark, a=finance.irr(F.array(F.lit(1.0), F.lit(2.0)))) == [None]


@pytest.mark.parametrize("flows", [(-230, 90, -230, 10, 30), (-50, 30, -230, 10), (90, -20, -50, 200, -20)])
def test_irr_where_newton_does_not_settle(spark, flows):
    cf = F.array(*[F.lit(float(v)) for v in flows])
    rate, rates = one(spark, a=finance.irr(cf), b=finance.all_irrs(cf))
    assert rate in rates
    assert all(abs(sum(v / (1 + r) ** t for t, v in enumerate(flows))) < 1e-3 for r in rates)


def test_all_irrs(spark):
    cf = F.array(*[F.lit(float(v)) for v in (-100, 230, -132)])
    rates, none = one(spark, a=finance.all_irrs(cf), b=finance.all_irrs(F.array(F.lit(1.0), F.lit(2.0))))
    assert rates == pytest.approx([0.1, 0.2], abs=1e-9) and none == []


def test_errors_spread(spark):
    none = F.lit(None).cast("double")
    assert one(spark, a=sheet.divide(1, 0), b=sheet.smallest(F.lit(1.0), none), c=sheet.some(F.lit(True), none.isNull() & F.lit(None).cast("boolean")), d=sheet.square_root(-1), e=sheet.log(0), f=sheet.power(0, -1), g=sheet.mod(-7, 3), h=sheet.whole(-2.7)) == [None, None, None, None, None, None, -1.0, -2.0]


@pytest.mark.parametrize("name", sorted(numeric.EXAMPLES))
def test_numeric_families(name):
    f = numeric.EXAMPLES[name]()
    u = (np.arange(4000) + 0.5) / 4000
    x = f.quantile(u)
    if math.isfinite(f.variance) and name not in ("studentT", "f"):
        assert x.mean() == pytest.approx(f.mean, rel=5e-3)
        assert x.var() == pytest.approx(f.variance, rel=3e-2)
    if not f.discrete:
        assert f.cdf(x) == pytest.approx(u, abs=1e-9)


@pytest.mark.parametrize("name", sorted(k for k, f in d.EXAMPLES.items() if f.cdf and not f.discrete))
def test_cdf_inverts_quantile(spark, name):
    f = d.EXAMPLES[name]
    rows = spark.range(1, 100).select((F.col("id") / 100).alias("u")).withColumn("x", f.sample("u")).withColumn("c", F.expr(f.cdf("x"))).collect()
    assert [r.c for r in rows] == pytest.approx([r.u for r in rows], abs=1e-9)


def test_special_functions():
    assert special.gamma_p(np.array([2.0]), np.array([3.0]))[0] == pytest.approx(1 - 4 * math.exp(-3))
    assert special.student_quantile(np.array([0.975]), np.array([10.0]))[0] == pytest.approx(2.2281388519649385)
    assert special.beta_i(np.array([0.3]), np.array([2.0]), np.array([3.0]))[0] == pytest.approx(0.3483)


def test_nearest_correlation():
    m = sampling.nearest_correlation(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]]))
    assert np.linalg.eigvalsh(m).min() > 0 and np.allclose(np.diag(m), 1)


def test_average_ranks_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0, 3.0])], "i int, v double")
    assert [r.k for r in ranking.with_average_rank(df, "v", "k").orderBy("i").collect()] == [4.0, 1.0, 4.0, None, 2.0, 4.0]


def test_pacf_of_a_first_order_process():
    assert [*timeseries.partial_autocorrelations([1, 0.5, 0.25, 0.125])] == pytest.approx([0.5, 0, 0])


def test_delimiters_and_numbers(spark):
    assert delimited.delimiter_of(["a;b;c", '1;"x;y";3', "", "4;5,5;6"]) == ";"
    assert delimited.delimiter_of(["one", "two"]) == ""
    texts = ["1.234,5", "(12)", "12,5 %", "€ 7", "1.23,4", "x", "", None, "-1e3", "1 234,5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(delimited.locale_number("t", ",")).collect()] == [1234.5, -12.0, 0.125, 7.0, None, None, None, None, -1000.0, 1234.5]
    assert delimited.decimal_of(df, ["t"]) == ","


def test_workbook_round_trip():
    content = workbooks.workbook({"A & B": [(1, 1, 2.5, None), (2, 28, "x < y", None), (3, 1, True, None), (4, 1, None, "XX.NORMAL(1,2)")]})
    assert [*workbooks.cells_of(content)] == [("A & B", 1, 1, 2.5, None, None, None, None), ("A & B", 2, 28, None, "x < y", None, None, None), ("A & B", 3, 1, None, None, True, None, None), ("A & B", 4, 1, None, None, None, None, "XX.NORMAL(1,2)")]


def test_assumptions_in_cells(spark):
    rows = [("p", "s", 1, 1, "RISK.NORMAL(10, 2)"), ("p", "s", 2, 1, "RISK.NORMAL(10)"), ("p", "s", 3, 1, "1+RISK.NORMAL(10,2)"), ("p", "s", 4, 1, None)]
    got = workbooks.assumptions_of(spark.createDataFrame(rows, "path string, sheet string, row int, col int, formula string")).collect()
    assert [(r.row, r.family, r.parameters) for r in got] == [(1, "NORMAL", [10.0, 2.0])]


def test_rates_of_many_rows_together(spark):
    """Flows of several lengths, nulls and no change of sign; annuities that have a rate and one that has none. By Arrow batches, not by an interpreted grid for each row."""
    rows = [([-100.0, 230.0, -132.0],), ([-100.0, 110.0],), ([-100.0, None, 200.0],), (None,), ([1.0, 2.0],), ([],), ([-100.0, 0.0, 121.0],)]
    df = spark.createDataFrame(rows, "cf array<double>").coalesce(1).select(finance.all_irrs(F.col("cf")).alias("r"))
    got = [r.r for r in df.collect()]
    assert [[round(x, 9) for x in r] for r in got] == [[0.1, 0.2], [0.1], [], [], [], [], [0.1]]
    rates = spark.createDataFrame([(0.01, 24.0), (0.05, 12.0), (None, 5.0)], "r double, n double").select(finance.rate(F.col("n"), finance.pmt(F.col("r"), F.col("n"), 100.0), 100.0).alias("r"))
    assert [r.r if r.r is None else round(r.r, 9) for r in rates.collect()] == [0.01, 0.05, None]
    assert all("ArrowEvalPython" in x._jdf.queryExecution().executedPlan().toString() for x in (df, rates))
