"""Reports as cells, filled series, trend intervals and grouped inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantrail.functions import sheet
from quantrail.operators import runner, timeseries, whatif
from quantrail.plans.report import report
from quantrail.queries.runs import margin_model
from quantrail.sources import workbooks


def test_a_report_holds_what_the_run_says(spark):
    """Every sheet is there, no two values share a cell, and a workbook takes the cells."""
    done = runner.run(spark, margin_model(), 1500)
    rows = report(margin_model(), done, extract=10).collect()
    at = {(r.sheet, r.row, r.col): r.number if r.number is not None else r.text for r in rows}
    assert len(at) == len(rows) and {r.sheet for r in rows} == {"Summary", "Forecasts", "Assumptions", "Sensitivity", "Data"}
    assert at["Summary", 1, 2] == 1500 and at["Summary", 6, 1] == "profit" and at["Forecasts", 1, 2] == "profit" and at["Forecasts", 1, 3] == "growth"
    label = {at["Forecasts", r, 1]: r for r in range(2, 39)}
    v = np.array([r.profit for r in done.rows.collect()])
    assert at["Forecasts", label["mean"], 2] == pytest.approx(v.mean()) and at["Forecasts", label["P95"], 2] == pytest.approx(np.percentile(v, 95))
    assert at["Forecasts", label["P(<0)"], 2] == pytest.approx((v < 0).mean()) and at["Forecasts", label["errors"], 3] == done.states["growth"].errors
    assert at["Data", 1, 1] == 0 and ("Data", 11, 1) not in at and at["Sensitivity", 1, 1] == "profit"
    sheets = {}
    for (s, r, c), x in at.items():
        sheets.setdefault(s, []).append((r, c, x, None))
    assert len([*workbooks.cells_of(workbooks.workbook(sheets))]) == len(rows)


@pytest.mark.parametrize(
    ("source", "backward", "want"),
    [([1.0, 2.0], False, [3, 4, 5]), ([1.0, 2.0, 4.0], True, [-2 / 3, -13 / 6, -11 / 3]), ([0.1, 0.2], False, [0.3, 0.4, 0.5]), ([7.0], False, [7, 7, 7]), ([1.0, None], True, [None, 1, None]), ([5.0, 5.0], False, [5, 5, 5]), ([], False, [])],
)
def test_filled_numbers(spark, source, backward, want):
    got = spark.createDataFrame([(source,)], "s array<double>").select(sheet.fill_numbers(F.col("s"), 3, backward).alias("f")).first().f
    assert got == [None if w is None else pytest.approx(w, rel=1e-14) for w in want]


@pytest.mark.parametrize(
    ("source", "want"),
    [(["Q1"], ["Q2", "Q3", "Q4"]), (["y10", "y20"], ["y30", "y40", "y50"]), (["a1", "b2"], ["a1", "b2", "a1"]), (["=A1"], ["=A1"] * 3), (["12"], ["12"] * 3), (["x", None], ["x", None, "x"]), (["z3", "z2"], ["z1", "z0", "z1"]), ([], [])],
)
def test_filled_texts(spark, source, want):
    assert spark.createDataFrame([(source,)], "s array<string>").select(sheet.fill_texts(F.col("s"), 3).alias("f")).first().f == want


@pytest.mark.parametrize("kind", ["linear", "exponential", "logarithmic", "power"])
def test_trend_intervals(spark, kind):
    rng = np.random.default_rng(1)
    y = np.exp(rng.normal(2, 0.2, 30) + np.arange(30) / 20)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(y)] + [("short", 0, 1.0), ("short", 1, 2.0)], "g string, t int, y double")
    got = timeseries.trend_forecast(df, "y", "t", ["g"], 4, kind, 0.8).orderBy("step").collect()
    t, new = np.arange(1.0, 31), np.arange(31.0, 35)
    u, w = (np.log(t), np.log(new)) if kind in ("logarithmic", "power") else (t, new)
    v, back = (np.log(y), np.exp) if kind in ("exponential", "power") else (y, lambda x: x)
    b, a = np.polyfit(u, v, 1)
    s2 = ((v - a - b * u) ** 2).sum() / 28
    error = np.sqrt(s2 * (1 + 1 / 30 + (w - u.mean()) ** 2 / ((u - u.mean()) ** 2).sum()))
    q = 1.3125267815926684  # the ninetieth percentile of Student's t with 28 degrees of freedom
    assert [r.g for r in got] == ["g"] * 4
    for name, want in (("forecast", back(a + b * w)), ("error", error), ("low", back(a + b * w - q * error)), ("high", back(a + b * w + q * error))):
        assert [r[name] for r in got] == pytest.approx(want, rel=1e-8)


def test_inputs_of_a_group_are_one_variable():
    assert whatif.variables_of(["a", "b", "c", "d"], [["c", "a"], ["a", "d", "x"]]) == {"a+c": ["a", "c"], "b": ["b"], "d": ["d"]}
    assert whatif.variables_of(["a", "b"]) == {"a": ["a"], "b": ["b"]}
