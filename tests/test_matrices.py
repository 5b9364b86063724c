"""Matrix products, QR fits, subtotals, little bootstraps and ordered residuals against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantrail.operators import matrices, regression, resampling, subtotals
from quantrail.queries import QUERIES

ENTRY = "i long, j long, v double"


def entries(m: np.ndarray) -> list[tuple]:
    return [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]


@pytest.mark.parametrize("size", [1, 3, 7, 181])
def test_products_by_blocks(spark, size):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-3, 4, s) * (rng.random(s) < 0.4) for s in ((9, 17), (17, 5)))
    made = np.zeros((9, 5))
    for r in matrices.multiply(spark.createDataFrame(entries(a), ENTRY), spark.createDataFrame(entries(b), ENTRY), size).collect():
        assert r.v and not made[r.i, r.j]
        made[r.i, r.j] = r.v
    assert (made == a @ b).all()


def test_products_of_odd_entries(spark):
    """Entries of one place are summed; nulls are left out; places may be negative or far apart; matrices may be empty."""
    a = spark.createDataFrame([(-5, 10**12, 2.0), (-5, 10**12, 1.0), (None, 1, 1.0), (1, 1, None)], ENTRY)
    b = spark.createDataFrame([(10**12, 7, 2.0), (3, 3, 9.0)], ENTRY)
    assert [tuple(r) for r in matrices.multiply(a, b).collect()] == [(-5, 7, 6.0)]
    assert matrices.multiply(a, b.filter("false")).count() == 0


def test_products_of_scattered_entries_stay_small(spark, monkeypatch):
    """A worker is never given more cells than it may hold: entries one to a block, slices of several rows, wide blocks."""
    monkeypatch.setattr(matrices, "HELD", 2000)
    monkeypatch.setattr(matrices, "COLUMNS", 50)
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-3, 4, s) * (rng.random(s) < 0.05) for s in ((700, 400), (400, 130)))
    df = matrices.multiply(spark.createDataFrame(entries(a), ENTRY), spark.createDataFrame(entries(b), ENTRY))
    made = np.zeros((700, 130))
    for r in df.collect():
        made[r.i, r.j] += r.v
    assert (made == a @ b).all()
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    assert "binary" not in tree and "collect_list" not in tree  # no filled block is a row


def test_qr_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1, (500, 3))  # far from zero: the normal equations are hopeless
    y = 3 + x @ [1, -2, 0.5] + rng.normal(0, 0.1, 500)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double").repartition(7)
    design = np.column_stack([np.ones(500), x - 1e6])
    want, sse = np.linalg.lstsq(design, y, rcond=None)[:2]
    for fit in (regression.qr_fit(df, "y", ["a", "b", "c"]), regression.ols(df, "y", ["a", "b", "c"])):
        assert fit.n == 500 and fit.coefficients[1:] == pytest.approx(want[1:], rel=1e-6) and fit.sigma == pytest.approx(np.sqrt(sse[0] / 496), rel=1e-6)
        assert fit.errors[1:] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse[0] / 496)[1:], rel=1e-6)
        assert fit.r2 == pytest.approx(1 - sse[0] / ((y - y.mean()) ** 2).sum(), rel=1e-6) and fit.vif == pytest.approx([1, 1, 1], abs=0.05)
    plain, other = regression.solve(*regression.moments(spark.range(40).selectExpr("id * 1.0D AS x", "sin(id) AS y"), "y", ["x"]), ["x"], [0]), regression.qr_fit(spark.range(40).selectExpr("id * 1.0D AS x", "sin(id) AS y"), "y", ["x"])
    for name in ("coefficients", "errors", "t", "p", "low", "high", "r2", "adjusted", "sigma", "f", "f_p", "vif"):
        assert getattr(other, name) == pytest.approx(getattr(plain, name), rel=1e-8, abs=1e-12), name
    assert regression.qr_fit(df, "y", ["a"], intercept=False).coefficients == pytest.approx([(x[:, 0] @ y) / (x[:, 0] @ x[:, 0])])


def test_dependent_columns_are_refused(spark):
    df = spark.range(50).selectExpr("id * 1.0D AS a", "id * 2.0D + 1 AS b", "sin(id) AS y", "0.0D AS z")
    for x in (["a", "b"], ["z"], ["a", "z"]):
        with pytest.raises(ValueError, match="dependent"):
            regression.ols(df, "y", x)
    with pytest.raises(ValueError, match="fewer rows"):
        regression.qr_fit(df.limit(2), "y", ["a", "y"])
    with pytest.raises(ValueError, match="fewer rows"):
        regression.qr_fit(df.filter("false"), "y", ["a"])


def test_ordered_residuals_over_ranges(spark):
    """One group of nearly all rows, a null group, gaps: as by one pass in order."""
    rng = np.random.default_rng(4)
    rows = [("g", i, float(v)) for i, v in enumerate(rng.normal(size=3000))] + [(None, i, float(v)) for i, v in enumerate(rng.normal(size=20))] + [("g", 9999, None), ("one", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, t int, e double").repartition(9)
    got = {r.g: r.dw for r in regression.durbin_watson(df, "e", "t", ["g"]).collect()}
    for g in ("g", None):
        e = np.array([v for k, _, v in rows if k == g and v is not None])
        assert got[g] == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
    assert got["one"] is None


def test_subtotals_by_number(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 4.0), ("b", "x", None), (None, "x", 7.0)], "g string, h string, v double")
    mixed = subtotals.detail_and_subtotals(df, ["g", "h"], ["v"])
    assert mixed.count() == 4 + 4 + 3 + 1
    got = mixed.agg(*[subtotals.subtotal(k, F.col("v"), F.col("is_subtotal")).alias(f"f{k}") for k in subtotals.FUNCTIONS], subtotals.subtotal(109, F.col("v"), F.col("is_subtotal"), F.col("h") == "y").alias("shown"), subtotals.subtotal(9, F.col("v"), F.col("is_subtotal"), F.col("h") == "y").alias("all")).first()
    v = np.array([1.0, 4.0, 7.0])
    assert [got[f"f{k}"] for k in range(1, 12)] == pytest.approx([v.mean(), 3, 3, 7, 1, 28, v.std(ddof=1), v.std(), 12, v.var(ddof=1), v.var()])
    assert (got.shown, got.all) == (8.0, 12.0)
    levels = {(r.g, r.h, r.level): r.v for r in subtotals.with_subtotals(df, ["g", "h"], {"v": F.sum("v")}).collect()}
    assert levels[None, None, 0] == 12 and levels[None, None, 1] == 7 and levels["a", None, 1] == 5 and levels["a", "y", 2] == 4 and len(levels) == 8


def test_little_bootstraps(spark):
    """Near the intervals of the exact bootstrap for the named statistics; a statistic of the user's own; small and null groups."""
    rng = np.random.default_rng(9)
    x = rng.gamma(2, 3, 20_000)
    df = spark.createDataFrame([(i, None, float(v)) for i, v in enumerate(x)] + [(10**6 + i, "small", float(i)) for i in range(30)] + [(-1, "small", None), (-2, "gone", None)], "k long, g string, x double")
    draws = rng.integers(0, len(x), (200, len(x)))
    exact = {"mean": x[draws].mean(axis=1), "median": np.median(x[draws], axis=1), "stdDev": x[draws].std(axis=1, ddof=1)}
    for name, found in exact.items():
        got = {r.g: r for r in resampling.little_bootstraps(df, "x", "k", name, ["g"], subsets=12, power=0.7).collect()}
        assert {*got} == {None, "small"}
        low, high = np.percentile(found, [2.5, 97.5])
        assert got[None].high - got[None].low == pytest.approx(high - low, rel=0.35)
        assert got[None].estimate == pytest.approx(found.mean(), abs=1.5 * (high - low)) and got["small"].low <= got["small"].estimate <= got["small"].high
    own = resampling.little_bootstraps(df.filter("g = 'small'"), "x", "k", lambda v, w: float(v[w > 0].max())).first()
    assert 25 < own.low <= own.high == 29
    assert resampling.little_bootstraps(df.filter("g = 'gone'"), "x", "k", "mean").count() == 0


def test_little_bootstraps_lie_around_the_statistic_of_all_rows(spark):
    """Ten samples hold a few rows in a hundred; the interval is as wide as all rows allow, and must not lie where those few do."""
    df = spark.range(200_000).selectExpr("id AS k", "id % 4 AS g", "pow(conv(substring(md5(string(id)), 1, 8), 16, 10) / 4294967296D, 3) AS x")
    exact = {r.g: r for r in df.groupBy("g").agg(F.percentile("x", 0.5).alias("median"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stdDev"), F.percentile("x", 0.9).alias("p90"), F.skewness("x").alias("skewness")).collect()}
    for name in ("median", "mean", "stdDev", "p90", "skewness"):
        for r in resampling.little_bootstraps(df, "x", "k", name, ["g"]).collect():
            assert r.low < exact[r.g][name] < r.high, (name, r)
    own = resampling.little_bootstraps(df, "x", "k", lambda v, w: float(v @ w / w.sum()), ["g"]).collect()  # of all rows too
    assert [r.low < exact[r.g]["mean"] < r.high for r in own] == [True] * 4


def test_medians_of_types_of_few_events(spark, tmp_path):
    """As in SQL: types of over a hundred events, the null one too."""
    spark.range(650).selectExpr("id AS event_id", "CASE WHEN id >= 600 THEN 'rare' WHEN id % 2 = 0 THEN 'a' END AS event_type", "ln(id + 1D) AS value").write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["median_by_little_bootstraps"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in rows} == {("a", True, True), (None, True, True)}


def test_weighted_statistics_are_those_of_repeated_rows():
    rng = np.random.default_rng(1)
    x, w = np.sort(rng.normal(size=12)), rng.integers(0, 4, 12)
    long = np.repeat(x, w)
    z = (long - long.mean()) / long.std(ddof=1)
    n = len(long)
    want = {"mean": long.mean(), "median": np.median(long), "stdDev": long.std(ddof=1), "cv": long.std(ddof=1) / abs(long.mean()), "p5": np.percentile(long, 5), "p10": np.percentile(long, 10), "p90": np.percentile(long, 90), "p95": np.percentile(long, 95), "skewness": n / ((n - 1) * (n - 2)) * (z**3).sum(), "kurtosis": n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * (z**4).sum() - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))}
    assert {k: f(x, w) for k, f in resampling.STATISTICS.items()} == pytest.approx(want)
