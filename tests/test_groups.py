"""Groups that are null, order statistics by brackets, modes, tails and named statistics, against numpy."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantrail.operators import ranking
from quantrail.operators import statistics as st
from quantrail.queries import QUERIES


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = [(g, float(x), float(y)) for g, n in ((None, 400), ("", 300), ("b", 1), ("c", 50)) for x, y in zip(rng.normal(0, 9, n).round(1), rng.normal(0, 9, n).round(1), strict=True)]
    return [*out, (None, None, 1.0), ("d", None, None), ("c", float("nan"), 2.0)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, x double, y double")


@pytest.fixture(scope="module")
def groups(rows):
    out = defaultdict(list)
    for g, x, y in rows:
        if x is not None and not np.isnan(x):
            out[g].append((x, y))
    return {g: np.array(v) for g, v in out.items()}


def test_null_groups_keep_their_rows(spark, frame, groups):
    got = {r.g: r for r in st.describe(frame, "x", ["g"]).collect()}
    assert {*got} == {None, "", "b", "c", "d"} and got["d"].n == 0 and got["d"].p50 is None and got[None].errors == 1
    for g, v in groups.items():
        assert got[g].n == len(v) and [got[g][f"p{p:02d}"] for p in (5, 50, 95)] == pytest.approx(np.percentile(v[:, 0], [5, 50, 95]))
    shares = {r.g: r.p for r in ranking.percentiles(frame.filter("NOT isnan(x)"), "x", (1.0, 0.25, 0.0)).select(F.lit("a").alias("g"), "p").collect()}
    everything = np.concatenate([v[:, 0] for v in groups.values()])
    assert shares["a"] == pytest.approx([everything.max(), np.percentile(everything, 25), everything.min()])


@pytest.mark.parametrize("bins", [None, 7])
def test_histograms_of_null_groups(frame, groups, bins):
    got = defaultdict(int)
    for r in st.histogram(frame, "x", ["g"], bins).collect():
        got[r.g] += r["count"]
    assert got == {g: len(v) for g, v in groups.items()}


def test_rank_correlations_of_null_groups(frame, groups):
    def ranks(v):
        order = np.sort(v)
        return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2

    got = {r.g: r for r in st.spearman(frame.withColumn("x", F.nanvl("x", F.lit(None).cast("double"))), "x", "y", ["g"]).collect()}
    assert {*got} == {None, "", "b", "c"}
    for g in (None, "", "c"):
        v = groups[g]
        assert got[g].r == pytest.approx(np.corrcoef(ranks(v[:, 0]), ranks(v[:, 1]))[0, 1]) and got[g].n == len(v)
    assert got["b"].r is None
    ranked = ranking.with_average_rank(frame.filter("x IS NULL OR NOT isnan(x)"), "x", "k", ["g"]).collect()
    assert sum(r.k is not None for r in ranked if r.g is None) == 400 and sum(r.k is None for r in ranked) == 2


@pytest.mark.parametrize("n", [1, 2, 5, 999, 20_001, 90_000])
def test_selected_ranks_are_exact(spark, n, monkeypatch):
    """Beyond small groups, sketches bracket the ranks; ties, one value for a third of the rows, and both ends."""
    monkeypatch.setattr(ranking, "ACCURACY", 400)
    x = F.when(F.col("id") % 3 == 0, 7.5).otherwise(F.round(F.sin(F.col("id") * 12.9898) * 43758.5453 % 100, 2))
    df = spark.range(n).select(x.alias("x"))
    v = np.sort([r.x for r in df.collect()])
    shares = [0.0, 0.001, 0.05, 0.31, 0.5, 0.77, 0.999, 1.0]
    assert ranking.percentiles(df, "x", shares).first().p == pytest.approx(np.percentile(v, [100 * s for s in shares]), rel=1e-12)
    step = max(1, n // 40)
    points = sorted((r.i, r.p, r.x) for r in ranking.plot_points(df, "x", 40).collect())
    assert points == [(i, pytest.approx((i + 0.5) / n), v[i]) for i in range(0, n, step)]


def test_nothing_to_plot(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert ranking.plot_points(df, "x").count() == 0 and ranking.percentiles(df, "x", [0.5]).count() == 0


def test_modes(spark):
    data = {"whole": [3, 3, 5, 5, 1], "real": [0.1, 0.2, 0.21, 0.22, 9.5], "constant": [2.5, 2.5], None: [1, 1, 4]}
    df = spark.createDataFrame([(g, float(x)) for g, v in data.items() for x in v], "g string, x double")
    got = {r.g: (r["mode"], r.times) for r in st.mode(df, "x", ["g"]).collect()}
    assert got["whole"] == (3, 2) and got["constant"] == (2.5, 2) and got[None] == (1, 2)
    bins = [r for r in st.histogram(df.filter("g = 'real'"), "x").collect()]
    full = max(bins, key=lambda r: (r["count"], -r["bin"]))
    assert got["real"] == (pytest.approx((full["from"] + full["to"]) / 2), full["count"]) and got["real"][0] > 0.1
    assert st.mode(df.filter("g = 'whole'"), "x").first()["mode"] == 3 and st.mode(df.filter("g = 'real'"), "x").first().times == 3
    assert st.mode(df.filter("false"), "x").count() == 0


def test_tails_and_named_statistics(spark, frame, groups):
    v = groups[None][:, 0]
    of = lambda df: {r.g: r for r in df.collect()}[None]
    assert of(st.tail_certainty(frame, "x", "left", high=3.0, by=["g"])).certainty == pytest.approx((v <= 3).mean())
    assert of(st.tail_certainty(frame, "x", "right", low=3.0, by=["g"])).certainty == pytest.approx((v >= 3).mean())
    assert of(st.tail_certainty(frame, "x", "two", 3.0, -3.0, ["g"])).certainty == 0
    b = of(st.certainty_bounds(frame, "x", "two", 0.8, ["g"]))
    assert (b.low, b.high) == (pytest.approx(np.percentile(v, 10)), pytest.approx(np.percentile(v, 90)))
    b = of(st.certainty_bounds(frame, "x", "right", 0.8, ["g"]))
    assert (b.low, b.high) == (pytest.approx(np.percentile(v, 20)), float("inf"))
    got = {(r.g, r.statistic): r.result for r in st.forecast_statistics(frame, "x", ["g"], 1.0).collect()}
    assert got[None, "probAbove"] == pytest.approx((v > 1).mean()) and got[None, "probAbove"] + got[None, "probBelow"] == pytest.approx(1)
    assert got["b", "stdDev"] == 0 and got[None, "median"] == pytest.approx(np.median(v)) and got["d", "mean"] is None and len(got) == 50


def test_short_orders_stay_in_sheet_ranges(spark, sf_dir):
    """Orders of one or two lines have their statistics where these are defined, and null elsewhere."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").count()
    got = QUERIES["sheet_ranges"](spark, sf_dir)
    assert got.count() == lines.count()
    one = got.join(lines.filter("count = 1"), "l_orderkey")
    assert one.count() > 0 and one.filter("variance IS NOT NULL OR second IS NOT NULL OR median IS NULL").count() == 0


def test_ranges_are_found_by_halving_and_draws_hashed_once(spark):
    """Work for each row doesn't grow with the number of ranges, nor with the steps of a weight."""
    from quantrail.operators import ranking, resampling

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 7 > 0 THEN cos(id) END AS x")
    counts = ranking.cumulative(rows, "x")
    assert "filter(__b" not in plan(counts) and counts.agg({"upto": "max"}).first()[0] == rows.filter("x IS NOT NULL").count()
    assert plan(resampling.poisson_weights(rows, "id", 3)).count("md5(") == 1
