"""Runs in rounds, their stop, abort and errors; black-box models; the keyed permutation of strata."""

from __future__ import annotations

import itertools
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantrail.functions import distributions as d
from quantrail.operators import runner, sampling
from quantrail.plans.models import Model

MODEL = Model("m", {"a": 1.0}, [{"x": "10 + a", "bad": "CASE WHEN a < 0.9 THEN a END"}], ["x", "bad"], {"a": d.uniform(-3, 1)})


def stopped_at(x: np.ndarray, relative: float, total: int) -> int:
    z = NormalDist().inv_cdf(0.975)
    for done in range(500, total, 250):
        v = x[:done]
        v = v[np.isfinite(v)]
        if len(v) >= 2 and z * v.std(ddof=1) / np.sqrt(len(v)) <= relative * abs(v.mean()):
            return done
    return total


@pytest.mark.parametrize(("relative", "first"), [(0.02, 500), (0.006, 700), (0.006, 1300), (0.0001, 600)])
def test_a_run_stops_where_one_pass_would(spark, relative, first):
    """Rounds of odd sizes stop at the trial that a pass over all trials names, and make no trials of later rounds."""
    total = 4000
    rows = MODEL.evaluate(sampling.uniforms(spark, total, ["u_a"]).select("trial", MODEL.assumptions["a"].sample("u_a").alias("a"))).orderBy("trial").collect()
    x = np.array([r.x for r in rows])
    want = stopped_at(x, relative, total)
    made = spark.sparkContext.accumulator(0)

    def counted(df):
        def each(batches):
            for b in batches:
                made.add(len(b))
                yield b

        return MODEL.evaluate(df.mapInPandas(each, df.schema))

    got = runner.run(spark, MODEL, total, runner.Precision("x", relative), first=first, evaluate=counted)
    ends = [sum(int(first * 2**k) for k in range(j + 1)) for j in range(8)]
    assert (got.trials, got.stopped) == (want, want < total)
    assert made.value == min(total, next(e for e in ends if e >= want))
    assert got.rows.count() == want and got.states["x"].count == want
    assert got.states["x"].mean == pytest.approx(x[:want].mean(), rel=1e-12) and got.states["x"].m2 == pytest.approx(((x[:want] - x[:want].mean()) ** 2).sum(), rel=1e-9)
    assert got.states["bad"].errors == sum(r.a >= 0.9 for r in rows[:want])


def test_a_run_that_is_aborted_keeps_whole_rounds(spark):
    said = []
    got = runner.run(spark, MODEL, 10_000, runner.Precision("x", 1e-9), first=500, aborted=lambda: len(said) == 2, progress=lambda done, total: said.append((done, total)))
    assert got.aborted and not got.stopped and said == [(500, 10_000), (1500, 10_000)] and got.rows.count() == got.trials == 1500
    none = runner.run(spark, MODEL, 10, aborted=lambda: True)
    assert none.trials == 0 and none.rows.count() == 0 and none.rows.columns == ["trial", "a", "x", "bad"]


def test_a_broken_model_is_raised_unless_the_run_was_aborted(spark):
    gone = []

    def broken(df):
        gone.append(1)
        return MODEL.evaluate(df).withColumn("x", F.when(F.col("trial") >= 0, F.raise_error(F.lit("no"))).cast("double"))

    with pytest.raises(Exception, match="no"):
        runner.run(spark, MODEL, 100, evaluate=broken)
    assert runner.run(spark, MODEL, 100, evaluate=broken, aborted=lambda: len(gone) > 1).aborted


def test_values_that_are_not_finite_are_errors(spark):
    odd = lambda df: MODEL.evaluate(df).withColumns({"x": F.when(F.col("trial") % 3 == 0, float("nan")).when(F.col("trial") % 3 == 1, float("inf")).otherwise(1.0)})
    got = runner.run(spark, MODEL, 90, evaluate=odd)
    assert (got.states["x"].count, got.states["x"].errors) == (30, 60) and got.rows.filter("x IS NULL").count() == 60


def test_states_merge():
    x = np.random.default_rng(1).normal(1e9, 1, 1000)
    of = lambda v: runner.State(len(v), v.mean(), ((v - v.mean()) ** 2).sum(), 1)
    got = runner.State()
    for part in np.split(x, [3, 3, 400]):
        got = got.merged(of(part) if len(part) else runner.State(errors=1))
    assert got.count == 1000 and got.errors == 4 and got.m2 == pytest.approx(of(x).m2, rel=1e-6)


def test_failures_stay_with_their_rows():
    calls = []

    def model(frame: pd.DataFrame):
        calls.append(len(frame))
        if frame["k"].isin([5, 77]).any():
            raise ValueError("no")
        return [[float(k), np.inf if k == 9 else 1.0][: 1 if k == 8 else 2] for k in frame["k"]]

    values, failed = runner.isolated(model, pd.DataFrame({"k": range(100)}), 3)
    assert np.flatnonzero(failed).tolist() == [5, 77] and len(calls) <= 1 + 2 * 2 * 7
    assert np.isnan(values[:, 2]).all() and np.flatnonzero(np.isnan(values[:, 1])).tolist() == [5, 8, 9, 77] and np.flatnonzero(np.isnan(values[:, 0])).tolist() == [5, 77]
    values, failed = runner.isolated(lambda f: [[1.0]] * 3, pd.DataFrame({"k": range(2)}), 1)
    assert failed.all() and np.isnan(values).all()
    assert runner.isolated(model, pd.DataFrame({"k": []}), 2)[0].shape == (0, 2)


def test_black_box_leaves_other_columns_alone(spark):
    df = spark.sql("SELECT CAST(9007199254740993 AS BIGINT) AS big, CAST(NULL AS INT) AS none, array('x') AS a, id AS k FROM range(5)")
    got = runner.black_box(df, lambda f: np.where(f["k"] == 3, np.nan, f["k"] * 2.0)[:, None], ["k"], ["y"])
    assert [(r.big, r.none, r.a, r.y, r.failed) for r in got.orderBy("k").collect()] == [(9007199254740993, None, ["x"], None if k == 3 else 2.0 * k, False) for k in range(5)]
    assert runner.black_box(df.filter("false"), lambda f: f, ["k"], ["y"]).count() == 0
    with pytest.raises(ValueError, match="there already"):
        runner.black_box(df, lambda f: f, ["k"], ["big"])


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 97, 1000, 9973])
def test_strata_are_a_permutation(spark, n):
    rows = np.array(sampling.uniforms(spark, n, ["a", "b"], 3, "lhs").orderBy("trial").select("a", "b").collect())
    strata = np.floor(rows * n).astype(int)
    assert all(sorted(strata[:, j]) == [*range(n)] for j in range(2))
    if n > 900:
        at = np.arange(n)
        pairs = [(rows[:, 0], rows[:, 1]), (at, rows[:, 0]), (rows[1:, 0], rows[:-1, 0]), ((at * 7) % n, rows[:, 1])]
        assert all(abs(np.corrcoef(x, y)[0, 1]) < 4 / np.sqrt(n) for x, y in pairs)


def test_a_permutation_reaches_every_order():
    """Over keys, small permutations come in all orders, alike."""
    a, b = sampling.halves(360)
    assert a * b == 360 and a >= 10
    assert all(0 <= n - np.prod(sampling.halves(n)) < np.sqrt(n) for n in itertools.chain(range(16, 3000, 7), (10**9 + 7, 10**12 + 39)))


def test_numbers_follow_the_key(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k")).repartition(7)
    got = {r.k: r.trial for r in sampling.numbered(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
