"""Optimisers under constraints: known optima, exact budgets, right-hand sides in lockstep."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantrail.operators import optimise as o

X, Y = o.Variable("x", -4, 4), o.Variable("y", -4, 4)


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(1.0,), (3.0,)], "w double")


@pytest.fixture
def fast(monkeypatch):
    """The bowl's values without Spark, for tests of the searches alone."""

    def evaluated(self, new):
        x, y = np.array(new).T
        f = -2 * ((x - 2) ** 2 + (y - 1) ** 2) * fast.scale
        of = {"avg(x + y)": x + y, "avg(x - y)": x - y, "avg(x)": x}
        return {p: v for p, v in zip(new, np.stack([f, *[of[c.statistic] for c in self.problem.constraints]], axis=1), strict=True)}

    fast.scale = 1.0
    monkeypatch.setattr(o.Evaluations, "evaluated", evaluated)
    return fast


def bowl(one, *constraints, scale=1.0, variables=(X, Y)):
    model = lambda df: df.withColumn("f", (-(F.col("x") - 2) ** 2 - (F.col("y") - 1) ** 2) * F.col("w") * scale)
    return o.Problem(model, one, [*variables], "avg(f)", [*constraints])


LINE = o.Constraint("line", "avg(x + y)", "<=", 2.0)


def test_a_simplex_finds_the_top(one, fast):
    best = o.optimise(bowl(one))
    assert (best.algorithm, best.feasible) == ("simplex", True)
    assert best.x == {"x": pytest.approx(2, abs=1e-3), "y": pytest.approx(1, abs=1e-3)} and best.value == pytest.approx(0, abs=1e-5)


@pytest.mark.parametrize(("constraint", "x", "y"), [(LINE, 1.5, 0.5), (o.Constraint("least", "avg(x - y)", ">=", 3), 3, 0), (o.Constraint("line", "avg(x + y)", "=", -1), 0, -1)])
def test_constraints_are_met_at_the_optimum(one, fast, constraint, x, y):
    best = o.optimise(bowl(one, constraint), budget=3000)
    assert best.feasible and best.algorithm == "genetic+simplex" and best.evaluations <= 3000
    assert best.value == pytest.approx(-2 * ((x - 2) ** 2 + (y - 1) ** 2), rel=5e-3)


def test_large_objectives_do_not_hide_violations(one, fast):
    """Where a penalty would be lost beside the objective, ranking still puts feasible points first."""
    fast.scale = 1e15
    for algorithm in ("genetic", "annealing"):
        best = o.optimise(bowl(one, LINE), algorithm, budget=600)
        assert best.feasible and best.constraints["line"] <= 2 + 2e-6


def test_nothing_feasible_and_no_values(one, fast):
    best = o.optimise(bowl(one, o.Constraint("none", "avg(x)", ">=", 9)), budget=300)
    assert not best.feasible and best.x["x"] == pytest.approx(4, abs=0.05)


def test_points_without_values(one):
    nothing = o.Problem(lambda df: df.withColumn("f", F.when(F.col("x") > 0, F.col("x"))), one, [X], "avg(f)")
    assert o.optimise(nothing, "genetic", budget=50).value > 2
    empty = o.Problem(lambda df: df.withColumn("f", F.col("x")), one.filter("false"), [o.Variable("x", 0, 3, 1)], "avg(f)")
    assert not o.optimise(empty, budget=20).feasible


@pytest.mark.parametrize("budget", [1, 17])
def test_budgets_are_kept_exactly(one, budget):
    """So many distinct points reach the model, each once."""
    seen = one.sparkSession.sparkContext.accumulator(0)

    def model(df):
        def each(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        return df.withColumn("f", -F.col("x") * F.col("x")).mapInPandas(each, df.withColumn("f", F.lit(0.0)).schema)

    for algorithm in ("genetic", "annealing", "simplex"):
        before = seen.value
        best = o.optimise(o.Problem(model, one, [X], "avg(f)"), algorithm, budget=budget)
        assert best.evaluations <= budget and seen.value - before == 2 * best.evaluations
    assert o.optimise(o.Problem(model, one, [X], "avg(f)"), "annealing", budget=budget).evaluations == budget


def test_steps_of_a_grid(one):
    """Decimal, whole and two-valued variables: values lie on the grid and the best neighbour is found."""
    grid = (o.Variable("x", -1, 4, 0.1), o.Variable("y", 0, 1, 1))
    best = o.optimise(bowl(one, variables=grid))
    assert best.algorithm == "genetic" and best.x == {"x": 2.0, "y": 1.0} and best.value == pytest.approx(0, abs=1e-20)
    assert o.Variable("x", 0, 1, 0.3).snapped(np.array([0.95, 2, -1])).tolist() == [0.9, 0.9, 0.0]


def test_a_frontier_is_searched_together(one, fast):
    sides = [-3.0, 0.0, 2.0, 3.0, 5.0]
    found = o.frontier(bowl(one, LINE), "line", sides, budget=5000)
    want = [-2 * 2 * (max(0, 3 - s) / 2) ** 2 for s in sides]
    assert [b.value for _, b in found] == pytest.approx(want, rel=1e-2, abs=2e-3) and all(b.feasible for _, b in found)
    alone = sum(o.optimise(bowl(one, o.Constraint("line", "avg(x + y)", "<=", s)), budget=1000).jobs for s in sides)
    assert found[0][1].jobs < alone
    with pytest.raises(ValueError, match="not in list"):
        o.frontier(bowl(one, LINE), "other", sides)


def test_a_frontier_on_spark(one):
    grid = (o.Variable("x", -4, 4, 1), o.Variable("y", -4, 4, 1))
    found = o.frontier(bowl(one, LINE, variables=grid), "line", [-2.0, 1.0, 4.0], budget=81)
    assert [b.value for _, b in found] == [-26.0, -4.0, 0.0]
