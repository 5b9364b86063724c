"""The catalogue of distributions: defaults are right, all errors are told, and what is right can be built."""

from __future__ import annotations

import math

import pytest

from quantrail.functions import catalogue as c


@pytest.mark.parametrize("family", sorted(c.FAMILIES))
def test_defaults_can_be_built(family):
    values = c.defaults(family)
    assert c.errors_of(family, values) == []
    made = c.built(family, values)
    assert math.isnan(made.mean) or math.isfinite(made.mean)
    for name, (mark, default) in c.parameters(family).items():
        assert c.errors_of(family, {**values, name: None})[0] == (name, f"{name} is missing")
        assert c.errors_of(family, {**values, name: math.inf})[0][0] == name
        if "+" in mark:
            assert c.errors_of(family, {**values, name: 0.0})[0] == (name, f"{name} must be above 0")
        if "#" in mark:
            assert c.errors_of(family, {**values, name: default + 0.5})[0] == (name, f"{name} must be whole")


@pytest.mark.parametrize(
    ("family", "values", "bounds", "keys"),
    [
        ("other", {}, (), ["id"]),
        ("normal", {}, (), ["mean", "stdDev"]),
        ("normal", {"mean": math.nan, "stdDev": -1}, (5, 1), ["mean", "stdDev", "truncate"]),
        ("triangular", {"min": 3, "mode": 9, "max": 2}, (), ["max"]),
        ("triangular", {"min": 1, "mode": 9, "max": 2}, (), ["mode"]),
        ("trapezoidal", {"min": 0, "mode1": 5, "mode2": 4, "max": 3}, (), ["mode1"]),
        ("hypergeometric", {"population": 5, "successes": 6, "draws": 7}, (), ["successes", "draws"]),
        ("discreteUniform", {"min": 2, "max": 2}, (), []),
        ("binomial", {"n": 0, "p": 1.5}, (), ["n", "p"]),
        ("uniform", {"min": 0, "max": 1}, (2, 3), ["truncate"]),
        ("uniform", {"min": 0, "max": 1}, (0.5, None), []),
        ("poisson", {"lambda": 4}, (1, 3), []),
        ("normal", {"mean": True, "stdDev": "1"}, (math.nan,), ["mean", "stdDev", "truncate"]),
    ],
)
def test_all_errors_are_told(family, values, bounds, keys):
    assert [k for k, _ in c.errors_of(family, values, *bounds)] == keys
