"""Models: levels of named expressions over input columns, so that a model is one projection of any rows.

Expressions are SQL that Spark and DuckDB both read. An input that a frame lacks is its base value.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as d
from ..functions import numeric
from ..functions.distributions import num

Levels = list[dict[str, str]]


@dataclass(frozen=True)
class Model:
    """inputs: base values; levels: cells, each from inputs and earlier levels; outputs: the forecasts."""

    name: str
    inputs: dict[str, float]
    levels: Levels
    outputs: list[str]
    assumptions: dict[str, object] = field(default_factory=dict)
    decisions: dict[str, tuple[float, float]] = field(default_factory=dict)
    correlations: list[tuple[str, str, float]] = field(default_factory=list)

    def evaluate(self, df: DataFrame) -> DataFrame:
        """df with every cell of the model; a level is one projection."""
        missing = {k: float(v) for k, v in self.inputs.items() if k not in df.columns}
        if len(missing) == len(self.inputs):
            # Base values alone: as one row of data, for as literals every level would be unfolded into the next.
            base = df.sparkSession.createDataFrame([tuple(missing.values())], ", ".join(f"{k} double" for k in missing))
            df = df.crossJoin(F.broadcast(base))
        else:
            df = df.withColumns({k: F.lit(v) for k, v in missing.items()})
        for level in self.levels:
            df = df.withColumns({k: F.expr(e) for k, e in level.items()})
        return df

    def sql(self, source: str, given: list[str]) -> str:
        """The same cells over a DuckDB relation that has the given inputs."""
        missing = [f"{num(float(v))} AS {k}" for k, v in self.inputs.items() if k not in given]
        out = f"SELECT {', '.join(['*', *missing])} FROM {source}"
        for level in self.levels:
            out = f"SELECT *, {', '.join(f'{e} AS {k}' for k, e in level.items())} FROM ({out})"
        return out


def _power(base: str, n: int) -> str:
    return " * ".join([f"({base})"] * n) if n else num(1.0)


def discounted_sum(rate: str, flows: list[str]) -> str:
    """Value of flows from period 0 on, by Horner's rule."""
    out = flows[-1]
    for f in reversed(flows[:-1]):
        out = f"({f} + {out} / (1 + {rate}))"
    return out


def internal_rate(flows: list[str], name: str = "irr", steps: int = 16) -> Levels:
    """Levels that end in the internal rate of return: Newton's method on the discount factor. NULL where it does not settle on a root."""
    value = lambda x: functools.reduce(lambda out, f: f"({f} + {out} * {x})", reversed(flows[:-1]), flows[-1])
    slopes = [f"{t} * {f}" for t, f in enumerate(flows)][1:]
    slope = lambda x: functools.reduce(lambda out, f: f"({f} + {out} * {x})", reversed(slopes[:-1]), slopes[-1])
    step = lambda x: f"CASE WHEN {slope(x)} <> 0 THEN {x} - {value(x)} / {slope(x)} END"
    levels: Levels = [{f"{name}_x0": num(1 / 1.1)}]
    levels += [{f"{name}_x{i + 1}": step(f"{name}_x{i}")} for i in range(steps)]
    last, scale = f"{name}_x{steps}", f"({' + '.join(f'abs({f})' for f in flows)})"
    return [*levels, {name: f"CASE WHEN {last} > 0 AND abs({value(last)}) <= {num(1e-9)} * {scale} THEN 1 / {last} - 1 END"}]


def project() -> Model:
    """Five-year investment: units, price, costs, investment and rate are uncertain; net present value and internal rate."""
    years = range(1, 6)
    inputs = dict(units=10000, growth=0.05, price=26, unit_cost=12, fixed_cost=60000, investment=250000, life=5, salvage=25000, tax=0.25, working=0.1, rate=0.12, inflation=0.03)
    one = {f"q{t}": f"units * {_power('1 + growth', t - 1)}" for t in years} | {f"up{t}": _power("1 + inflation", t - 1) for t in years} | {f"dep{t}": f"CASE WHEN {t} <= life THEN (investment - salvage) / life ELSE {num(0.0)} END" for t in years}
    two = {f"rev{t}": f"q{t} * price * up{t}" for t in years}
    three = {f"ebt{t}": f"rev{t} - q{t} * unit_cost * up{t} - fixed_cost * up{t} - dep{t}" for t in years}
    four = {f"net{t}": f"ebt{t} - greatest({num(0.0)}, ebt{t}) * tax" for t in years}
    five = {"fcf0": "-investment - working * rev1"} | {f"fcf{t}": f"net{t} + dep{t} - working * (rev{t + 1} - rev{t})" for t in range(1, 5)} | {"fcf5": "net5 + dep5 + salvage + working * rev5"}
    six = {"npv": discounted_sum("rate", [f"fcf{t}" for t in range(6)])}
    seven = {"pi": "(npv - fcf0) / -fcf0", "eaa": "npv * rate / (1 - power(1 + rate, -life))"}
    return Model(
        "project",
        inputs,
        [one, two, three, four, five, six, seven, *internal_rate([f"fcf{t}" for t in range(6)])],
        ["npv", "irr"],
        {"units": d.truncated(d.normal(10000, 1500), 0), "price": d.truncated(d.normal(26, 2), 0), "unit_cost": numeric.pert(10.5, 12, 15), "investment": d.triangular(220000, 250000, 310000), "rate": d.uniform(0.1, 0.14)},
        correlations=[("price", "units", -0.5)],
    )


def inventory() -> Model:
    """One-period order under uncertain demand: profit and fill rate."""
    return Model(
        "inventory",
        dict(demand=100, price=50, cost=30, salvage=10, penalty=5, ordered=100),
        [
            {"sold": "least(demand, ordered)", "left_over": f"greatest(ordered - demand, {num(0.0)})", "short": f"greatest(demand - ordered, {num(0.0)})"},
            {"profit": "sold * price - ordered * cost + left_over * salvage - short * penalty", "fill": f"CASE WHEN demand = 0 THEN {num(1.0)} ELSE sold / demand END"},
        ],
        ["profit", "fill"],
        {"demand": numeric.poisson(100)},
        {"ordered": (60, 140)},
    )


def portfolio() -> Model:
    """Weighted growth of four assets."""
    assets = ("local", "global", "bonds", "deposits")
    weights = [f"w_{a}" for a in assets]
    total = f"({' + '.join(weights)})"
    return Model(
        "portfolio",
        dict(invested=100000, g_local=1.11, g_global=1.09, g_bonds=1.055, g_deposits=1.03, w_local=0.25, w_global=0.25, w_bonds=0.25, w_deposits=0.25),
        [{"portfolio_return": f"({' + '.join(f'w_{a} * (g_{a} - 1)' for a in assets)}) / {total}"}, {"portfolio_value": "invested * (1 + portfolio_return)"}],
        ["portfolio_return", "portfolio_value"],
        {"g_local": d.lognormal(1.11, 0.2), "g_global": d.lognormal(1.09, 0.16), "g_bonds": d.normal(1.055, 0.06), "g_deposits": d.normal(1.03, 0.005)},
        {w: (0, 1) for w in weights},
        [("g_local", "g_global", 0.6), ("g_local", "g_bonds", -0.2)],
    )


def launch() -> Model:
    """Product launch after an uncertain approval: net present value and success."""
    years = range(1, 5)
    return Model(
        "launch",
        dict(approval=1, development=500000, distributors=8, units=2500, price=40, unit_cost=22, growth=0.06, launch_cost=150000, rate=0.1, tax=0.25),
        [
            {f"q{t}": f"CASE WHEN approval >= 1 THEN distributors * units * {_power('1 + growth', t - 1)} ELSE {num(0.0)} END" for t in years} | {"f0": f"-development - CASE WHEN approval >= 1 THEN launch_cost ELSE {num(0.0)} END"},
            {f"m{t}": f"q{t} * (price - unit_cost)" for t in years},
            {f"f{t}": f"m{t} - greatest({num(0.0)}, m{t}) * tax" for t in years},
            {"npv": discounted_sum("rate", [f"f{t}" for t in range(5)])},
            {"success": f"CASE WHEN npv > 0 THEN {num(1.0)} ELSE {num(0.0)} END"},
        ],
        ["npv", "success"],
        {"approval": d.bernoulli(0.7), "development": d.triangular(400000, 500000, 700000), "distributors": numeric.binomial(20, 0.4), "units": d.truncated(d.normal(2500, 500), 0), "price": numeric.pert(34, 40, 44)},
    )


def loan() -> Model:
    """Leveraged purchase: equity value, its internal rate and the least debt-service cover."""
    years = range(1, 6)
    levels: Levels = [{"debt": "investment * debt_share", "interest_rate": "base_rate + spread"}, {"level": "debt * interest_rate / (1 - power(1 + interest_rate, -term))", "b0": "debt"}]
    for t in years:
        levels.append({f"i{t}": f"b{t - 1} * interest_rate", f"e{t}": f"ebitda * {_power('1 + growth', t - 1)}"})
        levels.append({f"a{t}": f"CASE WHEN {t} <= term THEN level - i{t} ELSE {num(0.0)} END"})
        levels.append({f"b{t}": f"b{t - 1} - a{t}", f"x{t}": f"e{t} - investment / 5 - i{t}"})
    levels.append({f"f{t}": f"e{t} - greatest({num(0.0)}, x{t}) * tax - i{t} - a{t}" for t in years} | {"f0": "-(investment - debt)"} | {f"cover{t}": f"CASE WHEN i{t} + a{t} > 0 THEN e{t} / (i{t} + a{t}) ELSE {num(0.0)} END" for t in years})
    levels.append({"npv": discounted_sum("equity_rate", [f"f{t}" for t in range(6)]), "least_cover": f"least({', '.join(f'cover{t}' for t in years)})"})
    return Model(
        "loan",
        dict(investment=500000, debt_share=0.6, base_rate=0.08, spread=0.03, term=5, ebitda=160000, growth=0.03, tax=0.25, equity_rate=0.15),
        [*levels, *internal_rate([f"f{t}" for t in range(6)])],
        ["npv", "irr", "least_cover"],
        {"base_rate": d.truncated(d.normal(0.08, 0.015), 0.02, 0.16), "ebitda": d.normal(160000, 25000), "growth": d.triangular(-0.02, 0.03, 0.07)},
        correlations=[("base_rate", "ebitda", -0.3)],
    )


MODELS = {"project": project, "inventory": inventory, "portfolio": portfolio, "launch": launch, "loan": loan}
