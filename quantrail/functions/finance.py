"""Finance as Column expressions: time value of money, cash-flow indicators, loans and depreciation.

Cash flows are array columns from period 0. NULL is the error value: impossible arguments give NULL.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Number = Column | float | int


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _annuity(rate: Column, n: Column, due: Column) -> Column:
    """Present value of n payments of 1; due is 1 for payments at the start of a period."""
    return F.when(rate == 0, n).otherwise((1 - F.pow(1 + rate, -n)) / rate * (1 + rate * due))


def pmt(rate: Number, n: Number, pv: Number, fv: Number = 0, due: Number = 0) -> Column:
    rate, n, pv, fv, due = map(_c, (rate, n, pv, fv, due))
    return -_div(pv + fv * F.pow(1 + rate, -n), _annuity(rate, n, due))


def pv(rate: Number, n: Number, payment: Number, fv: Number = 0, due: Number = 0) -> Column:
    rate, n, payment, fv, due = map(_c, (rate, n, payment, fv, due))
    return -(payment * _annuity(rate, n, due) + fv * F.pow(1 + rate, -n))


def fv(rate: Number, n: Number, payment: Number, present: Number = 0, due: Number = 0) -> Column:
    rate, n, payment, present, due = map(_c, (rate, n, payment, present, due))
    grown = F.pow(1 + rate, n)
    return -(present * grown + payment * F.when(rate == 0, n).otherwise((grown - 1) / rate * (1 + rate * due)))


def nper(rate: Number, payment: Number, present: Number, future: Number = 0, due: Number = 0) -> Column:
    rate, payment, present, future, due = map(_c, (rate, payment, present, future, due))
    paid = payment * (1 + rate * due)
    share = _div(paid - future * rate, paid + present * rate)
    return F.when(rate == 0, _div(-(present + future), payment)).otherwise(F.when(share > 0, F.ln(share) / F.ln(1 + rate)))


def effect(nominal: Number, periods: Number) -> Column:
    return F.pow(1 + _c(nominal) / _c(periods), _c(periods)) - 1


def nominal(effective: Number, periods: Number) -> Column:
    return (F.pow(1 + _c(effective), 1 / _c(periods)) - 1) * _c(periods)


def real_rate(nominal_rate: Number, inflation: Number) -> Column:
    return (1 + _c(nominal_rate)) / (1 + _c(inflation)) - 1


def wacc(equity: Number, debt: Number, cost_equity: Number, cost_debt: Number, tax: Number) -> Column:
    e, d = _c(equity), _c(debt)
    return _div(e * _c(cost_equity) + d * _c(cost_debt) * (1 - _c(tax)), e + d)


def capm(risk_free: Number, beta: Number, premium: Number, country: Number = 0) -> Column:
    return _c(risk_free) + _c(beta) * _c(premium) + _c(country)


def levered_beta(beta: Number, debt_to_equity: Number, tax: Number) -> Column:
    return _c(beta) * (1 + (1 - _c(tax)) * _c(debt_to_equity))


def ipmt(rate: Number, period: Number, n: Number, present: Number, future: Number = 0, due: Number = 0) -> Column:
    """The interest part of a payment; of payments at the start of a period the first has none."""
    rate, period, present, due = map(_c, (rate, period, present, due))
    level = pmt(rate, n, present, future, due)
    owed = fv(rate, period - 1, level, present, due)
    interest = F.when(due == 1, F.when(period == 1, 0.0).otherwise((fv(rate, period - 2, level, present, due) - level) * rate)).otherwise(owed * rate)
    return F.when((period >= 1) & (period <= _c(n)), interest)


def ppmt(rate: Number, period: Number, n: Number, present: Number, future: Number = 0, due: Number = 0) -> Column:
    return pmt(rate, n, present, future, due) - ipmt(rate, period, n, present, future, due)


def rate(n: Number, payment: Number, present: Number, future: Number = 0, due: Number = 0, guess: float = 0.1, steps: int = 60) -> Column:
    """The rate of an annuity, by secant steps, those of many rows at a time; NULL where they don't settle."""

    def found(*args: pa.Array) -> pa.Array:
        n, payment, present, future, due = (np.array(x.to_numpy(zero_copy_only=False), dtype=float) for x in args)

        def value(r: np.ndarray) -> np.ndarray:
            grown = np.power(1 + r, n)
            return -(present * grown + payment * np.where(r == 0, n, (grown - 1) / r * (1 + r * due))) - future

        with np.errstate(all="ignore"):
            a, b = np.full(len(n), guess * 0.9 + 1e-6), np.full(len(n), guess)
            fa, fb, move = value(a), value(b), np.ones(len(n))
            for _ in range(steps):
                move = np.where(fb == fa, 0.0, fb * (b - a) / (fb - fa))
                a, fa, b = b, fb, np.maximum(b - move, (b - 1) / 2)
                fb = value(b)
                if not (np.abs(move) > 0).any():  # all stay where they are
                    break
            scale = np.abs(present) + np.abs(future) + np.abs(payment * n)
            settled = (np.abs(move) < 1e-9) & (np.abs(fb) <= 1e-6 * scale)
        return pa.array(b, pa.float64(), mask=~settled)

    return F.arrow_udf(found, T.DoubleType())(*[_c(x).cast("double") for x in (n, payment, present, future, due)])


def cumulative_interest(rate_: Number, n: int, present: Number, first: int, last: int, due: int = 0) -> Column:
    return sum((ipmt(rate_, t, n, present, 0, due) for t in range(first + 1, last + 1)), ipmt(rate_, first, n, present, 0, due))


def cumulative_principal(rate_: Number, n: int, present: Number, first: int, last: int, due: int = 0) -> Column:
    return sum((ppmt(rate_, t, n, present, 0, due) for t in range(first + 1, last + 1)), ppmt(rate_, first, n, present, 0, due))


def level_principal_interest(rate_: Number, period: Number, n: Number, present: Number) -> Column:
    """ISPMT: interest where the principal is repaid in equal parts; periods from 0."""
    return -_c(present) * _c(rate_) * (1 - _div(_c(period), _c(n)))


def scheduled_value(principal: Number, rates: Column) -> Column:
    return F.aggregate(rates, _c(principal), lambda a, r: a * (1 + r))


def duration(rate_: Number, present: Number, future: Number) -> Column:
    """PDURATION: periods until a value is reached."""
    r, a, b = map(_c, (rate_, present, future))
    return F.when((r > 0) & (a > 0) & (b > 0), (F.ln(b) - F.ln(a)) / F.ln(1 + r))


def growth_rate(n: Number, present: Number, future: Number) -> Column:
    """RRI: the rate that grows one value into another."""
    return F.when(_c(n) > 0, F.pow(_div(_c(future), _c(present)), 1 / _c(n)) - 1)


def npv(rate: Number, cf: Column) -> Column:
    """Period 0 is not discounted. Horner's rule from the last period."""
    rate = _c(rate)
    return F.aggregate(F.reverse(cf), F.lit(0.0), lambda a, v: F.try_divide(a, 1 + rate) + v)


def npv_excel(rate: Number, cf: Column) -> Column:
    """The first value lies one period ahead."""
    return F.try_divide(npv(rate, cf), 1 + _c(rate))


def _has_both_signs(cf: Column) -> Column:
    return F.exists(cf, lambda v: v > 0) & F.exists(cf, lambda v: v < 0)


#: Rates are looked for from -0.99 to 10, by 0.0005 up to 1 and by 0.005 beyond.
def _roots(value: Callable[[Column], Column]) -> Column:
    """Every rate from -0.99 to 10 at which value(rate) changes its sign, rising: a grid (steps of 0.0005, from 1 on 0.005) finds them, bisection refines them."""
    grid = F.concat(F.transform(F.sequence(F.lit(0), F.lit(3979)), lambda i: i * 0.0005 - 0.99), F.transform(F.sequence(F.lit(0), F.lit(1800)), lambda i: 1 + i * 0.005))
    points = F.transform(grid, lambda x: F.struct(x.alias("x"), value(x).alias("f")))
    # Points are bound first, for they stand twice in the pairs.
    pairs = F.get(F.transform(F.array(points), lambda p: F.zip_with(F.slice(p, 1, 5780), F.slice(p, 2, 5780), lambda a, b: F.struct(a["x"].alias("lo"), a["f"].alias("f"), b["x"].alias("hi"), b["f"].alias("g")))), F.lit(0))
    held = F.filter(pairs, lambda p: (p["f"] == 0) | (F.signum(p["f"]) * F.signum(p["g"]) < 0) | ((p["g"] == 0) & (p["hi"] >= 10)))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        below = F.signum(value(mid)) == F.signum(s["f"])
        return F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), s["f"].alias("f"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))

    def root(p: Column) -> Column:
        start = F.struct(p["lo"].alias("lo"), p["f"].alias("f"), p["hi"].alias("hi"))
        return F.when(p["f"] == 0, p["lo"]).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2))

    return F.transform(held, root)


def _irrs(cf: Column) -> Column:
    """all_irrs as an expression, for the few rows of a branch."""
    return F.when(_has_both_signs(cf), _roots(lambda r: npv(r, cf))).otherwise(F.array().cast("array<double>"))


#: The grid of _roots, and numbers that a worker holds at a time.
GRID, HELD = np.concatenate([np.arange(3980) * 0.0005 - 0.99, 1 + np.arange(1801) * 0.005]), 2**20


def _roots_of(flows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and rate of every internal rate of rows of equally many flows, as _roots finds them."""

    def value(at: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.zeros(1)
        for v in at.T[::-1]:
            out = out / (1 + r) + (v[:, None] if r is GRID else v)
        return out

    f = value(flows, GRID)
    sign = np.sign(f)
    held = (f[:, :-1] == 0) | (sign[:, :-1] * sign[:, 1:] < 0)
    held[:, -1] |= f[:, -1] == 0
    row, k = np.nonzero(held)
    low, high, mine, side = GRID[k], GRID[k + 1], flows[row], sign[row, k]
    for _ in range(50):
        mid = (low + high) / 2
        below = np.sign(value(mine, mid)) == side
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return row, np.where(side == 0, GRID[k], (low + high) / 2)


def all_irrs(cf: Column) -> Column:
    """Every internal rate from -0.99 to 10, rising; none without a change of sign. Many rows are looked at together."""

    def found(cells: pa.Array) -> pa.Array:
        out: list[list[float]] = [[] for _ in range(len(cells))]
        rows = cells.to_pylist()
        known = [i for i, x in enumerate(rows) if x and None not in x and min(x) < 0 < max(x)]
        for size in {len(rows[i]) for i in known}:
            same = [i for i in known if len(rows[i]) == size]
            for k in range(0, len(same), HELD // len(GRID)):
                part = same[k : k + HELD // len(GRID)]
                with np.errstate(all="ignore"):
                    at, rates = _roots_of(np.array([rows[i] for i in part], dtype=float))
                for i, r in zip(at.tolist(), rates.tolist(), strict=True):
                    out[part[i]].append(r)
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(found, T.ArrayType(T.DoubleType()))(cf.cast("array<double>"))


def _nearest(roots: Column, guess: float) -> Column:
    return F.array_min(F.transform(roots, lambda r: F.struct(F.abs(r - guess).alias("d"), r.alias("r"))))["r"]


def irr(cf: Column, guess: float = 0.1, steps: int = 60) -> Column:
    """Newton's method on value and slope, both by Horner's rule; where it does not settle on a root, the one of all_irrs nearest to guess.

    NULL without a change of sign or a root.
    """
    start = F.struct(F.lit(guess).alias("r"), F.lit(1.0).alias("d"))

    def step(s: Column, _: Column) -> Column:
        x = F.try_divide(F.lit(1.0), 1 + s["r"])  # value as a polynomial of the discount factor
        both = F.aggregate(F.reverse(cf), F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("s")), lambda a, v: F.struct((a["v"] * x + v).alias("v"), (a["s"] * x + a["v"]).alias("s")))
        change = F.coalesce(F.try_divide(both["v"], -both["s"] * x * x), F.lit(0.0))
        then = F.greatest(s["r"] - change, (s["r"] - 1) / 2)  # stays above -1
        return F.struct(F.coalesce(then, s["r"]).alias("r"), F.coalesce(F.abs(then - s["r"]), F.lit(1.0)).alias("d"))

    found = F.aggregate(F.array(*[F.lit(i) for i in range(steps)]), start, step)
    scale = F.array_max(F.transform(cf, F.abs))
    settled = (found["d"] < 1e-9) & ~F.isnan(found["r"]) & (F.abs(npv(found["r"], cf)) <= scale * 1e-6)
    return F.when(_has_both_signs(cf), F.when(settled, found["r"]).otherwise(_nearest(_irrs(cf), guess)))


def mirr(cf: Column, finance: Number, reinvest: Number) -> Column:
    n = F.size(cf) - 1
    out = npv(finance, F.transform(cf, lambda v: F.least(v, F.lit(0.0))))
    back = npv(reinvest, F.transform(cf, lambda v: F.greatest(v, F.lit(0.0)))) * F.pow(1 + _c(reinvest), n)
    return F.when(_has_both_signs(cf), F.pow(F.try_divide(back, -out), F.try_divide(F.lit(1.0), n)) - 1)


def xnpv(rate: Number, cf: Column, days: Column) -> Column:
    """days: days since the first flow."""
    return F.aggregate(F.zip_with(cf, days, lambda v, d: F.try_divide(v, F.pow(1 + _c(rate), d / 365.0))), F.lit(0.0), lambda a, v: a + v)


def xirr(cf: Column, days: Column, guess: float = 0.1, steps: int = 60) -> Column:
    """As irr, for flows on days: Newton's method, else the root of the grid nearest to guess."""
    start = F.struct(F.lit(guess).alias("r"), F.lit(1.0).alias("d"))

    def step(s: Column, _: Column) -> Column:
        value = xnpv(s["r"], cf, days)
        slope = F.aggregate(F.zip_with(cf, days, lambda v, d: F.try_divide(-d / 365.0 * v, F.pow(1 + s["r"], d / 365.0 + 1))), F.lit(0.0), lambda a, v: a + v)
        then = F.greatest(s["r"] - F.coalesce(F.try_divide(value, slope), F.lit(0.0)), (s["r"] - 1) / 2)
        return F.struct(then.alias("r"), F.abs(then - s["r"]).alias("d"))

    found = F.aggregate(F.array(*[F.lit(i) for i in range(steps)]), start, step)
    scale = F.array_max(F.transform(cf, F.abs))
    settled = (found["d"] < 1e-9) & ~F.isnan(found["r"]) & (F.abs(xnpv(found["r"], cf, days)) <= scale * 1e-6)
    return F.when(_has_both_signs(cf), F.when(settled, found["r"]).otherwise(_nearest(_roots(lambda r: xnpv(r, cf, days)), guess)))


def payback(cf: Column) -> Column:
    """Periods until the cumulative flow recovers, interpolated; 0 if it never was negative, infinite if it stays so."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("t"), F.lit(False).alias("below"), F.lit(None).cast("double").alias("at"))

    def step(s: Column, v: Column) -> Column:
        total = s["sum"] + v
        back = s["below"] & (total >= 0) & s["at"].isNull()
        return F.struct(total.alias("sum"), (s["t"] + 1).alias("t"), (s["below"] | (total < 0)).alias("below"), F.when(back, s["t"] + F.try_divide(-s["sum"], v)).otherwise(s["at"]).alias("at"))

    end = F.aggregate(cf, start, step)
    return F.when(~end["below"], 0.0).otherwise(F.coalesce(end["at"], F.lit(float("inf"))))


def discounted(rate: Number, cf: Column) -> Column:
    return F.transform(cf, lambda v, i: F.try_divide(v, F.pow(1 + _c(rate), i)))


def profitability(rate: Number, cf: Column) -> Column:
    """Present value of the later flows per unit of the first, whatever its sign. NULL if that is 0."""
    return F.try_divide(npv(rate, cf) - cf[0], F.abs(cf[0]))


def annuity_equivalent(rate: Number, cf: Column) -> Column:
    n = F.size(cf) - 1
    return F.when(n > 0, -pmt(rate, n, npv(rate, cf)))


def indicators(rate: Number, cf: Column, reinvest: Number | None = None) -> list[Column]:
    return [
        npv(rate, cf).alias("npv"),
        irr(cf).alias("irr"),
        mirr(cf, rate, rate if reinvest is None else reinvest).alias("mirr"),
        payback(cf).alias("payback"),
        payback(discounted(rate, cf)).alias("discounted_payback"),
        profitability(rate, cf).alias("pi"),
        annuity_equivalent(rate, cf).alias("eaa"),
    ]


def loan_schedule(df: DataFrame, principal: str, rate: Number, periods: int, method: str = "french") -> DataFrame:
    """df with a row for each period: period, payment, interest, amortisation, balance; row 0 is the disbursement.

    Each period has a closed form, so a schedule is an explode without recursion.
    """
    p, r, n, t = F.col(principal), _c(rate), F.lit(float(periods)), F.col("period")
    if method == "french":
        grown = F.pow(1 + r, t)
        level = -pmt(r, n, p)
        balance = F.when(t == n, 0.0).otherwise(F.when(r == 0, p - level * t).otherwise(p * grown - level * (grown - 1) / r))
        before = F.when(r == 0, p - level * (t - 1)).otherwise(p * F.pow(1 + r, t - 1) - level * (F.pow(1 + r, t - 1) - 1) / r)
    elif method == "german":
        balance, before = F.when(t == n, 0.0).otherwise(p * (1 - t / n)), p * (1 - (t - 1) / n)
    elif method == "american":
        balance, before = F.when(t == n, 0.0).otherwise(p), p
    else:
        raise ValueError(f"unknown method {method}")
    out = df.withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(periods))))
    first = t == 0
    out = out.withColumns({"balance": F.when(first, p).otherwise(balance), "interest": F.when(first, 0.0).otherwise(before * r), "amortisation": F.when(first, 0.0).otherwise(before - balance)})
    return out.withColumn("payment", F.col("interest") + F.col("amortisation"))


def charges_of(c: Column, s: Column, life: int, method: str, units: list[float] | None = None) -> Column:
    """The charges of each year of life, as an array."""
    n = F.lit(float(life))
    years = F.array(*[F.lit(i) for i in range(1, life + 1)])
    if method == "straight_line":
        charges = F.transform(years, lambda _: (c - s) / n)
    elif method == "sum_of_years":
        charges = F.transform(years, lambda i: (c - s) * (n - i + 1) / (n * (n + 1) / 2))
    elif method == "declining":
        rate = F.floor((1 - F.pow(s / c, 1 / n)) * 1000 + 0.5) / 1000
        charges = F.transform(years, lambda i: c * F.pow(1 - rate, i - 1) * rate)
    elif method == "double_declining":
        start = F.struct(c.cast("double").alias("book"), F.array().cast("array<double>").alias("charges"))

        def step(a: Column, i: Column) -> Column:
            charge = F.least(F.greatest(a["book"] * 2 / n, (a["book"] - s) / (n - i + 1)), a["book"] - s)
            return F.struct((a["book"] - charge).alias("book"), F.concat(a["charges"], F.array(charge)).alias("charges"))

        charges = F.aggregate(years, start, step)["charges"]
    elif method == "units":
        total = sum(units or [])
        charges = F.array(*[(c - s) * (u / total) for u in units or []])
    else:
        raise ValueError(f"unknown method {method}")
    return charges


def depreciation(df: DataFrame, cost: str, salvage: str, life: int, method: str = "straight_line", units: list[float] | None = None) -> DataFrame:
    """df with a row for each year: year, charge, book.

    Straight line, sum of years, declining balance (rate to three places), double declining with a change to straight line, and
    by units (those of each year).
    """
    c, s, t = F.col(cost), F.col(salvage), F.col("year")
    out = df.withColumn("__c", charges_of(c, s, life, method, units)).select("*", F.posexplode("__c").alias("__i", "charge")).withColumn("year", F.col("__i") + 1)
    book = c - F.aggregate(F.slice(F.col("__c"), F.lit(1), t), F.lit(0.0), lambda a, v: a + v)
    return out.withColumn("book", book).drop("__c", "__i")


def carried_tax(taxable: Column, rate: Number) -> Column:
    """Tax of each period with loss carry-forward: losses reduce later taxable income; never negative."""
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<double>").alias("tax"))

    def step(a: Column, x: Column) -> Column:
        base = F.greatest(F.lit(0.0), x - a["carry"])
        return F.struct(F.greatest(F.lit(0.0), a["carry"] - x).alias("carry"), F.concat(a["tax"], F.array(base * _c(rate))).alias("tax"))

    return F.aggregate(taxable, start, step)["tax"]


def _balance(p: Column, r: Column, n: float, t: Column, method: str) -> Column:
    """What is owed after period t of n."""
    if method == "french":
        level = -pmt(r, n, p)
        grown = F.pow(1 + r, t)
        left = F.when(r == 0, p - level * t).otherwise(p * grown - level * (grown - 1) / r)
    else:
        left = {"german": p * (1 - t / n), "american": p}[method]
    return F.when(t >= n, 0.0).otherwise(left)


def project_cash_flow(df: DataFrame, horizon: int, life: int, method: str = "straight_line", loan: tuple[str, int] | None = None) -> DataFrame:
    """df with an array, from period 0 to the horizon, for each line of a project's cash flow.

    df has investment, working_capital, salvage, tax, and the arrays units, price, variable_cost and fixed_costs from period 1
    on, of which the last value goes on; with a loan (method, periods) also loan and loan_rate. Costs and outlays are negative.
    Assets lose their whole value over `life`; salvage is taxed on its gain over book value. Losses are carried forward. What is
    owed beyond the horizon is repaid there; the shield is what interest saves in taxes.
    """
    periods, tax, zero = F.sequence(F.lit(0), F.lit(horizon)), F.col("tax"), F.lit(0.0)
    each = lambda f: F.transform(periods, lambda t: F.when(t == 0, 0.0).otherwise(f(t)).cast("double"))
    at = lambda name, t: F.element_at(F.col(name), F.least(t, F.size(name)))
    only = lambda first, last: F.transform(periods, lambda t: (F.when(t == 0, first).otherwise(zero) + F.when(t == horizon, last).otherwise(zero)).cast("double"))
    plus = lambda *names: functools.reduce(lambda a, b: F.zip_with(a, F.col(b), lambda x, y: x + y), names[1:], F.col(names[0]))
    taxes = lambda base: F.concat(F.array(zero), F.transform(carried_tax(F.slice(base, 2, horizon), tax), lambda x: -x))
    charges = charges_of(F.col("investment").cast("double"), F.lit(0.0), life, method)
    df = df.withColumn("__charges", charges)
    charge = lambda t: F.coalesce(F.try_element_at("__charges", t), zero)
    df = df.withColumns({
        "revenue": each(lambda t: at("units", t) * at("price", t)),
        "variable_costs": each(lambda t: -at("units", t) * at("variable_cost", t)),
        "fixed_cost": each(lambda t: -at("fixed_costs", t)),
        "depreciation": each(lambda t: -charge(t)),
    })
    df = df.withColumn("ebt", plus("revenue", "variable_costs", "fixed_cost", "depreciation"))
    df = df.withColumn("taxes", taxes(F.col("ebt"))).withColumn("net_income", plus("ebt", "taxes"))
    book = F.greatest(zero, F.col("investment") + F.aggregate("depreciation", zero, lambda a, v: a + v))
    df = df.withColumns({
        "add_back": F.transform("depreciation", lambda v: -v),
        "investments": only(-F.col("investment"), zero),
        "working": only(-F.col("working_capital"), F.col("working_capital")),
        "salvages": only(zero, F.col("salvage")),
        "salvage_tax": only(zero, -tax * (F.col("salvage") - book)),
    })
    df = df.withColumn("free_cash_flow", plus("net_income", "add_back", "investments", "working", "salvages", "salvage_tax"))
    if loan:
        p, r, (how, n) = F.col("loan").cast("double"), F.col("loan_rate"), loan
        owed = lambda t: _balance(p, r, float(n), t, how)
        df = df.withColumns({"proceeds": only(p, zero), "interest": each(lambda t: -owed(t - 1) * r), "repayment": each(lambda t: owed(t) - owed(t - 1) - F.when(t == horizon, owed(t)).otherwise(zero))})
        df = df.withColumn("__levered", taxes(plus("ebt", "interest")))
        df = df.withColumn("shield", F.zip_with("__levered", "taxes", lambda x, y: x - y)).drop("__levered")
        df = df.withColumn("equity_cash_flow", plus("free_cash_flow", "proceeds", "interest", "shield", "repayment"))
    return df.drop("__charges")


def break_even(fixed: Number, price: Number, variable: Number) -> Column:
    margin = _c(price) - _c(variable)
    return F.when(margin > 0, F.try_divide(_c(fixed), margin)).otherwise(float("inf"))


def scenario_summary(df: DataFrame, probability: str, value: str, by: list[str] | None = None) -> DataFrame:
    """mean, sd, cv of weighted scenarios; probabilities are normalised."""
    p, v = F.col(probability), F.col(value)
    s = df.groupBy(*(by or [])).agg(F.sum(p).alias("__p"), F.sum(p * v).alias("__pv"), F.sum(p * v * v).alias("__pvv"))
    mean = _div(F.col("__pv"), F.col("__p"))
    sd = F.sqrt(F.greatest(F.lit(0.0), _div(F.col("__pvv"), F.col("__p")) - mean * mean))
    return s.select(*(by or []), mean.alias("mean"), sd.alias("sd"), F.when(mean != 0, sd / F.abs(mean)).alias("cv"))


def npv_profile(df: DataFrame, cf: str, top: float, points: int = 61) -> DataFrame:
    """df with rate, npv over an even grid of rates."""
    return df.withColumn("rate", F.explode(F.array(*[F.lit(top * i / (points - 1)) for i in range(points)]))).withColumn("npv", npv(F.col("rate"), F.col(cf)))
