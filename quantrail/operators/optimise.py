"""Search for the best decisions under constraints. Searches ask for points; the points that all of them ask for at a time are one Spark job.

A point's objective and constraints are aggregates over the same rows for every point (common random numbers). Searches are
coroutines: they yield points and are sent values, so the restarts of a simplex, the right-hand sides of a frontier or the chains of
an annealing advance together. No point is evaluated twice, and distinct points are counted against a budget that is never exceeded.

Of two points the better one is, by the rules of Deb (2000), the feasible one; of two feasible ones that of the better objective; of two
others that of the smaller violation. An objective or constraint without a value makes a point as infeasible as can be.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.models import Model
from ..sources.folders import cut

#: Violations up to this, in parts of max(1, |rhs|), are none.
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Variable:
    name: str
    low: float
    high: float
    step: float = 0.0  # 0: continuous

    def snapped(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)
        if not self.step:
            return x
        most = np.floor((self.high - self.low) / self.step + 1e-9)
        # Decimal steps don't add up exactly; twelve digits tell grid points apart.
        return np.round(self.low + np.clip(np.floor((x - self.low) / self.step + 0.5), 0, most) * self.step, 12)


@dataclass(frozen=True)
class Constraint:
    """An aggregate expression of the model's cells, its sense (<=, >= or =) and its right-hand side."""

    name: str
    statistic: str
    sense: str
    rhs: float


@dataclass(frozen=True)
class Problem:
    """samples: the rows that every point sees; model: a Model, or a function of rows that have the variables as columns."""

    model: Model | Callable[[DataFrame], DataFrame]
    samples: DataFrame
    variables: list[Variable]
    objective: str
    constraints: list[Constraint] = field(default_factory=list)
    maximise: bool = True

    @property
    def rhs(self) -> np.ndarray:
        return np.array([c.rhs for c in self.constraints], float)

    def snapped(self, points: np.ndarray) -> np.ndarray:
        return np.stack([v.snapped(points[:, i]) for i, v in enumerate(self.variables)], axis=1)


@dataclass(frozen=True)
class Best:
    x: dict[str, float]
    value: float
    feasible: bool
    constraints: dict[str, float]
    evaluations: int
    jobs: int
    algorithm: str


class Evaluations:
    """The distinct points evaluated so far, with objective and constraint values, and what is left of a budget."""

    def __init__(self, problem: Problem, budget: int):
        self.problem, self.budget, self.limit, self.jobs = problem, budget, budget, 0
        self.samples = cut(problem.samples)
        self.memory: dict[tuple[float, ...], np.ndarray] = {}

    @property
    def spent(self) -> bool:
        return len(self.memory) >= min(self.budget, self.limit)

    def values(self, points: np.ndarray) -> np.ndarray:
        """A row (objective, constraints) for each point; NaN for new points beyond the budget."""
        asked = [tuple(p) for p in points.tolist()]
        new = list(dict.fromkeys(p for p in asked if p not in self.memory))[: max(0, min(self.budget, self.limit) - len(self.memory))]
        if new:
            self.jobs += 1
            self.memory |= self.evaluated(new)
        return np.array([self.memory.get(p, np.full(1 + len(self.problem.constraints), np.nan)) for p in asked])

    def evaluated(self, new: list[tuple[float, ...]]) -> dict[tuple[float, ...], np.ndarray]:
        """The job of a step: every point with every row of the samples."""
        names = [v.name for v in self.problem.variables]
        rows = self.samples.select("*", F.posexplode(F.lit([list(p) for p in new])).alias("__point", "__x"))
        rows = rows.select("*", *[F.col("__x")[i].alias(n) for i, n in enumerate(names)]).drop("__x")
        model = self.problem.model
        done = (model.evaluate if isinstance(model, Model) else model)(rows)
        stats = [F.expr(self.problem.objective), *[F.expr(c.statistic) for c in self.problem.constraints]]
        found = done.groupBy("__point").agg(*[s.cast("double").alias(f"s{i}") for i, s in enumerate(stats)]).collect()  # a row for each point
        out = dict.fromkeys(new, np.full(len(stats), np.nan))
        return out | {new[r[0]]: np.array([np.nan if v is None else v for v in r[1:]], float) for r in found}

    def residuals(self, values: np.ndarray, rhs: np.ndarray) -> np.ndarray:
        """At most 0 (or 0, for =) where a constraint holds, in parts of max(1, |rhs|)."""
        sign = np.array([-1.0 if c.sense == ">=" else 1.0 for c in self.problem.constraints])
        return (values[:, 1:] - rhs) * sign / np.maximum(1, np.abs(rhs))

    def violations(self, values: np.ndarray, rhs: np.ndarray) -> np.ndarray:
        r = self.residuals(values, rhs)
        equal = np.array([c.sense == "=" for c in self.problem.constraints], bool)
        v = np.where(equal, np.abs(r), np.maximum(r, 0)).sum(axis=1) if len(rhs) else np.zeros(len(values))
        v = np.where(np.isfinite(values).all(axis=1), v, np.inf)
        return np.where(v <= TOLERANCE, 0.0, v)

    def cost(self, values: np.ndarray) -> np.ndarray:
        """The objective, to be minimised."""
        return np.where(np.isnan(values[:, 0]), np.inf, -values[:, 0] if self.problem.maximise else values[:, 0])

    def order(self, values: np.ndarray, rhs: np.ndarray) -> np.ndarray:
        """Places from the best to the worst."""
        v = self.violations(values, rhs)
        return np.lexsort((np.where(v > 0, 0.0, self.cost(values)), v))

    def best(self, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The best point so far and its values, whichever search asked for it."""
        if not self.memory:
            return None
        points, values = np.array([*self.memory]), np.array([*self.memory.values()])
        i = self.order(values, rhs)[0]
        return points[i], values[i]

    def result(self, rhs: np.ndarray, algorithm: str) -> Best:
        found = self.best(rhs)
        names = [v.name for v in self.problem.variables]
        if found is None:
            return Best({}, np.nan, False, {}, 0, 0, algorithm)
        x, values = found
        fine = bool(self.violations(values[None], rhs)[0] == 0)
        return Best(dict(zip(names, x.tolist(), strict=True)), float(values[0]), fine, {c.name: float(v) for c, v in zip(self.problem.constraints, values[1:], strict=True)}, len(self.memory), self.jobs, algorithm)


Search = Generator[np.ndarray, np.ndarray, None]


def lockstep(ev: Evaluations, searches: list[Search]) -> None:
    """Advances all searches together until each has ended or the budget is spent; what they ask for at a time is one job."""
    asks: dict[int, np.ndarray] = {}
    live = dict(enumerate(searches))
    sent: dict[int, np.ndarray | None] = dict.fromkeys(live)
    while live and not ev.spent:
        for i in [*live]:
            try:
                asks[i] = ev.problem.snapped(live[i].send(sent[i]))
            except StopIteration:
                del live[i]
                asks.pop(i, None)
        if asks:
            got = np.split(ev.values(np.concatenate([*asks.values()])), np.cumsum([len(a) for a in asks.values()])[:-1])
            sent = dict(zip(asks, got, strict=True))


def _box(variables: list[Variable]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([v.low for v in variables], float), np.array([v.high - v.low for v in variables], float)


def genetic(ev: Evaluations, rhs: np.ndarray, generations: int = 60, size: int = 24, seed: int = 7, stall: int = 15, start: np.ndarray | None = None) -> Search:
    """Tournaments, simulated binary crossover and polynomial mutation; parents compete with children."""
    rng, (low, span) = np.random.default_rng(seed), _box(ev.problem.variables)
    d = len(low)
    people = ev.problem.snapped(low + rng.random((size, d)) * span)
    if start is not None:
        people[0] = start
    values = yield people
    idle = 0
    for _ in range(generations):
        rank = np.empty(size, int)
        rank[ev.order(values, rhs)] = np.arange(size)
        pick = lambda rank=rank: people[np.where(rank[(p := rng.integers(0, size, (size, 2)))[:, 0]] < rank[p[:, 1]], p[:, 0], p[:, 1])]
        a, b, u = pick(), pick(), rng.random((size, d))
        spread = np.where(u < 0.5, (2 * u) ** (1 / 16), (1 / (2 * (1 - u))) ** (1 / 16))
        children = np.where(rng.random((size, 1)) < 0.9, 0.5 * ((1 + spread) * a + (1 - spread) * b), a)
        m, u = rng.random((size, d)) < 1 / d, rng.random((size, d))
        delta = np.where(u < 0.5, (2 * u) ** (1 / 21) - 1, 1 - (2 * (1 - u)) ** (1 / 21))
        steps = np.array([v.step for v in ev.problem.variables])
        moved = np.where(np.abs(delta * span) < steps, np.sign(delta) * steps, delta * span)  # at least a step of a grid
        children = ev.problem.snapped(np.where(m, children + moved, children))
        before = values[ev.order(values, rhs)[0]]
        every, found = np.concatenate([people, children]), np.concatenate([values, (yield children)])
        first = np.unique(every, axis=0, return_index=True)[1]
        keep = first[ev.order(found[first], rhs)][:size]
        keep = np.concatenate([keep, ev.order(found, rhs)[: size - len(keep)]])
        people, values = every[keep], found[keep]
        idle = idle + 1 if ev.order(np.stack([before, values[0]]), rhs)[0] == 0 else 0
        if idle >= stall:
            return


def neighbours(ev: Evaluations, rhs: np.ndarray) -> Search:
    """From the best point on, moves to the best neighbour on the grid (a step of one variable, or of two) while that is better. For variables with steps."""
    steps = np.array([v.step for v in ev.problem.variables])
    d = len(steps)
    one = np.concatenate([np.diag(steps), -np.diag(steps)])
    two = [one[i] + one[j] for i in range(2 * d) for j in range(i) if i % d != j % d]
    moves = np.array([m for m in [*one, *two] if m.any()])
    while len(moves):
        x, values = ev.best(rhs)
        found = yield ev.problem.snapped(x + moves)
        if ev.order(np.concatenate([values[None], found]), rhs)[0] == 0:
            return


def simplex(ev: Evaluations, rhs: np.ndarray, start: np.ndarray | None = None, step: float = 0.1, outer: int = 12, tolerance: float = 1e-7, steps: int = 200) -> Search:
    """The simplex of Nelder and Mead in the unit box, with coefficients by dimension (Gao and Han, 2012), on an augmented Lagrangian.

    The four trial points of a step are asked for at a time. Without a start, and after every update of the multipliers, it begins at the
    best point known by then, whichever search found it, if that is better than its own.
    """
    low, span = _box(ev.problem.variables)
    span = np.where(span > 0, span, 1.0)
    n, m = len(low), len(rhs)
    equal = np.array([c.sense == "=" for c in ev.problem.constraints], bool)
    alpha, gamma, rho_, sigma = (1.0, 1 + 2 / n, 0.75 - 1 / (2 * n), 1 - 1 / n) if n > 1 else (1.0, 2.0, 0.5, 0.5)
    unit = lambda x: (ev.problem.snapped(x) - low) / span
    if start is None:
        known = ev.best(rhs)
        start = known[0] if known else low + span / 2
    at = unit(start[None])[0]
    own = (yield (low + at * span)[None])[0]
    scale = max(1.0, abs(own[0]) if np.isfinite(own[0]) else 1.0)
    multipliers, weight, worst = np.zeros(m), 10 * scale, np.inf

    def merit(values: np.ndarray) -> np.ndarray:
        f = ev.cost(values)
        if m:
            c = ev.residuals(values, rhs)
            t = multipliers + weight * c
            inside = multipliers * c + 0.5 * weight * c * c
            f = f + np.where(equal | (t > 0), inside, -(multipliers**2) / (2 * weight)).sum(axis=1)
        return np.where(np.isnan(f), np.inf, f)

    for k in range(outer if m else 1):
        inner = max(tolerance, 1e-3 * 0.1**k) if m else tolerance
        points = np.vstack([at, at + np.where(at + step > 1, -step, step)[:, None] * np.eye(n)])
        values = yield low + points * span
        points = unit(low + points * span)
        for _ in range(steps):
            f = merit(values)
            order = np.argsort(f, kind="stable")
            points, values, f = points[order], values[order], f[order]
            wide = np.abs(points[1:] - points[0]).max()
            if wide <= inner or np.isfinite(f[0]) and abs(f[-1] - f[0]) <= inner * (1 + abs(f[0])) * 1e-2 and wide <= np.sqrt(inner):
                break
            centre = points[:-1].mean(axis=0)
            away = centre - points[-1]
            trial = np.clip(centre + np.array([alpha, alpha * gamma, alpha * rho_, -rho_])[:, None] * away, 0, 1)
            got = yield low + trial * span
            trial, g = unit(low + trial * span), merit(got)
            if g[0] < f[0]:
                take = 1 if g[1] < g[0] else 0
            elif g[0] < f[-2]:
                take = 0
            elif g[0] < f[-1]:
                take = 2 if g[2] <= g[0] else -1
            else:
                take = 3 if g[3] < f[-1] else -1
            if take >= 0:
                points[-1], values[-1] = trial[take], got[take]
            else:
                points[1:] = points[0] + sigma * (points[1:] - points[0])
                values = np.vstack([values[:1], (yield low + points[1:] * span)])
                points = unit(low + points * span)
        at, own = points[0], values[0]
        if m:
            c = ev.residuals(own[None], rhs)[0]
            new = np.where(equal, multipliers + weight * c, np.maximum(0, multipliers + weight * c))
            far = np.where(equal, np.abs(c), np.maximum(np.maximum(c, 0), np.minimum(np.abs(c), multipliers / weight))).max()
            settled = far <= TOLERANCE and np.abs(new - multipliers).max() <= 1e-6 * (1 + np.abs(new).max())
            weight = weight * 4 if far > 0.25 * worst else weight
            multipliers, worst = new, far
            if settled:
                return
            known = ev.best(rhs)[0]
            if ev.violations(own[None], rhs)[0] > 0.1 or k == 0:
                at = unit(known[None])[0]
            step = max(0.3 * step, 1e-3)


def annealing(ev: Evaluations, rhs: np.ndarray, chains: int = 8, steps: int = 60, seed: int = 7) -> Search:
    """Simulated annealing of several chains; infeasible points rank by violation, as costs beyond every feasible one's."""
    rng, (low, span) = np.random.default_rng(seed), _box(ev.problem.variables)
    at = ev.problem.snapped(low + rng.random((chains, len(low))) * span)
    values = yield at
    heat = max(float(np.ptp(c[np.isfinite(c)])) if np.isfinite(c := ev.cost(values)).any() else 0.0, 1e-9)
    for k in range(steps):
        t = heat * 1e-6 ** (k / steps)
        near = ev.problem.snapped(at + rng.normal(0, 0.25 * 0.05 ** (k / steps), at.shape) * span)
        got = yield near
        better = np.array([ev.order(np.stack([a, b]), rhs)[0] == 1 for a, b in zip(values, got, strict=True)])
        alike = ev.violations(values, rhs) == ev.violations(got, rhs)
        with np.errstate(invalid="ignore"):
            worse = np.nan_to_num(np.exp(np.clip((ev.cost(values) - ev.cost(got)) / t, -700, 0)))
        take = better | alike & (rng.random(chains) < worse)
        at[take], values[take] = near[take], got[take]


def _searches(ev: Evaluations, sides: list[np.ndarray], algorithm: str, start: np.ndarray | None, seed: int, restarts: int) -> str:
    """Runs an algorithm for all right-hand sides together."""
    (low, span), variables = _box(ev.problem.variables), ev.problem.variables
    stepped = any(v.step for v in variables)
    chosen = algorithm
    if algorithm == "auto":
        chosen = "genetic" if stepped else "genetic+simplex" if ev.problem.constraints else "simplex"
    if start is not None:
        ev.values(ev.problem.snapped(start[None]))
    if "genetic" in chosen:
        if "simplex" in chosen:
            ev.limit = len(ev.memory) + (ev.budget - len(ev.memory)) // 2  # half for the exploration
        lockstep(ev, [genetic(ev, s, seed=seed + i, start=start) for i, s in enumerate(sides)])
        ev.limit = ev.budget
    if chosen == "annealing":
        lockstep(ev, [annealing(ev, s, seed=seed + i) for i, s in enumerate(sides)])
    if "simplex" in chosen:
        rng = np.random.default_rng(seed)
        starts = [start if start is not None else None, *(low + rng.random((restarts, len(low))) * span)] if chosen == "simplex" else [None]
        lockstep(ev, [simplex(ev, s, x, 0.1 if chosen == "simplex" else 0.05) for s in sides for x in starts])
    if stepped:
        lockstep(ev, [neighbours(ev, s) for s in sides])
    return chosen


def optimise(problem: Problem, algorithm: str = "auto", budget: int = 2000, start: dict[str, float] | None = None, seed: int = 7, restarts: int = 3) -> Best:
    """The best point found. auto: genetic where a variable has steps, genetic and then a simplex with constraints, else simplexes from several starts."""
    ev = Evaluations(problem, budget)
    first = None if start is None else np.array([start[v.name] for v in problem.variables], float)
    chosen = _searches(ev, [problem.rhs], algorithm, first, seed, restarts)
    return ev.result(problem.rhs, chosen)


def frontier(problem: Problem, constraint: str, sides: list[float], algorithm: str = "auto", budget: int = 5000, seed: int = 7) -> list[tuple[float, Best]]:
    """The best point for each right-hand side of a constraint. All sides are searched together, so a step of all is one job, and a point that one asked for serves every other, as its start too."""
    at = [c.name for c in problem.constraints].index(constraint)
    rhs = [np.array([*problem.rhs[:at], s, *problem.rhs[at + 1 :]]) for s in sides]
    ev = Evaluations(problem, budget)
    chosen = _searches(ev, rhs, algorithm, None, seed, 2)
    return [(s, replace(ev.result(r, chosen))) for s, r in zip(sides, rhs, strict=True)]
