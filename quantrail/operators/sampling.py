"""Trials: uniform numbers by Monte Carlo or Latin hypercube, correlation by rank reordering, and model runs.

Every number is a hash of (seed, input, trial), so results do not depend on partitions and a lost executor's rows come back
the same.
"""

from __future__ import annotations

import hashlib
import math
import secrets

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distributions import CENTRE, SHOULDER, TAIL, normal
from ..functions.random import uniform
from ..plans.models import Model
from ..sources.folders import cut
from .ranking import places


def uniforms(spark: SparkSession, trials: int, names: list[str], seed: int = 12345, method: str = "mc", mixed: dict[str, Column] | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """trial and one uniform column for each name, for all trials or those of a range.

    With "lhs" each column has one draw in each of `trials` strata. A keyed permutation of the strata gives each trial its own, in
    expressions alone; for the names of mixed (a number between 0 and 1) it is the order of that number, found by ranges.
    """
    base = spark.range(*(between or (0, trials))).withColumnRenamed("id", "trial")
    if method == "mc":
        return base.select("trial", *[uniform(seed, n, "trial").alias(n) for n in names])
    orders = {n: o for n, o in (mixed or {}).items() if n in names}
    out = with_strata(base, "trial", trials, [n for n in names if n not in orders], seed)
    if orders:
        ranked = spark.range(trials).withColumnRenamed("id", "trial")
        long = ranked.select("trial", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), o.alias("h")) for n, o in orders.items()])).alias("o")).select("trial", "o.*")
        out = out.join(lhs(long, trials, seed).groupBy("trial").agg(*[F.max(F.when(F.col("name") == n, F.col("u"))).alias(n) for n in orders]), "trial")
    return out.select("trial", *names)


#: A prime below 2^31, so that products of residues fit a long.
PRIME = 2147483647
#: Double rounds of the permutation; numbers below SMALL are permuted by swaps alone.
ROUNDS, SMALL = 3, 16


def halves(n: int) -> tuple[int, int]:
    """a and b near the root of n, with the greatest product of at most n."""
    root = max(1, math.isqrt(n))
    a = min(range(root, root // 2, -1), key=lambda x: n % x)
    return a, n // a


def permuted(df: DataFrame, trial: str, n: int, names: list[str], seed: int) -> DataFrame:
    """df with a column s_name for each name: a permutation of 0 .. n - 1, keyed by seed and name, of the trial number in that range.

    A number is two digits to the bases of halves(n); rounds add a keyed hash of one digit to the other (a Feistel network, of which
    every round can be undone). The few numbers from the bases' product on come in by swaps, each with a keyed smaller number or itself,
    as in a shuffle.
    """
    a, b = halves(n) if n >= SMALL else (1, 1)

    def key(name: str, *of: object) -> int:
        return int.from_bytes(hashlib.md5("|".join(map(str, (seed, name, *of))).encode()).digest()[:8], "big")

    def mixed(x: Column, name: str, k: int) -> Column:
        k1, k2, k3 = (key(name, k, j) % (PRIME - 1) + 1 for j in range(3))
        t = (x + k1) % PRIME
        return (t * t % PRIME) * ((x * k2 + k3) % PRIME) % PRIME

    x = F.col(trial).cast("long")
    out = df.withColumns({c: v for m in names for c, v in ((f"__l_{m}", F.expr(f"cast(`{trial}` as long) div {b}")), (f"__r_{m}", x % b))})
    for k in range(ROUNDS):
        out = out.withColumns({f"__l_{m}": (F.col(f"__l_{m}") + mixed(F.col(f"__r_{m}"), m, 2 * k)) % a for m in names})
        out = out.withColumns({f"__r_{m}": (F.col(f"__r_{m}") + mixed(F.col(f"__l_{m}"), m, 2 * k + 1)) % b for m in names})
    out = out.withColumns({f"s_{m}": F.when(x < a * b, F.col(f"__l_{m}") * b + F.col(f"__r_{m}")).otherwise(x) for m in names})
    for i in range(a * b, n):
        swap = {m: key(m, "swap", i) % (i + 1) for m in names}
        out = out.withColumns({f"s_{m}": F.when(F.col(f"s_{m}") == i, j).when(F.col(f"s_{m}") == j, i).otherwise(F.col(f"s_{m}")) for m, j in swap.items()})
    return out.drop(*[f"__{side}_{m}" for m in names for side in "lr"])


def numbered(df: DataFrame, key: str, *more: str, name: str = "trial") -> DataFrame:
    """df with trial (or another name), its place from 0 in the order of a key and those that part its ties: sorted by ranges, each with the rows of earlier ranges added."""
    dealt = cut(df.repartitionByRange(key, *more).sortWithinPartitions(key, *more).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place")))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__m"), F.min("__place").alias("__first"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = counts.select("__part", (F.coalesce(F.sum("__m").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    return dealt.join(F.broadcast(shift), "__part").withColumn(name, F.col("__place") + F.col("__shift")).drop("__part", "__place", "__shift")


def with_strata(df: DataFrame, trial: str, trials: int, names: list[str], seed: int = 12345) -> DataFrame:
    """df with a Latin hypercube column for each name: over trial numbers 0 .. trials - 1, one draw in each of as many strata."""
    if not names or trials <= 0:
        return df.withColumns({m: F.lit(None).cast("double") for m in names})
    out = permuted(df, trial, trials, names, seed)
    return out.withColumns({m: (F.col(f"s_{m}") + uniform(seed, f"{m}#j", F.col(f"s_{m}") + 1)) / trials for m in names}).drop(*[f"s_{m}" for m in names])


def lhs(long: DataFrame, trials: int, seed: int) -> DataFrame:
    """trial, name, u for rows (trial, name, h): u lies in the stratum that the order of h gives the trial. A stratum's draw is the same whichever trial has it."""
    blocks = max(1, trials // 100_000)
    placed = places(long.withColumn("h", F.coalesce("h", F.lit(0.0))), F.col("h"), F.least(F.floor(F.col("__v") * blocks), F.lit(blocks - 1)).cast("int"), ["name"], "trial")
    return placed.select("trial", "name", ((F.col("place") - 1 + uniform(seed, F.concat(F.col("name"), F.lit("#j")), F.col("place"))) / trials).alias("u"))


def correlation_matrix(names: list[str], pairs: list[tuple[str, str, float]]) -> np.ndarray:
    """Unknown names and self pairs are ignored, values clamped; a later pair wins."""
    out, at = np.eye(len(names)), {n: i for i, n in enumerate(names)}
    for a, b, rho in pairs:
        if a in at and b in at and a != b:
            out[at[a], at[b]] = out[at[b], at[a]] = min(1.0, max(-1.0, rho))
    return out


def nearest_correlation(m: np.ndarray, least: float = 1e-6, steps: int = 200) -> np.ndarray:
    """The nearest correlation matrix by alternating projections with Dykstra's correction (Higham, 2002)."""
    if np.linalg.eigvalsh(m).min() > least:
        return m
    y, ds = m.copy(), np.zeros_like(m)
    for _ in range(steps):
        r = y - ds
        w, v = np.linalg.eigh((r + r.T) / 2)
        x = (v * np.maximum(w, least)) @ v.T
        ds, before = x - r, y
        y = x.copy()
        np.fill_diagonal(y, 1.0)
        if np.abs(y - before).max() < 1e-10:
            break
    w, v = np.linalg.eigh((y + y.T) / 2)
    y = (v * np.maximum(w, least)) @ v.T
    s = np.sqrt(np.diag(y))
    return y / np.outer(s, s)


def scored(df: DataFrame, k: int, seed: int) -> DataFrame:
    """The column trial of df and k independent normal scores of it, s0 and on."""
    hashed = df.select("trial", *[uniform(seed, f"#s{i}", "trial").alias(f"__u{i}") for i in range(k)])
    return hashed.select("trial", *[F.expr(normal(0, 1).quantile(f"__u{i}")).alias(f"s{i}") for i in range(k)])


def mixing(scores: DataFrame, k: int, target: np.ndarray) -> np.ndarray:
    """The lower triangle that gives k scores the correlations of the target: their sample correlation, one small aggregation, is taken out before the target's is put in."""
    goal = nearest_correlation(2 * np.sin(np.pi / 6 * target))
    got = scores.agg(*[F.corr(f"s{i}", f"s{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i)]).first()
    sample = np.eye(k)
    for i in range(k):
        for j in range(i):
            sample[i, j] = sample[j, i] = got[f"c{i}_{j}"]
    return np.linalg.cholesky(goal) @ np.linalg.inv(np.linalg.cholesky(nearest_correlation(sample)))


def _mixed(plain: list[Column], mix: np.ndarray) -> list[Column]:
    return [sum((plain[j] * float(mix[i, j]) for j in range(1, len(plain))), plain[0] * float(mix[i, 0])) for i in range(len(plain))]


def mixed_scores(spark: SparkSession, k: int, target: np.ndarray, trials: int, seed: int) -> list[Column]:
    """For each of k columns a normal score of the column trial, in expressions; over 0 .. trials - 1 they have the correlations of the target."""
    mix = mixing(scored(spark.range(trials).withColumnRenamed("id", "trial"), k, seed), k, target)
    return _mixed([F.transform(F.array(uniform(seed, f"#s{i}", "trial")), lambda u: _normal_of(u))[0] for i in range(k)], mix)


def _normal_of(u: Column) -> Column:
    """The normal quantile of a column that is not a name."""
    q = u - 0.5
    r = F.sqrt(-F.ln(F.when(u < 0.5, u).otherwise(1 - u)))

    def of(x: Column, pair: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
        top, low = F.lit(pair[0][0]), F.lit(pair[1][0])
        for a, b in zip(pair[0][1:], pair[1][1:], strict=True):
            top, low = top * x + a, low * x + b
        return top / low

    far = F.when(r <= 5, of(r - 1.6, SHOULDER)).otherwise(of(r - 5, TAIL))
    return F.when(F.abs(q) <= 0.425, q * of(0.180625 - q * q, CENTRE)).when(q < 0, -far).otherwise(far)


def _unit(score: Column) -> Column:
    """A rising map of a normal score into (0, 1), nearly uniform."""
    return 1 / (1 + F.exp(-1.702 * score))


def rank_correlate(df: DataFrame, names: list[str], target: np.ndarray, trials: int, seed: int = 12345) -> DataFrame:
    """Reorders columns so that their rank correlations are near the target (Iman and Conover, 1982); marginals stay.

    Normal scores are hashed once and written. Values and mixed scores are numbered in the order of (column, value), so a frequent value is
    many ranges, and meet by a join on the number.
    """
    if len(names) < 2 or trials < 3:
        return df
    k = len(names)
    long = lambda rows, columns: rows.select("trial", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("v")) for i, c in enumerate(columns)])).alias("x")).select("trial", "x.*")
    scores = cut(scored(df, k, seed))
    mixed = _mixed([F.col(f"s{i}") for i in range(k)], mixing(scores, k, target))
    to, values = (numbered(x, "i", "v", "trial", name="place") for x in (long(scores, mixed), long(df, [F.col(n).cast("double") for n in names])))
    new = to.select("place", "trial").join(values.select("place", "i", "v"), "place").groupBy("trial").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(n) for i, n in enumerate(names)])
    rest = [c for c in df.columns if c not in names and c != "trial"]
    return df.select("trial", *rest).join(new, "trial") if rest else new


def simulate(spark: SparkSession, model: Model, trials: int, seed: int | None = 12345, method: str = "mc", correlate: bool = True, given: DataFrame | None = None) -> DataFrame:
    """trial, the sampled inputs and every cell of the model. Without a seed one is drawn; it is the column seed of every row. given: one row of base values.

    With Latin hypercube sampling, correlated inputs take their strata in the order of mixed scores, so no values are moved afterwards.
    """
    drawn = secrets.randbelow(2**31) if seed is None else seed
    names = [*model.assumptions]
    involved = [n for n in names if any(n in p[:2] for p in model.correlations)] if correlate and trials >= 3 else []
    target = correlation_matrix(involved, model.correlations)
    if method == "lhs" and involved:
        mixed = {f"u_{n}": _unit(s) for n, s in zip(involved, mixed_scores(spark, len(involved), target, trials, drawn), strict=True)}
        df = uniforms(spark, trials, [f"u_{n}" for n in names], drawn, method, mixed)
    else:
        df = uniforms(spark, trials, [f"u_{n}" for n in names], drawn, method)
        if involved:
            df = rank_correlate(cut(df), [f"u_{n}" for n in involved], target, trials, drawn)
    # Inputs are written once: their quantiles and the model's cells in one projection would be more code than a compiled stage takes.
    df = cut(df.select("trial", *[f.sample(f"u_{n}").alias(n) for n, f in model.assumptions.items()]))
    done = model.evaluate(df if given is None else df.crossJoin(F.broadcast(given)))
    return done if seed is not None else done.withColumn("seed", F.lit(drawn))
