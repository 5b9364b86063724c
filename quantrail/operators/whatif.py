"""What-if analysis: scenario rows that go through a model in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.models import Model
from .ranking import percentiles


def _scenarios(spark: SparkSession, model: Model, rows: list[tuple[str, str, str, float]]) -> DataFrame:
    """input, point, with the overridden input as a column; other inputs at their base values."""
    df = spark.createDataFrame(rows, "input string, point string, target string, value double")
    inputs = {n: F.when(F.col("target") == n, F.col("value")).otherwise(F.lit(float(v))) for n, v in model.inputs.items()}
    return model.evaluate(df.withColumns(inputs))


def points(model: Model, name: str, shares: list[float], spark: SparkSession) -> list[float]:
    """Quantiles of an input's assumption, or its base value times 1 + share where it has none."""
    if name not in model.assumptions:
        return [model.inputs[name] * (1 + s) for s in shares]
    grid = spark.createDataFrame([(i, float(s)) for i, s in enumerate(shares)], "i int, u double")
    return [r[1] for r in sorted(grid.select("i", model.assumptions[name].sample("u")).collect())]  # a row for each share


def tornado(spark: SparkSession, model: Model, output: str, names: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """input, low, high, swing, share of squared swings: each input by itself at two quantiles."""
    rows = []
    for n in names:
        lo, hi = points(model, n, [low, high], spark)
        rows += [(n, "low", n, float(lo)), (n, "high", n, float(hi))]
    done = _scenarios(spark, model, rows)
    out = done.groupBy("input").agg(F.max(F.when(F.col("point") == "low", F.col(output))).alias("low"), F.max(F.when(F.col("point") == "high", F.col(output))).alias("high"))
    out = out.withColumn("swing", F.abs(F.col("high") - F.col("low")))
    return out.withColumn("share", F.col("swing") * F.col("swing") / F.sum(F.col("swing") * F.col("swing")).over(Window.partitionBy()))


def spider(spark: SparkSession, model: Model, output: str, names: list[str], shares: list[float]) -> DataFrame:
    """input, position, value."""
    rows = [(n, repr(float(s)), n, float(v)) for n in names for s, v in zip(shares, points(model, n, shares, spark), strict=True)]
    return _scenarios(spark, model, rows).select("input", F.col("point").cast("double").alias("position"), F.col(output).alias("value"))


def two_way(spark: SparkSession, model: Model, output: str, a: str, values_a: list[float], b: str, values_b: list[float]) -> DataFrame:
    """Values of the output over the grid of two inputs."""
    grid = spark.createDataFrame([(float(x), float(y)) for x in values_a for y in values_b], f"{a} double, {b} double")
    return model.evaluate(grid).select(a, b, F.col(output).alias("value"))


def variables_of(names: list[str], groups: list[list[str]] | None = None) -> dict[str, list[str]]:
    """Inputs folded into variables: those of a group move together, where the first of them stands; an input of several groups is of the first. Names are joined by +."""
    group = {}
    for g in groups or []:
        for n in g:
            if n in names:
                group.setdefault(n, id(g))
    out: dict[object, list[str]] = {}
    for n in names:
        out.setdefault(group.get(n, n), []).append(n)
    return {"+".join(v): v for v in out.values()}


def moved_rows(base: DataFrame, model: Model, names: list[str], shares: list[float], groups: list[list[str]] | None = None) -> DataFrame:
    """base and the model's cells, with input and position: each row's own inputs, each moved by itself, or with its group, by every share of its base value.

    An input that base lacks is the model's.
    """
    variables = variables_of(names, groups)
    own = base.withColumns({n: F.lit(float(v)) for n, v in model.inputs.items() if n not in base.columns})
    moves = F.explode(F.array(*[F.struct(F.lit(n).alias("input"), F.lit(float(s)).alias("position")) for n in variables for s in shares]))
    rows = own.withColumn("__m", moves).select("*", "__m.*").drop("__m")
    return model.evaluate(rows.withColumns({n: F.when(F.col("input") == v, F.col(n) * (1 + F.col("position"))).otherwise(F.col(n)) for v, inputs in variables.items() for n in inputs}))


def tornado_rows(base: DataFrame, model: Model, output: str, names: list[str], key: str, by: float = 0.1, groups: list[list[str]] | None = None) -> DataFrame:
    """key, input, low, high, swing, share of squared swings: the tornado of every row around its own base values, without a shuffle but that by key."""
    done = moved_rows(base, model, names, [-by, by], groups)
    out = done.groupBy(key, "input").agg(*[F.max(F.when(F.col("position") == p, F.col(output))).alias(n) for n, p in (("low", -by), ("high", by))])
    swing = F.col("high") - F.col("low")
    total = F.sum(swing * swing).over(Window.partitionBy(key))  # a row for each input
    return out.withColumn("swing", F.abs(swing)).withColumn("share", F.when(total > 0, swing * swing / total))


def two_way_rows(base: DataFrame, model: Model, a: str, values_a: list[float], b: str, values_b: list[float]) -> DataFrame:
    """base and the model's cells, for every row over the grid of two inputs."""
    own = base.drop(a, b).withColumn("__g", F.explode(F.array(*[F.struct(F.lit(float(x)).alias(a), F.lit(float(y)).alias(b)) for x in values_a for y in values_b])))
    return model.evaluate(own.select("*", "__g.*").drop("__g"))


def optimise_grid(spark: SparkSession, model: Model, samples: DataFrame, output: str, decision: str, candidates: list[float]) -> DataFrame:
    """candidate, mean and fifth percentile of the output: every candidate sees the same trials."""
    grid = F.explode(F.array(*[F.lit(float(c)) for c in candidates]))
    done = model.evaluate(samples.withColumn(decision, grid))
    means = done.groupBy(decision).agg(F.avg(output).alias("mean"))
    low = percentiles(done.select(decision, output), output, (0.05,), [decision])
    return means.join(low, decision).select(decision, "mean", F.col("p")[0].alias("p05"))  # a row for each candidate


def frontier(candidates: DataFrame, value: str, risk: str) -> DataFrame:
    """The candidates that no other beats in value at the same or less risk. Candidates are a report's worth."""
    better = Window.orderBy(F.col(risk), F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    return candidates.withColumn("__best", F.max(value).over(better)).filter(F.col("__best").isNull() | (F.col(value) > F.col("__best"))).drop("__best")
