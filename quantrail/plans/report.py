"""The report of a simulation as cells of sheets, ready for a workbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import statistics as st
from ..operators.runner import Run
from .models import Model

#: The rows of the report's percentiles, and of its extract of trials.
PERCENTILES = tuple(p / 100 for p in range(5, 100, 5))
EXTRACT = 5000
STATISTICS = ("n", "errors", "mean", "p50", "mode", "sd", "var", "cv", "min", "max", "range", "skew", "kurt", "sem", "low", "high")


def _long(rows: DataFrame, names: list[str], label: str) -> DataFrame:
    """label and x: a row for each named column of each row."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias(label), F.col(n).cast("double").alias("x")) for n in names])).alias("v")).select("v.*")


def _cells(sheet: str, rows: DataFrame, row: Column, values: dict[int, Column]) -> DataFrame:
    """Cells of a sheet: for each row of rows, a value in each numbered column, as a number or a text."""
    kinds = dict(rows.select(*[c.alias(str(k)) for k, c in values.items()]).dtypes)
    cell = lambda k, c: F.struct(F.lit(k).alias("col"), (F.lit(None).cast("double") if kinds[str(k)] == "string" else c.cast("double")).alias("number"), (c if kinds[str(k)] == "string" else F.lit(None).cast("string")).alias("text"))
    long = rows.select(row.cast("int").alias("row"), F.explode(F.array(*[cell(k, c) for k, c in values.items()])).alias("c"))
    return long.select(F.lit(sheet).alias("sheet"), "row", "c.*").filter("number IS NOT NULL OR text IS NOT NULL")


def report(model: Model, run: Run, extract: int = EXTRACT) -> DataFrame:
    """sheet, row, col, number, text: summary, statistics of the forecasts with percentiles and the chance of a loss, samples of the assumptions and their
    correlations, sensitivities, and an extract of the first trials.

    Every forecast and assumption is described in one pass over all trials; what is listed grows with the model, not with the trials.
    """
    spark, rows = run.rows.sparkSession, run.rows
    names = [*model.assumptions]
    order = lambda c, of: F.coalesce(*[F.when(c == n, k) for k, n in enumerate(of)])
    forecasts = _long(rows, model.outputs, "name")
    d = st.describe(forecasts, "x", ["name"], PERCENTILES)
    more = st.mean_interval(forecasts, "x", ["name"]).select("name", "low", "high").join(st.mode(forecasts, "x", ["name"]).select("name", "mode"), "name", "left")
    loss = forecasts.groupBy("name").agg(F.avg(F.when(F.col("x") < 0, 1.0).when(F.col("x") >= 0, 0.0)).alias("below"))
    d = d.join(more, "name").join(loss, "name").withColumn("sem", F.col("sd") / F.sqrt(F.col("n").cast("double")))  # a row for each forecast
    labels = [*STATISTICS, *[f"P{round(100 * p)}" for p in PERCENTILES], "P(<0)", "P(>=0)"]
    values = [*STATISTICS, *[f"p{round(100 * p):02d}" for p in PERCENTILES]]
    long = d.select("name", F.posexplode(F.array(*[F.col(c).cast("double") for c in values], F.col("below"), 1 - F.col("below"))).alias("k", "x"))
    heads = spark.createDataFrame([(k, n) for k, n in enumerate(labels)], "k int, label string")
    summary = [("trials", float(run.trials)), ("stopped early", float(run.stopped)), ("assumptions", float(len(names))), ("forecasts", float(len(model.outputs)))]
    head = spark.createDataFrame([(k, n, v) for k, (n, v) in enumerate(summary, 1)], "k int, name string, x double")
    parts = [
        _cells("Summary", head, F.col("k"), {1: F.col("name"), 2: F.col("x")}),
        _cells("Summary", d, F.lit(len(summary) + 2) + order(F.col("name"), model.outputs), {1: F.col("name"), 2: F.col("mean"), 3: F.col("sd"), 4: F.col("p05"), 5: F.col("p50"), 6: F.col("p95")}),
        _cells("Forecasts", heads, F.col("k") + 2, {1: F.col("label")}),
        _cells("Forecasts", spark.createDataFrame([(k, n) for k, n in enumerate(model.outputs)], "k int, name string"), F.lit(1), {2: F.col("name")}).withColumn("col", order(F.col("text"), model.outputs) + 2),
        long.select(F.lit("Forecasts").alias("sheet"), (F.col("k") + 2).alias("row"), (order(F.col("name"), model.outputs) + 2).alias("col"), F.col("x").alias("number"), F.lit(None).cast("string").alias("text")).filter("number IS NOT NULL"),
    ]
    if names:
        a = st.describe(_long(rows, names, "name"), "x", ["name"], (0.5,))
        parts.append(_cells("Assumptions", a, order(F.col("name"), names) + 1, {1: F.col("name"), 2: F.col("mean"), 3: F.col("sd"), 4: F.col("min"), 5: F.col("max")}))
        if model.correlations:
            c = spark.createDataFrame([(k, x, y, float(r)) for k, (x, y, r) in enumerate(model.correlations)], "k int, a string, b string, rho double")
            parts.append(_cells("Assumptions", c, F.col("k") + len(names) + 3, {1: F.col("a"), 2: F.col("b"), 3: F.col("rho")}))
        for i, o in enumerate(model.outputs):
            s = st.sensitivity(rows, names, o).withColumn("forecast", F.lit(o))
            parts.append(_cells("Sensitivity", s, F.lit(i * (len(names) + 1) + 1) + order(F.col("input"), names), {1: F.col("forecast"), 2: F.col("input"), 3: F.col("rho"), 4: F.col("share")}))
    shown = rows.filter(F.col("trial") < extract)
    parts.append(_cells("Data", shown, F.col("trial") + 1, {k: F.col(c) for k, c in enumerate(["trial", *names, *model.outputs], 1)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return out
