"""Runs of a model: in rounds that stop once a mean is precise, and by a black-box model of Python whose failures stay with their rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.models import Model
from ..sources.folders import delete, own_folder
from .sampling import uniforms

#: A run may stop at multiples of EVERY trials, from LEAST on.
EVERY, LEAST = 250, 500
#: Blocks of EVERY trials whose states are summed by one task; the sums of these groups are few.
GROUPED = 1024


@dataclass(frozen=True)
class Precision:
    """Stop when the half width of the mean's interval is at most relative times the absolute mean of an output."""

    output: str
    relative: float
    confidence: float = 0.95

    @property
    def z(self) -> float:
        level = self.confidence / 100 if self.confidence > 1 else self.confidence
        return NormalDist().inv_cdf((1 + level) / 2)


@dataclass(frozen=True)
class State:
    """What is kept of an output's finite values; states of disjoint trials are merged exactly as their union's."""

    count: int = 0
    mean: float = 0.0
    m2: float = 0.0
    errors: int = 0

    def merged(self, other: State) -> State:
        n = self.count + other.count
        if not n:
            return State(errors=self.errors + other.errors)
        d = other.mean - self.mean
        return State(n, self.mean + d * other.count / n, self.m2 + other.m2 + d * d * self.count * other.count / n, self.errors + other.errors)


@dataclass(frozen=True)
class Run:
    """rows: trial, inputs and cells of the trials that count. Outputs that are not finite are null there, and are errors."""

    rows: DataFrame
    trials: int
    stopped: bool
    aborted: bool
    states: dict[str, State] = field(default_factory=dict)
    rounds: int = 0


def finite(x: Column) -> Column:
    """x, or null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def state(rows: DataFrame, outputs: Sequence[str]) -> dict[str, State]:
    """The state of each output over rows whose outputs are finite or null."""
    aggs = [a for o in outputs for a in (F.count(o), F.avg(o), F.var_pop(o) * F.count(o), F.count("*") - F.count(o))]
    got = rows.agg(*aggs).first()
    return {o: State(got[4 * i], got[4 * i + 1] or 0.0, got[4 * i + 2] or 0.0, got[4 * i + 3]) for i, o in enumerate(outputs)}


def stop_trial(rows: DataFrame, goal: Precision, before: State = State(), total: int | None = None) -> int | None:
    """The first multiple of EVERY, from LEAST on and short of the total, at which the goal is met; None if there is none.

    before is the state of the trials in front of these rows. Blocks of EVERY trials are counted and summed about the state's mean (or
    the rows' own, without one), so that squares lose nothing; running sums are taken over groups of blocks first, then within each.
    """
    x = F.col(goal.output)
    centre = before.mean if before.count else (rows.agg(F.avg(x)).first()[0] or 0.0)
    d = x - F.lit(float(centre))
    shift = before.mean - centre
    blocks = rows.groupBy(F.expr(f"trial div {EVERY}").alias("b")).agg(F.count(x).alias("n"), F.coalesce(F.sum(d), F.lit(0.0)).alias("s"), F.coalesce(F.sum(d * d), F.lit(0.0)).alias("q"), F.max("trial").alias("last"))
    blocks = blocks.withColumn("g", F.expr(f"b div {GROUPED}"))
    sums = [F.sum(c).alias(f"_{c}") for c in "nsq"]
    earlier = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("g").agg(*sums)  # a row for each GROUPED * EVERY trials
    groups = groups.select("g", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in "nsq"])
    upto = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    given = {"n": before.count, "s": before.count * shift, "q": before.m2 + before.count * shift * shift}
    run = blocks.join(F.broadcast(groups), "g").select("last", *[(F.sum(c).over(upto) + F.col(f"_{c}") + F.lit(given[c])).alias(c) for c in "nsq"])
    done, n = F.col("last") + 1, F.col("n")
    mean = F.lit(float(centre)) + F.col("s") / n
    half = F.lit(goal.z) * F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / n) / (n - 1) / n)
    good = (done % EVERY == 0) & (done >= LEAST) & (n >= 2) & (half <= F.lit(goal.relative) * F.abs(mean))
    return run.filter(good if total is None else good & (done < total)).agg(F.min(done)).first()[0]


def run(
    spark: SparkSession,
    model: Model,
    trials: int,
    precision: Precision | None = None,
    seed: int = 12345,
    method: str = "mc",
    given: DataFrame | None = None,
    first: int = 5000,
    growth: float = 2.0,
    aborted: Callable[[], bool] = lambda: False,
    progress: Callable[[int, int], None] | None = None,
    evaluate: Callable[[DataFrame], DataFrame] | None = None,
) -> Run:
    """Runs a model's trials in rounds of growing size, each written to the shared folder, and stops after the round in which the goal is met.

    A trial's inputs depend on the seed and its number alone, so rounds draw what one run would. A round's trials past the stop are
    dropped with their errors. Between rounds aborted() may end the run, as may an error raised while it says so; what is whole by
    then is the result. given: one row of base values. evaluate: another model of the sampled rows, such as black_box makes.
    """
    names = [*model.assumptions]
    folder = f"{own_folder(spark)}/run-{uuid.uuid4().hex}"
    states = {o: State() for o in model.outputs}
    done, rounds, stop, size, gone, schema = 0, 0, None, max(first, LEAST), False, None
    while done < trials and stop is None:
        if gone := aborted():
            break
        end = trials if precision is None else min(trials, done + size)
        u = uniforms(spark, trials, [f"u_{n}" for n in names], seed, method, between=(done, end))
        rows = u.select("trial", *[f.sample(f"u_{n}").alias(n) for n, f in model.assumptions.items()])
        rows = rows if given is None else rows.crossJoin(F.broadcast(given))  # one row
        rows = (evaluate or model.evaluate)(rows)
        rows = rows.withColumns({o: finite(F.col(o).cast("double")) for o in model.outputs})
        try:
            rows.write.parquet(f"{folder}/{rounds}")
        except Exception:
            if not (gone := aborted()):
                raise
            delete(spark, f"{folder}/{rounds}")
            break
        schema = rows.schema
        written = spark.read.schema(schema).parquet(f"{folder}/{rounds}")
        if precision is not None:
            stop = stop_trial(written, precision, states[precision.output], trials)
        now = state(written if stop is None else written.filter(F.col("trial") < stop), model.outputs)
        states = {o: s.merged(now[o]) for o, s in states.items()}
        done, rounds, size = end if stop is None else stop, rounds + 1, int(size * growth)
        if progress:
            progress(done, trials)
    if schema is None:
        empty = spark.createDataFrame([], "trial long, " + ", ".join(f"{c} double" for c in [*names, *model.outputs]))
        return Run(empty, 0, False, gone, states, 0)
    rows = spark.read.schema(schema).parquet(*[f"{folder}/{k}" for k in range(rounds)])
    return Run(rows.filter(F.col("trial") < done), done, stop is not None, gone, states, rounds)


Batch = Callable[[pd.DataFrame], "pd.DataFrame | np.ndarray | Sequence"]


def isolated(model: Batch, inputs: pd.DataFrame, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    """(outputs, failed) of a batch. A batch that raises, or gives another number of rows, is halved down to the rows that do; these are NaN and failed.

    Outputs that a model leaves out, at the end of a row or of all rows, are NaN, as are those that aren't finite.
    """
    n = len(inputs)
    values, failed = np.full((n, outputs), np.nan), np.zeros(n, bool)
    parts = [(0, n)] if n else []
    while parts:
        a, b = parts.pop()
        try:
            got = model(inputs.iloc[a:b].reset_index(drop=True))
            rows = got.to_numpy() if isinstance(got, pd.DataFrame) else got
            if len(rows) != b - a:
                raise ValueError("a row for each input row is asked for")
            for i, row in enumerate(rows):
                own = np.asarray(row, float).ravel()[:outputs]
                values[a + i, : len(own)] = own
        except Exception:  # noqa: BLE001  whatever the model raises is its rows' failure
            values[a:b] = np.nan
            if b - a == 1:
                failed[a] = True
            else:
                parts += [(a, (a + b) // 2), ((a + b) // 2, b)]
    values[~np.isfinite(values)] = np.nan
    return values, failed


def black_box(df: DataFrame, model: Batch, inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """df with the outputs of a Python model of batches and `failed`, whether the row made it raise.

    The model gets a frame of the inputs and returns a row for each of its rows. A row costs log2(batch) more calls if it alone fails.
    Outputs are null where a row failed, is too short or is not finite; so a bad row costs no other one, and no task.
    """
    if clash := {*outputs, "failed"} & {*df.columns}:
        raise ValueError(f"these columns are there already: {sorted(clash)}")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = [*df.columns, *outputs, "failed"]

    def evaluated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, failed = isolated(model, batch.select(list(inputs)).to_pandas(), len(outputs))
            made = [pa.array(values[:, i], from_pandas=True) for i in range(len(outputs))]  # NaN becomes null
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array(failed)], names)

    return df.mapInArrow(evaluated, f"{kinds}, {', '.join(f'`{o}` double' for o in outputs)}, failed boolean")
