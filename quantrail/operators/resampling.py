"""Bootstrap: replicates are groups of hashed draws."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import uniform
from ..sources.folders import cut
from .joins import join_groups, join_hot
from .ranking import percentiles


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with i, the place from 0 in the order of key: the place in a range of keys plus the rows of earlier ranges."""
    dealt = rows.repartitionByRange(key).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(key).withColumn("__row", F.monotonically_increasing_id())
    dealt = cut(dealt)  # ranges are sampled anew in each job
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = parts.select("__part", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(before), "__part").withColumn("i", F.col("__row") - F.col("__first") + F.col("__before")).drop("__part", "__row", "__first", "__before")


#: Draws that a worker sorts at a time.
PACK = 2**20
#: Rows of a stretch: 2 ** STRETCH.
STRETCH = 16


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Draws (replicate, i) as rows (stretch, side 1, replicate, null, gaps): the sorted places of a replicate's draws in a stretch as differences, in one byte each or two."""

    def rows_of(replicate: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        keys = np.sort(replicate.astype(np.int64) << 40 | i)
        group, place = keys >> STRETCH, keys & (2**STRETCH - 1)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        gaps = np.diff(place, prepend=0)
        gaps[first] = place[first]
        ends = [*first[1:].tolist(), len(keys)]
        wide = np.maximum.reduceat(gaps, first) > 255
        small, large = gaps.astype(np.uint8), gaps.astype(np.uint16)
        drawn = [(b"2" + large[k:e].tobytes()) if w else (b"1" + small[k:e].tobytes()) for k, e, w in zip(first.tolist(), ends, wide.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(group[first] & (2 ** (40 - STRETCH) - 1)), pa.array(np.ones(len(first), np.int32)), pa.array(group[first] >> (40 - STRETCH)), pa.array(drawn, pa.binary())], ["stretch", "side", "at", "drawn"])

    held, size = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= PACK:
            yield rows_of(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield rows_of(*map(np.concatenate, zip(*held, strict=True)))


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (replicate, x) of each stretch's values and the draws that follow them."""
    at, met, x = None, [], None
    made, size = [], 0
    for batch in batches:
        stretch, side = (batch.column(c).to_numpy() for c in ("stretch", "side"))
        changes = np.flatnonzero((stretch[1:] != stretch[:-1]) | (side[1:] != side[:-1])) + 1
        for low, high in pairwise([0, *changes.tolist(), batch.num_rows]):
            if low == high:
                continue
            if stretch[low] != at:
                at, met, x = stretch[low], [], None
            if side[low] == 0:
                met.append(batch.column("x").slice(low, high - low))
                continue
            if x is None:
                x = pa.concat_arrays(met)
            for replicate, gaps in zip(batch.column("at").slice(low, high - low).to_pylist(), batch.column("drawn").slice(low, high - low), strict=True):
                gaps = gaps.as_buffer()
                places = np.cumsum(np.frombuffer(gaps, np.uint8 if gaps[0:1].to_pybytes() == b"1" else np.uint16, offset=1), dtype=np.int64)
                made.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(places), replicate, np.int32)), x.take(pa.array(places))], ["replicate", "x"]))
                size += len(places)
                if size >= 2**STRETCH:
                    yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                    made, size = [], 0
    yield from made


def bootstrap(df: DataFrame, value: str, key: str, statistic: Column, replicates: int = 200, seed: int = 1) -> DataFrame:
    """replicate, estimate: resamples of the full size with replacement. statistic aggregates the column x.

    Rows are numbered by ranges of the key, so no task holds the table. Draws are sorted where they are made, a bounded number at a time, and
    go to the stretches of rows that they hit as differences of places: about a byte for each of replicates times the rows, where
    poisson_weights shuffles none. Drawn values are aggregated where their stretch is.
    """
    rows = numbered(df.select(F.col(value).alias("x"), F.col(key).alias("k")).filter("x IS NOT NULL"), "k")
    n = rows.count()
    spark = df.sparkSession
    draws = spark.range(replicates * n).select(F.floor(F.col("id") / n).cast("int").alias("replicate"), F.floor(uniform(seed, "boot", "id") * n).cast("long").alias("i"))
    kind = rows.schema["x"].dataType.simpleString()
    packed = draws.mapInArrow(_packed, "stretch long, side int, at long, drawn binary").withColumn("x", F.lit(None).cast(kind))
    values = rows.select(F.shiftright("i", STRETCH).alias("stretch"), F.lit(0).alias("side"), F.col("i").alias("at"), F.lit(None).cast("binary").alias("drawn"), "x")
    dealt = values.union(packed).repartition("stretch").sortWithinPartitions("stretch", "side", "at")
    return dealt.mapInArrow(_drawn, f"replicate int, x {kind}").groupBy("replicate").agg(statistic.alias("estimate"))


def poisson_weights(df: DataFrame, key: str, replicates: int, seed: int = 1) -> DataFrame:
    """df with replicate and weight, a Poisson(1) count from a hash: the bootstrap of large tables, summed before any shuffle."""
    out = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    hashed = uniform(seed, F.concat(F.lit("pois"), F.col("replicate").cast("string")), F.col(key))
    out, u = out.withColumn("__u", F.explode(F.array(hashed))), F.col("__u")  # else the weight's every step and the filter make the hash again
    share, total, steps = 0.36787944117144233, 0.0, []
    while share > 1e-17:  # u has 52 bits: no draw lies beyond
        total += share
        steps.append(total)
        share /= len(steps)
    weight = F.lit(len(steps))
    for k in range(len(steps) - 1, -1, -1):
        weight = F.when(u <= steps[k], k).otherwise(weight)
    return out.filter(u > steps[0]).withColumn("weight", weight).drop("__u")


def interval(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """estimate (mean of the replicates), low, high by percentiles."""
    tail = (1 - level) / 2
    return replicates.agg(F.avg("estimate").alias("estimate"), F.percentile("estimate", F.array(F.lit(tail), F.lit(1 - tail))).alias("p")).select("estimate", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def _weighted_quantile(x: np.ndarray, w: np.ndarray, p: float) -> float:
    """PERCENTILE.INC of sorted values of which each stands for so many."""
    upto = np.cumsum(w)
    h = (upto[-1] - 1) * p
    low, high = (x[np.searchsorted(upto, np.floor(h) + k, side="right").clip(max=len(x) - 1)] for k in (0, 1))
    return float(low + (high - low) * (h - np.floor(h)))


def _moment(x: np.ndarray, w: np.ndarray, k: int) -> tuple[float, float, float, float]:
    """n, mean, sd of the sample and the k-th power sum of standardised values."""
    n = float(w.sum())
    mean = float(w @ x / n)
    sd = float(np.sqrt(w @ (x - mean) ** 2 / (n - 1))) if n > 1 else 0.0
    return n, mean, sd, float(w @ ((x - mean) / sd) ** k) if sd > 0 else float("nan")


def _skewness(x: np.ndarray, w: np.ndarray) -> float:
    n, _, _, s = _moment(x, w, 3)
    return n / ((n - 1) * (n - 2)) * s if n > 2 else float("nan")


def _kurtosis(x: np.ndarray, w: np.ndarray) -> float:
    n, _, _, s = _moment(x, w, 4)
    return n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * s - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)) if n > 3 else float("nan")


#: Statistics by name: functions of sorted values and of how many rows each stands for.
STATISTICS: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {
    "mean": lambda x, w: float(w @ x / w.sum()),
    "median": lambda x, w: _weighted_quantile(x, w, 0.5),
    "stdDev": lambda x, w: _moment(x, w, 2)[2],
    "cv": lambda x, w: _moment(x, w, 2)[2] / abs(m) if (m := _moment(x, w, 2)[1]) else float("nan"),
    "p5": lambda x, w: _weighted_quantile(x, w, 0.05),
    "p10": lambda x, w: _weighted_quantile(x, w, 0.1),
    "p90": lambda x, w: _weighted_quantile(x, w, 0.9),
    "p95": lambda x, w: _weighted_quantile(x, w, 0.95),
    "skewness": _skewness,
    "kurtosis": _kurtosis,
}
#: Those of them that are order statistics.
SHARES = {"median": 0.5, "p5": 0.05, "p10": 0.1, "p90": 0.9, "p95": 0.95}


def _whole(rows: DataFrame, value: str, statistic: str, by: list[str]) -> DataFrame:
    """by, __whole: a statistic of STATISTICS over all rows of a group, by aggregates and selection."""
    if statistic in SHARES:
        return percentiles(rows, value, [SHARES[statistic]], by).select(*by, F.col("p")[0].alias("__whole"))
    n, mean, sd = F.count(value).cast("double"), F.avg(value), F.stddev_samp(value)
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(value))
    heavy = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))
    of = {"mean": mean, "stdDev": F.coalesce(sd, F.lit(0.0)), "cv": F.when(mean != 0, F.coalesce(sd, F.lit(0.0)) / F.abs(mean)), "skewness": skew, "kurtosis": heavy}
    return rows.groupBy(*by).agg(of[statistic].alias("__whole"))


def little_bootstraps(df: DataFrame, value: str, key: str, statistic: str | Callable[[np.ndarray, np.ndarray], float], by: list[str] | None = None, replicates: int = 100, subsets: int = 10, power: float = 0.6, level: float = 0.95, seed: int = 1) -> DataFrame:
    """by, estimate, low, high: percentile intervals by the bag of little bootstraps (Kleiner et al., 2014).

    From each group's n rows, hashes of the key draw `subsets` disjoint samples of about n ** power rows each. Within one, a replicate is a
    draw of n rows with replacement, held as how often each row was drawn. A sample tells how far replicates lie from its own statistic; these
    distances are averaged and put around the statistic of all rows, for the samples' own ones are known no better than their few rows allow.
    So about subsets * n ** power rows are shuffled, in place of replicates * n, and a worker holds n ** power of them. A group of few rows is one subset of all of them.
    statistic: a name of STATISTICS, or a function of sorted values and counts, which Spark can't evaluate over all rows: it is averaged over disjoint
    samples that hold every row between them, so these are shuffled once. Rows without a value are left out; a null group is a group.
    """
    by = by or []
    of = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    rows = df.select(*by, F.col(value).cast("double").alias("__x"), uniform(seed, "little", F.col(key)).alias("__u")).filter("__x IS NOT NULL AND NOT isnan(__x)")
    sizes = cut(rows.groupBy(*by).agg(F.count("*").alias("__n")))
    n = F.col("__n").cast("double")
    samples = F.floor(n / F.greatest(F.pow(n, F.lit(power)), F.lit(50.0)))  # that hold all rows
    picked = join_hot(rows, sizes.withColumn("__rows", F.col("__n")), by, "__rows", nulls=True) if by else join_groups(rows, sizes, [])
    picked = picked.withColumn("__s", F.when(samples <= subsets, 0).otherwise(F.floor(F.col("__u") * samples)).cast("int"))
    if isinstance(statistic, str):
        picked = picked.filter(F.col("__s") < subsets)
    tail = (1 - level) / 2

    def distances_of(table: pa.Table) -> pa.Table:
        x = np.sort(table.column("__x").to_numpy())
        size, subset = table.column("__n")[0].as_py(), table.column("__s")[0].as_py()
        rng = np.random.default_rng([seed, subset, size])
        own = of(x, np.ones(len(x), dtype=np.int64))
        found = np.array([of(x, rng.multinomial(size, np.full(len(x), 1 / len(x)))) for _ in range(replicates)] if subset < subsets else []) - own
        low, high = np.nanpercentile(found, [100 * tail, 100 * (1 - tail)]) if np.isfinite(found).any() else (np.nan, np.nan)
        mean = float(np.nanmean(found)) if np.isfinite(found).any() else np.nan
        keys = [table.column(b)[:1] for b in by]
        return pa.table([*keys, *[pa.array([float(v)], pa.float64(), from_pandas=True) for v in (own, mean, low, high)]], names=[*by, "__own", "estimate", "low", "high"])

    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in (df.select(*by).schema if by else [])], "__own double, estimate double, low double, high double"])
    each = picked.select(*by, "__x", "__n", "__s").groupBy(*by, "__s").applyInArrow(distances_of, kinds)
    found = each.groupBy(*by).agg(F.avg("__own").alias("__whole"), *[F.avg(c).alias(c) for c in ("estimate", "low", "high")])
    if isinstance(statistic, str):
        found = join_groups(found.drop("__whole"), _whole(rows, "__x", statistic, by), by)
    return found.select(*by, *[(F.col("__whole") + F.col(c)).alias(c) for c in ("estimate", "low", "high")]).filter("estimate IS NOT NULL")
