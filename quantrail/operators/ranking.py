"""Order statistics without one global sort: values are dealt into buckets by approximate quantiles, then summed in order.

Bounds are computed once and stand in the plan as values, so every evaluation deals the rows alike. Equal values are counted
before they are dealt, so a frequent value is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import cut
from .joins import join_groups, join_hot

#: Buckets of a group's values.
PARTS = 64


def cumulative(df: DataFrame, value: str, by: list[str] | None = None, parts: int = PARTS, weight: str | None = None) -> DataFrame:
    """by, value, count, upto, n: how many rows have each distinct value, how many have at most it, and how many there are. Nulls are left out.

    With a weight, each row stands for so many. A null group is a group.
    """
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("count"))
    bounds = counts.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 20 * parts).alias("__b"))
    placed = join_groups(counts, bounds, by)
    placed = placed.withColumn("__bucket", passed(F.col("__b"), F.col(value), parts - 1, False)).drop("__b")
    sums = placed.groupBy(*by, "__bucket").agg(F.sum("count").alias("__n"))
    group = Window.partitionBy(*by)  # at most `parts` rows of a group
    earlier = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(group).alias("n"))
    within = Window.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("__sum", F.sum("count").over(within)).transform(join_groups, before, [*by, "__bucket"])
    return out.select(*by, value, "count", (F.col("__sum") + F.col("__before")).alias("upto"), "n")


#: Rank error of the sketches that bracket an order statistic, as one in so many rows, and the rows of a group up to which all values are sorted.
ACCURACY = 2000


def passed(bounds: Column, x: Column, n: int, equal: bool) -> Column:
    """How many of n rising bounds x has passed: those below it, and those equal to it if they count. By halving."""
    steps = [2**k for k in range(max(n, 1).bit_length() - 1, -1, -1)]

    def over(at: Column, step: Column) -> Column:
        bound = F.element_at(bounds, F.least(at + step, F.lit(n)))
        return F.when((at + step <= n) & ((bound <= x) if equal else (bound < x)), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), over)


def selected(df: DataFrame, value: str, shares: list[float], ranks: Callable[[Column], Column], by: list[str] | None = None) -> DataFrame:
    """by, n, j, x: of each group the value x of rank ranks(n)[j], from 0, for all j; found without sorting a group.

    shares are rising parts of the rows near which all the ranks lie, within a row or two. A sketch brackets each share; one pass counts the rows between
    the brackets and, value by value, those within, a few in a thousand for each share; only these are sorted. A null group is a group.
    """
    by, m = by or [], len(shares)
    accuracy = max(ACCURACY, 40 * m)
    small, slack = 8 * accuracy, 4 / accuracy
    rows = df.select(*by, F.col(value).cast("double").alias("__x")).filter("__x IS NOT NULL")
    wide = [min(1.0, max(0.0, p + d)) for d in (-slack, slack) for p in shares]
    found = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.percentile_approx("__x", F.array(*map(F.lit, wide)), accuracy).alias("__q"))
    every = F.col("__n") <= small
    sides = [F.when(every, F.array_repeat(F.lit(end), m)).otherwise(F.slice("__q", 1 + i * m, m)).alias(c) for i, (c, end) in enumerate((("__lo", float("-inf")), ("__hi", float("inf"))))]
    state = cut(found.select(*by, F.col("__n").alias("__rows"), *sides))
    joined = join_hot(rows, state, by, "__rows", nulls=True) if by else join_groups(rows, state.drop("__rows"), [])
    joined = joined.withColumns({"__in": passed(F.col("__lo"), F.col("__x"), m, True), "__out": passed(F.col("__hi"), F.col("__x"), m, False)})
    stretch = (F.col("__in") + F.col("__out")).alias("__s")  # rises with the value; within a bracket more have been entered than left
    counted = cut(joined.groupBy(*by, stretch, F.when(F.col("__in") > F.col("__out"), F.col("__x")).alias("__x")).agg(F.count("*").alias("__c")))
    group = Window.partitionBy(*by)  # at most 2 * m + 1 rows of a group
    earlier = group.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy(*by, "__s").agg(F.sum("__c").alias("__m"))
    before = sums.select(*by, "__s", F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__before"), F.sum("__m").over(group).alias("n"))
    upto = F.sum("__c").over(Window.partitionBy(*by, "__s").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    placed = join_groups(counted.withColumn("__u", upto), before, [*by, "__s"]).filter("__x IS NOT NULL")
    least, most = F.col("__u") + F.col("__before") - F.col("__c"), F.col("__u") + F.col("__before")
    mine = F.filter(F.transform(ranks(F.col("n")), lambda r, j: F.struct(r.alias("r"), j.alias("j"))), lambda x: (x["r"] >= least) & (x["r"] < most))
    return placed.select(*by, "n", F.col("__x").alias("x"), F.explode(mine).alias("__j")).select(*by, "n", F.col("__j.j").alias("j"), "x")


def percentiles(df: DataFrame, value: str, shares: list[float] | tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """by, p (an array, one entry for each share): exact and interpolated (PERCENTILE.INC). A null group is a group; one without values has no row."""
    order = sorted({min(1.0, max(0.0, float(p))) for p in shares})
    at = lambda n, p: F.floor((n - 1).cast("double") * p).cast("long")
    pairs = selected(df, value, order, lambda n: F.flatten(F.transform(F.lit(order), lambda p: F.array(at(n, p), at(n, p) + 1))), by)
    found = pairs.groupBy(*(by or []), "n").agg(F.map_from_entries(F.collect_list(F.struct("j", "x"))).alias("__v"))

    wanted = [min(1.0, max(0.0, float(p))) for p in shares]
    places = F.lit([order.index(p) for p in wanted])

    def between(p: Column, k: Column) -> Column:
        i, h = F.element_at(places, k + 1), (F.col("n") - 1).cast("double") * p
        low = F.coalesce(F.col("__v")[2 * i], F.raise_error(F.lit("a bracket missed its rank")).cast("double"))
        return low + (F.coalesce(F.col("__v")[2 * i + 1], low) - low) * (h - F.floor(h))

    return found.select(*(by or []), F.transform(F.lit(wanted), between).alias("p"))


def plot_points(df: DataFrame, value: str, most: int = 400) -> DataFrame:
    """i, p, x: order statistics x of every step-th rank i, the step the rows by `most` in whole numbers, with p = (i + 0.5) / rows; for P-P and Q-Q plots. Nulls are left out."""
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return df.sparkSession.createDataFrame([], "i long, p double, x double")
    step = max(1, n // most)
    ranks = [*range(0, n, step)]
    found = selected(df, value, [i / max(n - 1, 1) for i in ranks], lambda _: F.lit(ranks).cast("array<long>"))
    i = F.col("j").cast("long") * step
    return found.select(i.alias("i"), ((i + 0.5) / n).alias("p"), "x")


def average_rank() -> Column:
    """The rank of a value of cumulative(), shared by its ties."""
    return F.col("upto") - (F.col("count") - 1) / 2.0


def with_average_rank(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """df with ranks in which ties share their mean; rows without a value have none. A null group is a group."""
    by = by or []
    ranks = cut(cumulative(df, value, by).select(*by, value, average_rank().alias(name), "count"))
    rest = df.filter(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double"))
    return join_hot(df.filter(F.col(value).isNotNull()), ranks, [*by, value], "count", nulls=bool(by)).unionByName(rest)


def places(rows: DataFrame, value: Column, bucket: Column, by: list[str], key: str) -> DataFrame:
    """by, key, place: each row's place from 1 in the order of (value, key). bucket must rise with value and deal the rows evenly."""
    dealt = cut(rows.select(*by, key, value.alias("__v")).withColumn("__bucket", bucket))
    counts = dealt.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__bucket").orderBy("__v", key)
    out = dealt.withColumn("__k", F.row_number().over(within)).transform(join_groups, before, [*by, "__bucket"])
    return out.select(*by, key, (F.col("__k") + F.col("__before")).alias("place"))
