"""Lookups and conditional totals of a sheet as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_exact(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, order: str, name: str) -> DataFrame:
    """df with the value of the first table row of an equal key, in the given order; NULL where there is none.

    The first rows are found by one aggregation, so a frequent key of the table costs no window; Spark picks the join.
    """
    first = table.filter(F.col(table_key).isNotNull()).groupBy(F.col(table_key).alias("__k")).agg(F.min_by(value, order).alias(name))
    return df.join(first, F.col(key) == F.col("__k"), "left").drop("__k")


def lookup_below(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, name: str, parts: int = 64) -> DataFrame:
    """df with the value of the greatest table key of at most the row's key (a sorted lookup, or as-of join).

    The distinct keys of both sides are merged in buckets between quantiles of the table's keys: the last value seen goes
    forward within a bucket, and from bucket to bucket through one row for each. Rows meet their key's value by an equal join,
    so a frequent key is one row of the merge. Table keys are expected to be distinct; the greatest value of equal ones wins.
    """
    right = table.filter(F.col(table_key).isNotNull()).groupBy(F.col(table_key).cast("double").alias("__key")).agg(F.max(F.struct(F.col(value).alias("v"))).alias("__seen"))
    bounds = right.agg(F.percentile_approx("__key", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 20 * parts)).first()[0] or []
    left = df.select(F.col(key).cast("double").alias("__key")).filter("__key IS NOT NULL").distinct()
    both = left.join(right, "__key", "full").withColumn("__part", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= F.col("__key"))))
    upto = Window.partitionBy("__part").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__last", F.last("__seen", ignorenulls=True).over(upto))
    ends = both.groupBy("__part").agg(F.max(F.when(F.col("__seen").isNotNull(), F.struct("__key", "__seen")))["__seen"].alias("__end"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    carried = ends.select("__part", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    found = filled.join(F.broadcast(carried), "__part").select("__key", F.coalesce("__last", "__before")["v"].alias(name))
    return df.join(found, F.col(key).cast("double") == F.col("__key"), "left").drop("__key")


def conditional_totals(df: DataFrame, value: str, conditions: dict[str, Column]) -> DataFrame:
    """name, total, n, mean, least, most of the rows that meet each condition: SUMIFS and its kin in one pass."""
    x = F.col(value)
    aggs = []
    for i, c in enumerate(conditions.values()):
        y = F.when(c, x)
        aggs.append(F.struct(F.lit([*conditions][i]).alias("name"), F.coalesce(F.sum(y), F.lit(0.0)).alias("total"), F.count(y).alias("n"), F.avg(y).alias("mean"), F.min(y).alias("least"), F.max(y).alias("most")).alias(f"s{i}"))
    return df.agg(*aggs).select(F.explode(F.array(*[f"s{i}" for i in range(len(aggs))])).alias("s")).select("s.*")
