"""Subtotals: totals of nested groups as rows among the others, and totals that pass over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The functions of a subtotal by number; from 101 on hidden rows are left out too.
FUNCTIONS = {1: F.avg, 2: F.count, 3: F.count, 4: F.max, 5: F.min, 6: F.product, 7: F.stddev_samp, 8: F.stddev_pop, 9: F.sum, 10: F.var_samp, 11: F.var_pop}


def subtotal(function: int, value: Column, is_subtotal: Column, hidden: Column | None = None) -> Column:
    """An aggregate by number of the rows that are no subtotals themselves, so nested totals are not counted twice."""
    out = is_subtotal if function < 100 or hidden is None else is_subtotal | hidden
    return FUNCTIONS[function % 100](F.when(~out, value))


def with_subtotals(df: DataFrame, levels: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """levels, level and the aggregates: a row for each group of all levels, for each group of fewer of them from the left, and one for all.

    level is how many levels a row is grouped by; a level that is not is null, as is a null group, which level tells apart. All levels are one
    aggregation of grouping sets.
    """
    masks = F.grouping_id()
    level = F.lit(len(levels)) - F.length(F.regexp_replace(F.bin(masks), "0", ""))
    return df.rollup(*levels).agg(level.cast("int").alias("level"), *[c.alias(n) for n, c in aggregates.items()])


def detail_and_subtotals(df: DataFrame, levels: list[str], values: list[str]) -> DataFrame:
    """The rows of df (level: null) and, as further rows, the sums of their values by every level; is_subtotal tells which."""
    own = df.select(*levels, *values, F.lit(None).cast("int").alias("level"), F.lit(False).alias("is_subtotal"))
    return own.unionByName(with_subtotals(df, levels, {v: F.sum(v) for v in values}).withColumn("is_subtotal", F.lit(True)))
