"""A join that no frequent key stops."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No more keys than this can each have over 1 / HOT_KEYS of all rows.
HOT_KEYS = 1000


def same(left: list[str], right: list[str], nulls: bool = True) -> Column:
    """That columns are equal; with nulls, a null equals a null."""
    pairs = [F.col(a).eqNullSafe(F.col(b)) if nulls else F.col(a) == F.col(b) for a, b in zip(left, right, strict=True)]
    return functools.reduce(lambda x, y: x & y, pairs)


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left joined to right on columns that may be null, where null is a value like others; without columns, right is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    keys = [f"__key_{i}" for i in range(len(by))]
    return left.join(right.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[c for c in right.columns if c not in by]), same(by, keys), how).drop(*keys)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: str, nulls: bool = False, total: int | None = None) -> DataFrame:
    """left joined to right on columns; right has one row for each key and, in `rows`, at least how many left rows have it, in all of the order of left.

    Keys with more than a HOT_KEYS-th of those rows (total, counted unless given), at most HOT_KEYS of them whatever the input, are broadcast;
    the other rows are shuffled. So no frequent key meets in one task. Both sides are read twice: they should be cut, or cheap. Rows whose key has a null
    are left out, unless nulls are values like others.
    """
    if total is None:
        total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * HOT_KEYS > F.lit(total)
    big, rest = F.broadcast(right.filter(hot).drop(rows)), right.filter(~hot).drop(rows)
    if not nulls:
        return left.join(big, on).unionByName(left.join(big.select(*on), on, "left_anti").join(rest, on))
    keys = [f"__hot_{c}" for c in on]
    other = left.join(big.select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]), same(on, keys), "left_anti")
    return join_groups(left, big, on).unionByName(join_groups(other, rest, on))
