"""Spreadsheet functions of texts as Column expressions. NULL is the error value; positions count from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Whole = Column | int


def _i(x: Whole) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("int")


def left(text: Column, count: Whole = 1) -> Column:
    return F.when(_i(count) >= 0, F.substring(text, F.lit(1), _i(count)))


def right(text: Column, count: Whole = 1) -> Column:
    n = F.least(_i(count), F.length(text))
    return F.when(_i(count) >= 0, F.substring(text, F.length(text) - n + 1, n))


def middle(text: Column, start: Whole, count: Whole) -> Column:
    return F.when((_i(start) >= 1) & (_i(count) >= 0), F.substring(text, _i(start), _i(count)))


def proper(text: Column) -> Column:
    """A letter is upper case if no letter is before it."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("letter"))

    def step(s: Column, c: Column) -> Column:
        return F.struct(F.concat(s["out"], F.when(s["letter"], F.lower(c)).otherwise(F.upper(c))).alias("out"), (F.lower(c) != F.upper(c)).alias("letter"))

    return F.aggregate(F.split(text, ""), start, step, lambda s: s["out"])


def trim(text: Column) -> Column:
    """No spaces at the ends, one between words."""
    return F.trim(F.regexp_replace(text, " +", " "))


def substitute(text: Column, old: str, new: str, instance: int | None = None) -> Column:
    """Every occurrence of a text, or the n-th."""
    if not old:
        return text
    if instance is None:
        return F.replace(text, F.lit(old), F.lit(new))
    head = F.substring_index(text, old, instance)
    return F.when(F.length(head) < F.length(text), F.concat(head, F.lit(new), F.substring(text, F.length(head) + len(old) + 1, F.length(text)))).otherwise(text)


def find(part: Column | str, text: Column, start: Whole = 1) -> Column:
    """NULL where the part is not there."""
    at = F.call_function("locate", F.lit(part) if isinstance(part, str) else part, text, _i(start))
    return F.when(at > 0, at)


def search(part: Column | str, text: Column, start: Whole = 1) -> Column:
    return find(F.lower(F.lit(part) if isinstance(part, str) else part), F.lower(text), start)


def repeated(text: Column, count: Whole) -> Column:
    return F.when(_i(count) >= 0, F.repeat(text, _i(count)))


def exact(a: Column, b: Column) -> Column:
    return a == b


def joined(separator: str, skip_empty: bool, *texts: Column) -> Column:
    items = F.array(*[F.coalesce(t.cast("string"), F.lit("")) for t in texts])
    return F.array_join(F.filter(items, lambda x: x != "") if skip_empty else items, separator)


def value(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def formatted(number: Column, places: int = 0, grouped: bool = False, percent: bool = False) -> Column:
    """A number as text, rounded half away from zero on its decimal value."""
    x = (number * (100 if percent else 1)).cast("decimal(38,18)")
    x = F.round(x, places)
    text = F.format_number(x, places) if grouped else F.format_string(f"%.{places}f", x)
    return F.concat(text, F.lit("%")) if percent else text
