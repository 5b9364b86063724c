"""Spreadsheet functions of dates as Column expressions. Working days are Monday to Friday, counted in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Whole = Column | int


def _i(x: Whole) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("int")


def date_of(year: Whole, month: Whole, day: Whole) -> Column:
    """Months and days beyond their range go on into the next ones."""
    return F.date_add(F.add_months(F.make_date(_i(year), F.lit(1), F.lit(1)), _i(month) - 1), _i(day) - 1)


def months_away(date: Column, months: Whole) -> Column:
    return F.add_months(date, _i(months))


def end_of_month(date: Column, months: Whole = 0) -> Column:
    return F.last_day(F.add_months(date, _i(months)))


def days(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def difference(start: Column, end: Column, unit: str) -> Column:
    """Y, M, D: full years, months and days; YM, YD, MD: what is left of months or days. NULL if the end is before the start."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)
    years = F.floor(months / 12).cast("int")
    out = {
        "Y": years,
        "M": months,
        "D": F.datediff(end, start),
        "YM": months - 12 * years,
        "YD": F.datediff(end, F.add_months(start, 12 * years)),
        "MD": F.datediff(end, F.add_months(start, months)),
    }[unit.upper()]
    return F.when(end >= start, out)


def year_fraction(start: Column, end: Column, basis: int = 0) -> Column:
    """0: 30/360 of the United States, 2: actual/360, 3: actual/365, 4: 30/360 of Europe."""
    if basis in (2, 3):
        return F.abs(F.datediff(end, start)) / (360.0 if basis == 2 else 365.0)
    a, b = F.least(start, end), F.greatest(start, end)
    first = F.least(F.dayofmonth(a), F.lit(30))
    last = F.when((F.dayofmonth(b) == 31) & ((first == 30) if basis == 0 else F.lit(True)), 30).otherwise(F.dayofmonth(b))
    return (360 * (F.year(b) - F.year(a)) + 30 * (F.month(b) - F.month(a)) + last - first) / 360.0


def weekday(date: Column, kind: int = 1) -> Column:
    """1: Sunday is 1; 2: Monday is 1; 3: Monday is 0."""
    return {1: F.dayofweek(date), 2: F.weekday(date) + 1, 3: F.weekday(date)}[kind]


#: A Monday.
ORIGIN = "1970-01-05"


def _before(date: Column) -> Column:
    """Working days from the origin to the day before a date."""
    k = F.datediff(date, F.lit(ORIGIN).cast("date"))
    return 5 * F.floor(k / 7) + F.least(F.pmod(k, F.lit(7)), F.lit(5))


def working_days(start: Column, end: Column, holidays: Column | None = None) -> Column:
    """Both ends included, without the dates of an array of holidays; negative if the end is before the start."""
    a, b = F.least(start, end), F.greatest(start, end)
    count = _before(F.date_add(b, 1)) - _before(a)
    if holidays is not None:
        count = count - F.size(F.filter(F.array_distinct(holidays), lambda h: h.between(a, b) & (F.weekday(h) < 5)))
    return F.when(end >= start, count).otherwise(-count).cast("int")


def working_day(start: Column, away: Whole) -> Column:
    """The date that many working days away."""
    n = _i(away)
    number = F.when(n > 0, _before(F.date_add(start, 1)) + n).otherwise(_before(start) + n + 1) - 1
    date = F.date_add(F.lit(ORIGIN).cast("date"), (7 * F.floor(number / 5) + F.pmod(number, F.lit(5))).cast("int"))
    return F.when(n == 0, start.cast("date")).otherwise(date)
