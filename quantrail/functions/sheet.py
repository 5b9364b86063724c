"""Spreadsheet functions as Column expressions. NULL is the error value and spreads through every function.

Rounding is half away from zero on the binary value, INT drops the fraction, and MOD takes the sign of the dividend.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def round_half(x: Number, digits: int = 0) -> Column:
    x, scale = _c(x), 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def round_up(x: Number, digits: int = 0) -> Column:
    x, scale = _c(x), 10.0**digits
    return F.signum(x) * F.ceil(F.abs(x) * scale) / scale


def round_down(x: Number, digits: int = 0) -> Column:
    x, scale = _c(x), 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def whole(x: Number) -> Column:
    return round_down(x)


def mod(x: Number, by: Number) -> Column:
    return F.try_mod(_c(x), _c(by))


def divide(a: Number, b: Number) -> Column:
    return finite(F.try_divide(_c(a), _c(b)))


def square_root(x: Number) -> Column:
    return F.when(_c(x) >= 0, F.sqrt(_c(x)))


def log(x: Number, base: Number = 10) -> Column:
    x, base = _c(x), _c(base)
    return finite(F.when((x > 0) & (base > 0) & (base != 1), F.try_divide(F.ln(x), F.ln(base))))


def power(x: Number, y: Number) -> Column:
    x, y = _c(x), _c(y)
    return finite(F.when((x != 0) | (y > 0), F.pow(x, y)))


def _all_known(items: tuple[Column, ...]) -> Column:
    known = F.lit(True)
    for x in items:
        known = known & x.isNotNull()
    return known


def smallest(*items: Column) -> Column:
    """NULL if any item is; least() alone would skip it."""
    return F.when(_all_known(items), F.least(*items) if len(items) > 1 else items[0])


def largest(*items: Column) -> Column:
    return F.when(_all_known(items), F.greatest(*items) if len(items) > 1 else items[0])


def every(*items: Column) -> Column:
    """AND in which an error wins over FALSE."""
    out = F.lit(True)
    for x in items:
        out = out & x
    return F.when(_all_known(items), out)


def some(*items: Column) -> Column:
    """OR in which an error wins over TRUE."""
    out = F.lit(False)
    for x in items:
        out = out | x
    return F.when(_all_known(items), out)


def branch(condition: Column, then: Number, other: Number) -> Column:
    """IF: an error in the condition is an error."""
    return F.when(condition.isNotNull(), F.when(condition, _c(then)).otherwise(_c(other)))


def if_error(x: Column, other: Number) -> Column:
    return F.coalesce(x, _c(other))


def choose(position: Column, *items: Column) -> Column:
    return F.when(position.between(1, len(items)), F.element_at(F.array(*items), F.greatest(F.lit(1), F.least(F.lit(len(items)), position.cast("int")))))


def count_numbers(*items: Column) -> Column:
    return sum((F.when(x.isNotNull(), 1).otherwise(0) for x in items[1:]), F.when(items[0].isNotNull(), 1).otherwise(0))


def product(items: Column) -> Column:
    return F.aggregate(items, F.lit(1.0), lambda a, x: a * x)


def sum_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


# Functions of a range, given as an array of numbers; its NULLs are empty cells.


def _known(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def total(items: Column) -> Column:
    return F.aggregate(_known(items), F.lit(0.0), lambda a, x: a + x)


def sum_squares(items: Column) -> Column:
    return total(F.transform(items, lambda x: x * x))


def average(items: Column) -> Column:
    return F.try_divide(total(items), F.size(_known(items)).cast("double"))


def squared_deviations(items: Column) -> Column:
    mean = average(items)
    return total(F.transform(items, lambda x: (x - mean) * (x - mean)))


def variance(items: Column, sample: bool = True) -> Column:
    n = F.size(_known(items))
    return F.when(n > (1 if sample else 0), squared_deviations(items) / (n - (1 if sample else 0)))


def deviation(items: Column, sample: bool = True) -> Column:
    return F.sqrt(variance(items, sample))


def mean_deviation(items: Column) -> Column:
    mean = average(items)
    return average(F.transform(items, lambda x: F.abs(x - mean)))


def geometric_mean(items: Column) -> Column:
    return F.when(~F.exists(_known(items), lambda x: x <= 0), F.exp(average(F.transform(items, F.ln))))


def harmonic_mean(items: Column) -> Column:
    return F.when(~F.exists(_known(items), lambda x: x <= 0), F.try_divide(F.lit(1.0), average(F.transform(items, lambda x: 1 / x))))


def smallest_of(items: Column, k: int = 1) -> Column:
    return F.get(F.array_sort(_known(items)), F.lit(k - 1))


def largest_of(items: Column, k: int = 1) -> Column:
    return F.get(F.sort_array(_known(items), asc=False), F.lit(k - 1))


def percentile(items: Column, share: float, inclusive: bool = True) -> Column:
    """PERCENTILE.INC, or PERCENTILE.EXC: NULL outside its range."""
    v = F.array_sort(_known(items))
    n = F.size(v)
    h = (n - 1) * F.lit(share) if inclusive else (n + 1) * F.lit(share) - 1
    low = F.floor(h).cast("int")
    a = F.get(v, low)
    value = a + (F.coalesce(F.get(v, low + 1), a) - a) * (h - low)
    return F.when((n > 0) & (h >= 0) & (h <= n - 1), value)


def median(items: Column) -> Column:
    return percentile(items, 0.5)


def covariance(a: Column, b: Column, sample: bool = False) -> Column:
    """Of two arrays without gaps."""
    ma, mb, n = average(a), average(b), F.size(a) - (1 if sample else 0)
    return F.try_divide(total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb))), n.cast("double"))


def slope(y: Column, x: Column) -> Column:
    return F.try_divide(covariance(x, y), covariance(x, x))


def intercept(y: Column, x: Column) -> Column:
    return average(y) - slope(y, x) * average(x)


def correlation(a: Column, b: Column) -> Column:
    return F.try_divide(covariance(a, b), F.sqrt(covariance(a, a) * covariance(b, b)))


def line_error(y: Column, x: Column) -> Column:
    """STEYX: the standard error of y about its line."""
    n = F.size(x)
    rest = F.greatest(F.lit(0.0), covariance(y, y) - slope(y, x) * covariance(x, y)) * n
    return F.when(n > 2, F.sqrt(rest / (n - 2)))


def multiple(x: Number, by: Number, how: str = "round") -> Column:
    """The nearest multiple (round), or the one above (up) or below (down)."""
    q = divide(x, by)
    return {"round": round_half(q), "up": F.ceil(q), "down": F.floor(q)}[how] * _c(by)


def quotient(a: Number, b: Number) -> Column:
    return whole(divide(a, b))


def factorial(n: Number) -> Column:
    k = F.floor(_c(n))
    return F.when((k >= 0) & (k <= 170), F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(0)).cast("int")), F.lit(1.0), lambda a, i: a * F.greatest(i, F.lit(1))))


def combinations(n: Number, k: Number) -> Column:
    a, b = F.floor(_c(n)), F.floor(_c(k))
    steps = F.sequence(F.lit(0), F.greatest(F.least(b, a - b), F.lit(0)).cast("int"))
    return F.when((b >= 0) & (a >= b), F.aggregate(steps, F.lit(1.0), lambda s, i: F.when(i == 0, s).otherwise(F.floor(s * (a - i + 1) / i + 0.5).cast("double"))))


def odd_one(*items: Column) -> Column:
    """XOR: whether an odd number of conditions holds; an error spreads."""
    return F.when(_all_known(items), sum((x.cast("int") for x in items[1:]), items[0].cast("int")) % 2 == 1)


def first_true(*pairs: tuple[Column, Number]) -> Column:
    """IFS: the value of the first condition that holds; NULL without one, or behind an error."""
    out = F.lit(None).cast("double")
    for condition, then in reversed(pairs):
        out = branch(condition, then, out)
    return out


def switch(x: Column, *cases: tuple[object, Number], other: Number | None = None) -> Column:
    out = F.lit(None).cast("double") if other is None else _c(other)
    for known, then in reversed(cases):
        out = F.when(x == F.lit(known), _c(then)).otherwise(out)
    return F.when(x.isNotNull(), out)


def _steps(y: Column) -> Column:
    """(a, b) of the least-squares line through the places 0, 1, ... of an array."""
    n = F.size(y).cast("double")
    mean, mid = average(y), (n - 1) / 2
    sums = F.aggregate(F.transform(y, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), F.lit(0.0), lambda s, x: s + (x["i"] - mid) * (x["v"] - mean))
    b = F.coalesce(F.try_divide(sums, (n * n - 1) * n / 12), F.lit(0.0))
    return F.struct((mean - b * mid).alias("a"), b.alias("b"))


def fill_numbers(source: Column, count: int, backward: bool = False) -> Column:
    """The next (or earlier) values of a filled series: two numbers or more go on as a line, with 15 digits; fewer, or numbers with gaps, are repeated."""
    n = F.size(source)
    places = F.sequence(F.lit(1), F.lit(count))
    at = F.transform(places, (lambda k: -k) if backward else (lambda k: n - 1 + k))

    def value(i: Column) -> Column:
        line = F.get(F.transform(F.array(_steps(source)), lambda s: s["a"] + s["b"] * i), F.lit(0))
        digits = F.when(line == 0, 0).otherwise(14 - F.floor(F.log10(F.abs(line)))).cast("int")
        return F.when(digits >= 0, F.round(line * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)).otherwise(line)

    plain = F.transform(at, lambda i: F.get(source, F.pmod(i, n)))
    return F.when(n == 0, F.slice(source, 1, 0)).when((n >= 2) & ~F.exists(source, F.isnull), F.transform(at, value)).otherwise(plain)


def fill_texts(source: Column, count: int, backward: bool = False) -> Column:
    """The same of texts: those of one beginning and a number behind it count on (one by one, or as a line); others are repeated."""
    n = F.size(source)
    at = F.transform(F.sequence(F.lit(1), F.lit(count)), (lambda k: -k) if backward else (lambda k: n - 1 + k))
    pattern = r"^(.*?)(\d+)$"
    heads = F.transform(source, lambda v: F.regexp_extract(v, pattern, 1))
    numbers = F.transform(source, lambda v: F.regexp_extract(v, pattern, 2).try_cast("double"))
    alike = (F.size(F.array_distinct(heads)) == 1) & (F.get(heads, F.lit(0)) != "") & ~F.exists(numbers, F.isnull) & ~F.exists(source, lambda v: F.isnull(v) | v.startswith("="))
    line = F.when(n == 1, F.struct(F.get(numbers, F.lit(0)).alias("a"), F.lit(1.0).alias("b"))).otherwise(_steps(numbers))
    counted = F.transform(at, lambda i: F.concat(F.get(heads, F.lit(0)), F.abs(F.round(F.get(F.transform(F.array(line), lambda s: s["a"] + s["b"] * i), F.lit(0)))).cast("long").cast("string")))
    return F.when(n == 0, F.slice(source, 1, 0)).when(alike, counted).otherwise(F.transform(at, lambda i: F.get(source, F.pmod(i, n))))
