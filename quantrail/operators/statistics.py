"""Descriptive statistics, histograms, certainty, correlation and tests, as aggregations.

NULL is the one error value: NaN and infinities become NULL first, and every statistic skips it. Ranks are
sums over counted values in quantile buckets, so one huge group is spread too; percentiles are exact unless approximate ones
are asked for.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import student_t_quantile, student_t_tail
from ..sources.folders import cut
from .joins import join_groups, join_hot
from .ranking import average_rank, cumulative
from .ranking import percentiles as shares_of

#: Percentiles of a report.
PERCENTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def valid(x: Column | str) -> Column:
    """x, or NULL where it is NaN or infinite."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def describe(df: DataFrame, value: str, by: list[str] | None = None, percentiles: tuple[float, ...] = PERCENTILES, accuracy: int | None = None) -> DataFrame:
    """One row for each group: count, errors, mean, sd, var, skew, kurt, cv, min, max, range and percentiles.

    Skewness and kurtosis are those of the sample (Excel's SKEW and KURT), corrected from the population moments. Percentiles
    are exact and interpolated (PERCENTILE.INC) unless an accuracy for approximate ones is given.
    """
    x = valid(value)
    n, by = F.count(x).cast("double"), by or []
    g1, g2 = F.skewness(x), F.kurtosis(x)
    out = df.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.count(F.when(x.isNull(), 1)).alias("errors"),
        F.avg(x).alias("mean"),
        F.when(n > 1, F.stddev_samp(x)).otherwise(F.when(n == 1, 0.0)).alias("sd"),
        F.when((n > 2) & (F.var_pop(x) > 0), g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when((n > 3) & (F.var_pop(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurt"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        *([F.percentile_approx(x, F.array(*map(F.lit, percentiles)), accuracy).alias("__p")] if accuracy else []),
    )
    if not accuracy:
        exact = shares_of(df.select(*by, x.cast("double").alias("__x")), "__x", percentiles, by).withColumnRenamed("p", "__p")
        out = join_groups(out, exact, by, "left") if by else out.join(F.broadcast(exact), how="left")  # a row for each group
    out = out.withColumns({"var": F.col("sd") * F.col("sd"), "cv": ratio(F.col("sd"), F.abs("mean")), "range": F.col("max") - F.col("min")})
    return out.withColumns({f"p{round(p * 100):02d}": F.col("__p")[i] for i, p in enumerate(percentiles)}).drop("__p")


def mean_interval(df: DataFrame, value: str, by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """mean, half (Student t half width of its interval; 0 for one value), low, high."""
    out = describe(df, value, by, (0.5,)).select(*(by or []), "n", "mean", "sd")
    t = student_t_quantile(F.lit((1 + level) / 2), F.col("n") - 1)
    half = F.when(F.col("n") > 1, t * F.col("sd") / F.sqrt(F.col("n").cast("double"))).otherwise(0.0)
    return out.withColumn("half", half).withColumns({"low": F.col("mean") - F.col("half"), "high": F.col("mean") + F.col("half")})


def mode(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """mode and times: for whole numbers the most frequent value, the least of equals; for others the middle of the fullest bin of the histogram, the first of equals.

    Values are counted before one is chosen. A group of one value has that value.
    """
    by = by or []
    rows = df.select(*by, valid(F.col(value).cast("double")).alias("__x")).filter("__x IS NOT NULL")
    kinds = rows.groupBy(*by).agg(((F.min((F.col("__x") == F.floor("__x")).cast("int")) == 1) | (F.min("__x") == F.max("__x"))).alias("__plain"), F.count("*").alias("__rows"))
    kinds = cut(kinds)
    plain, smooth = (join_hot(rows, kinds.filter(c).drop("__plain"), by, "__rows", nulls=True) if by else rows.join(F.broadcast(kinds.filter(c).select("__plain"))).drop("__plain") for c in ("__plain", "NOT __plain"))
    counts = plain.groupBy(*by, "__x").count()
    most = counts.groupBy(*by).agg(F.max_by("__x", F.struct("count", -F.col("__x"))).alias("mode"), F.max("count").alias("times"))
    bins = histogram(smooth, "__x", by)
    full = bins.groupBy(*by).agg(F.max_by((F.col("from") + F.col("to")) / 2, F.struct("count", -F.col("bin"))).alias("mode"), F.max("count").alias("times"))
    return most.unionByName(full).filter("times > 0")


def most_frequent(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The most frequent value, the least of equals; counted before it is chosen."""
    by = by or []
    counts = df.select(*by, valid(value).alias("__x")).filter("__x IS NOT NULL").groupBy(*by, "__x").count()
    return counts.groupBy(*by).agg(F.max_by("__x", F.struct("count", -F.col("__x"))).alias("mode"), F.max("count").alias("times"))


def histogram(df: DataFrame, value: str, by: list[str] | None = None, bins: int | None = None) -> DataFrame:
    """bin, from, to, count, frequency, cumulative; empty bins included, the last bin closed.

    Without a count, Freedman-Diaconis within 10 to 100, Sturges for a zero interquartile range, one bin for a constant. Integer
    values over a short range get a bin each, centred.
    """
    by = by or []
    x = valid(value)
    rows = df.select(*by, x.alias("__x")).filter("__x IS NOT NULL")
    s = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.min((F.col("__x") == F.floor("__x")).cast("int")).alias("__whole"))
    if bins is None:
        quarters = shares_of(rows, "__x", (0.25, 0.75), by).withColumnRenamed("p", "__q")
        s = join_groups(s, quarters, by)  # a row for each group
    n, span = F.col("__n").cast("double"), F.col("__hi") - F.col("__lo")
    if bins is None:
        iqr = F.col("__q")[1] - F.col("__q")[0]
        sturges = F.ceil(F.log2(n)) + 1
        rule = F.when(iqr > 0, F.ceil(span / (2 * iqr / F.pow(n, F.lit(1 / 3))) - 1e-9)).otherwise(sturges)
        k = F.greatest(F.lit(10), F.least(F.lit(100), rule.cast("int")))
        unit = (F.col("__whole") == 1) & (span + 1 <= 100)
    else:
        k, unit = F.lit(bins), F.lit(False)
    s = s.withColumn("__unit", unit)
    # A constant has one bin, half a per cent of it to each side.
    side = F.when(F.col("__lo") == 0, 0.5).otherwise(F.abs("__lo") * 0.005)
    s = s.withColumns({"__k": F.when(span == 0, 1).when(F.col("__unit"), span + 1).otherwise(k).cast("int"), "__from": F.when(span == 0, F.col("__lo") - side).when(F.col("__unit"), F.col("__lo") - 0.5).otherwise(F.col("__lo"))})
    s = s.withColumn("__w", F.when(span == 0, 2 * side).when(F.col("__unit"), 1.0).otherwise(span / F.col("__k")))
    s = cut(s.select(*by, "__n", "__k", "__from", "__w", F.col("__n").alias("__rows")))
    place = F.least(F.floor((F.col("__x") - F.col("__from")) / F.col("__w")), F.col("__k") - 1).cast("int")
    joined = join_hot(rows, s, by, "__rows", nulls=True) if by else rows.crossJoin(F.broadcast(s))  # without groups, one row
    counts = joined.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("count"))
    every = s.drop("__rows").withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    out = join_groups(every, counts, [*by, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    up = Window.partitionBy(*by).orderBy("bin")
    return out.select(
        *by,
        "bin",
        (F.col("__from") + F.col("bin") * F.col("__w")).alias("from"),
        (F.col("__from") + (F.col("bin") + 1) * F.col("__w")).alias("to"),
        "count",
        (F.col("count") / F.col("__n")).alias("frequency"),
        (F.sum("count").over(up) / F.col("__n")).alias("cumulative"),
    )


def certainty(df: DataFrame, value: str, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """The share of valid values in the closed interval."""
    x = valid(value)
    return df.groupBy(*(by or [])).agg(F.avg(F.when(x.isNotNull(), F.when(x.between(low, high), 1.0).otherwise(0.0))).alias("certainty"))


def ecdf(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """x, share of values up to x, on an even grid from least to largest. Values are counted between grid points, then summed."""
    rows = df.select(valid(value).alias("x")).filter("x IS NOT NULL")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    step = (F.col("hi") - F.col("lo")) / F.lit(points - 1)
    placed = rows.crossJoin(F.broadcast(ends)).groupBy(F.when(step > 0, F.ceil((F.col("x") - F.col("lo")) / step - 1e-12)).otherwise(0).cast("int").alias("i")).agg(F.count("*").alias("c"))
    grid = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + F.col("i") * step)
    upto = Window.orderBy("i")  # a row for each grid point
    out = grid.join(placed, "i", "left").withColumn("share", F.sum(F.coalesce("c", F.lit(0))).over(upto) / F.col("n"))
    return out.select("i", "x", "share")


def tail_certainty(df: DataFrame, value: str, mode: str, low: float = float("-inf"), high: float = float("inf"), by: list[str] | None = None) -> DataFrame:
    """by, certainty: the share of valid values up to high ("left"), from low on ("right"), or in the closed interval ("two"; 0 if low is above high)."""
    x = valid(value)
    inside = {"left": x <= high, "right": x >= low, "two": x.between(low, high)}[mode]
    return df.groupBy(*(by or [])).agg(F.avg(F.when(x.isNotNull(), F.when(inside, 1.0).otherwise(0.0))).alias("certainty"))


def certainty_bounds(df: DataFrame, value: str, mode: str, certainty: float = 0.9, by: list[str] | None = None) -> DataFrame:
    """by, low, high: bounds that hold a share of the values; of two tails each has half of the rest, and an open side is infinite."""
    c = min(1.0, max(0.0, certainty))
    shares = {"left": [0.0, c], "right": [1 - c, 1.0], "two": [(1 - c) / 2, 1 - (1 - c) / 2]}[mode]
    found = shares_of(df.select(*(by or []), valid(F.col(value).cast("double")).alias("__x")), "__x", shares, by)
    low = F.lit(float("-inf")) if mode == "left" else F.col("p")[0]
    high = F.lit(float("inf")) if mode == "right" else F.col("p")[1]
    return found.select(*(by or []), low.alias("low"), high.alias("high"))


def forecast_statistics(df: DataFrame, value: str, by: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    """by, statistic, result: the ten statistics of a forecast by name. probAbove and probBelow (which has the threshold itself) sum to 1; one value has stdDev 0."""
    x, found = valid(value), describe(df, value, by, (0.05, 0.1, 0.5, 0.9, 0.95))
    above = df.groupBy(*(by or [])).agg(F.avg(F.when(x.isNotNull(), F.when(x > threshold, 1.0).otherwise(0.0))).alias("__above"))
    found = join_groups(found, above, by or [])
    of = {"mean": "mean", "median": "p50", "stdDev": "sd", "cv": "cv", "p5": "p05", "p10": "p10", "p90": "p90", "p95": "p95"}
    named = [F.struct(F.lit(k).alias("statistic"), F.col(c).cast("double").alias("result")) for k, c in of.items()]
    named += [F.struct(F.lit(k).alias("statistic"), c.cast("double").alias("result")) for k, c in (("probAbove", F.col("__above")), ("probBelow", 1 - F.col("__above")))]
    return found.select(*(by or []), F.explode(F.array(*named)).alias("s")).select(*(by or []), "s.*")


def pearson(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Correlation of complete pairs; NULL if one side is constant."""
    pairs = df.filter(valid(a).isNotNull() & valid(b).isNotNull())
    sums = pairs.groupBy(*(by or [])).agg(F.corr(a, b).alias("r"), F.var_pop(a).alias("__a"), F.var_pop(b).alias("__b"), F.count("*").alias("n"))
    return sums.select(*(by or []), "n", F.when((F.col("__a") > 0) & (F.col("__b") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))).alias("r"))


def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Correlation of average ranks of complete pairs.

    Pairs are counted first. Ranks of b are looked up for them, and summed by value of a before a's ranks are needed, so a column of
    few values is never a join key of many rows.
    """
    by = by or []
    pairs = df.filter(valid(a).isNotNull() & valid(b).isNotNull())
    pairs = cut(pairs.groupBy(*by, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__o")).agg(F.count("*").alias("__c")))
    ranks = cut(cumulative(pairs, "__o", by, weight="__c").select(*by, "__o", average_rank().alias("__rb"), "count"))
    ranked = join_hot(pairs, ranks, [*by, "__o"], "count", nulls=bool(by))
    return _rank_correlation(ranked, by)


def _rank_correlation(ranked: DataFrame, by: list[str]) -> DataFrame:
    """by, n, r for rows of __a, __rb (rank of the other side) and __c (how many there are)."""
    c, rb = F.col("__c"), F.col("__rb")
    sums = cut(ranked.groupBy(*by, "__a").agg(F.sum("__c").alias("__c"), F.sum(c * rb).alias("__s"), F.sum(c * rb * rb).alias("__q")))
    ranks = cumulative(sums, "__a", by, weight="__c").select(*by, "__a", average_rank().alias("__ra"))
    ra = F.col("__ra")
    t = join_groups(sums, ranks, [*by, "__a"]).groupBy(*by).agg(F.sum(c).alias("n"), F.sum(c * ra).alias("x"), F.sum(c * ra * ra).alias("xx"), F.sum("__s").alias("y"), F.sum("__q").alias("yy"), F.sum(ra * F.col("__s")).alias("xy"))
    n = F.col("n").cast("double")
    vx, vy = n * F.col("xx") - F.col("x") * F.col("x"), n * F.col("yy") - F.col("y") * F.col("y")
    r = (n * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(vx * vy)
    return t.select(*by, "n", F.when((vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def welch(df: DataFrame, value: str, group: str, first: str, second: str, level: float = 0.95) -> DataFrame:
    """Welch's t, its degrees of freedom, two-sided p, and the interval of the difference of the means of two groups."""
    x = valid(value)

    def side(name: str, key: str) -> list[Column]:
        y = F.when(F.col(group) == key, x)
        return [F.count(y).cast("double").alias(f"n{name}"), F.avg(y).alias(f"m{name}"), F.var_samp(y).alias(f"v{name}")]

    s = df.agg(*side("a", first), *side("b", second))
    a, b = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    gap = F.col("ma") - F.col("mb")
    # Two constant groups: equal means leave no doubt, others no chance.
    t = F.when(a + b > 0, gap / F.sqrt(a + b)).when(gap == 0, 0.0).otherwise(F.signum(gap) * float("inf"))
    dof = F.when(a + b > 0, (a + b) * (a + b) / (a * a / (F.col("na") - 1) + b * b / (F.col("nb") - 1))).otherwise(F.col("na") + F.col("nb") - 2)
    s = s.filter("na > 1 AND nb > 1").select(t.alias("t"), dof.alias("df"), gap.alias("difference"), F.sqrt(a + b).alias("error"))
    s = s.withColumn("p", 2 * student_t_tail(F.abs("t"), F.col("df")))
    half = student_t_quantile(F.lit((1 + level) / 2), F.col("df")) * F.col("error")
    return s.select("t", "df", "p", "difference", (F.col("difference") - half).alias("low"), (F.col("difference") + half).alias("high"))


def overlay(df: DataFrame, value: str, group: str, bins: int = 20) -> DataFrame:
    """Relative frequencies of several groups over the same edges."""
    rows = df.select(F.col(group).alias("grp"), valid(value).alias("x")).filter("x IS NOT NULL")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    placed = rows.crossJoin(F.broadcast(ends)).groupBy("grp", F.when(w > 0, F.least(F.floor((F.col("x") - F.col("lo")) / w), F.lit(bins - 1))).otherwise(0).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return placed.select("grp", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("grp"))).alias("frequency"))


def sensitivity(df: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """input, rho (rank correlation with the output over complete pairs), share of the summed squares; constant inputs have rho 0.

    The output is ranked once for all inputs without gaps.
    """
    rows = df.filter(valid(output).isNotNull()).select(F.col(output).cast("double").alias("__y"), *[valid(F.col(c).cast("double")).alias(c) for c in inputs])
    gaps = rows.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in inputs]).first().asDict()
    full = [c for c in inputs if not gaps[c]]
    out = [spearman(rows, c, "__y").select(F.lit(c).alias("input"), "r") for c in inputs if gaps[c]]
    if full:
        ranks = cut(cumulative(rows, "__y").select("__y", average_rank().alias("__rb"), "count"))
        ranked = join_hot(rows, ranks, ["__y"], "count")
        long = ranked.select("__rb", F.lit(1).alias("__c"), F.explode(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).alias("__a")) for c in full])).alias("i")).select("i.*", "__rb", "__c")
        out.append(_rank_correlation(long, ["input"]).select("input", "r"))
    rho = functools.reduce(DataFrame.union, out).select("input", F.coalesce("r", F.lit(0.0)).alias("rho"))
    total = F.sum(F.col("rho") * F.col("rho")).over(Window.partitionBy())  # a row for each input
    return rho.withColumn("share", F.when(total > 0, F.col("rho") * F.col("rho") / total).otherwise(0.0))
