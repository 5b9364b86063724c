"""Delimited text: separators found from a sample of lines, numbers in the notation of a locale.

Every value is read as text first; a column whose values are all numbers becomes a double, one of truth words a boolean.
A number is one pattern with named parts, one for each decimal mark; which mark a file uses is the one that makes most columns
numbers.
"""

from __future__ import annotations

import csv
import statistics

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that are looked at to find the delimiter; a feature of the format guess, not of the data read.
SAMPLE = 50
#: Delimiters in order of preference, currency signs, truth words.
DELIMITERS = ("\t", ";", ",", "|")
CURRENCY = r"(?:[$€£¥₡₲₱]|US\$|USD|EUR|PYG|Gs\.?)"
TRUE, FALSE = ("TRUE", "VERDADERO"), ("FALSE", "FALSO")
#: Fixed value: the byte order mark that some files begin with.
MARK = chr(0xFEFF)


def delimiter_of(lines: list[str]) -> str:
    """The delimiter that gives lines of several fields and the least spread of their number, more fields first; quoted ones count as text. Empty if there is none."""
    best: tuple[float, float] | None = None
    found = ""
    for d in DELIMITERS:
        sizes = [len(row) for row in csv.reader([line for line in lines if line.strip()], delimiter=d)]
        if not sizes or statistics.median(sizes) < 2:
            continue
        rank = (statistics.pvariance(sizes), -statistics.mean(sizes))
        if best is None or rank < best:
            best, found = rank, d
    return found


def number_pattern(decimal: str) -> str:
    """Groups: 1 opening bracket, 2 and 3 signs before and after a currency, 4 whole part, 5 fraction, 6 exponent, 7 per cent, 8 closing bracket."""
    point, group = (",", r"\.") if decimal == "," else (r"\.", ",")
    whole = "|".join(rf"\d{{1,3}}(?:{g}\d{{3}})+" for g in (group, "[ \u00a0]", "['’]")) + r"|\d+|(?=" + point + r"\d)"
    return rf"^\s*(\()?\s*([-+]?)\s*{CURRENCY}?\s*([-+]?)({whole})(?:{point}(\d*))?([eE][-+]?\d+)?\s*{CURRENCY}?\s*(%)?\s*(\))?\s*$"


def locale_number(x: Column | str, decimal: str = ".") -> Column:
    """The number in a text, or NULL: groups of three, a per cent sign, brackets for negatives and currency signs are understood."""
    x = F.col(x) if isinstance(x, str) else x
    pattern = number_pattern(decimal)
    part = lambda i: F.regexp_extract(x, pattern, i)
    digits = F.concat(F.regexp_replace(part(4), r"\D", ""), F.lit("."), part(5), F.lit("0"), part(6))
    size = F.concat(F.lit("0"), digits).try_cast("double")
    sign = F.when((part(2) == "-") != (part(3) == "-"), -1).otherwise(1) * F.when(part(1) != "", -1).otherwise(1)
    good = x.rlike(pattern) & ((part(1) != "") == (part(8) != "")) & ((part(2) == "") | (part(3) == ""))
    return F.when(good, sign * size / F.when(part(7) != "", 100.0).otherwise(1.0))


def decimal_of(df: DataFrame, columns: list[str], delimiter: str = "") -> str:
    """The mark that reads most columns as numbers throughout, then most values; if both read alike, the comma for files with semicolons."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.when(F.trim(F.col(c)) != "", F.col(c))
        aggs.append(F.count(x).alias(f"n{i}"))
        aggs += [F.count(locale_number(x, mark)).alias(f"{name}{i}") for name, mark in (("c", ","), ("p", "."))]
    r = df.agg(*aggs).first()

    def reads(name: str) -> tuple[int, int]:
        got = [(r[f"{name}{i}"], r[f"n{i}"]) for i in range(len(columns))]
        return sum(a == n > 0 for a, n in got), sum(a for a, _ in got)

    comma, point = reads("c"), reads("p")
    return "," if comma > point or (comma == point and delimiter == ";") else "."


def typed(df: DataFrame, decimal: str) -> DataFrame:
    """Text columns whose every value is a number or a truth word, in their type; one aggregation decides for all."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    at = {c: F.col(f"`{c}`") for c in texts}
    filled = {c: F.when(F.trim(x) != "", F.trim(x)) for c, x in at.items()}
    bad = [F.count(F.when(filled[c].isNotNull() & locale_number(filled[c], decimal).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(texts)]
    odd = [F.count(F.when(filled[c].isNotNull() & ~F.upper(filled[c]).isin(*TRUE, *FALSE), 1)).alias(f"b{i}") for i, c in enumerate(texts)]
    known = [F.count(filled[c]).alias(f"k{i}") for i, c in enumerate(texts)]
    r = df.agg(*bad, *odd, *known).first()
    change = {}
    for i, c in enumerate(texts):
        if r[f"k{i}"] and not r[f"n{i}"]:
            change[c] = locale_number(filled[c], decimal)
        elif r[f"k{i}"] and not r[f"b{i}"]:
            change[c] = F.upper(filled[c]).isin(*TRUE)
        else:
            change[c] = filled[c]
    return df.withColumns(change)


def read_delimited(spark: SparkSession, path: str, header: bool = True, delimiter: str | None = None, decimal: str | None = None) -> DataFrame:
    """A delimited file or folder with typed columns; separators are found where they aren't given."""
    if delimiter is None:
        lines = [r[0].lstrip(MARK) for r in spark.read.text(path).filter(F.trim("value") != "").limit(SAMPLE).collect()]
        delimiter = delimiter_of(lines) or ","
    df = spark.read.option("sep", delimiter).option("header", header).option("multiLine", False).csv(path)
    df = df.toDF(*[c.lstrip(MARK) for c in df.columns])
    blank = F.coalesce(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.lit(1)) for c in df.columns]).isNull()
    df = df.filter(~blank)
    return typed(df, decimal or decimal_of(df, [f"`{c}`" for c in df.columns], delimiter))


def numbers_of(df: DataFrame, text: str, decimal: str = ".") -> DataFrame:
    """df with a row for each number in a pasted list, split at white space and semicolons: place, number."""
    parts = df.select("*", F.posexplode(F.split(F.trim(text), r"[\s;]+")).alias("place", "__token"))
    return parts.withColumn("number", locale_number("__token", decimal)).drop("__token").filter("number IS NOT NULL")


def with_header(rows: list[list[object]]) -> tuple[list[str], list[list[object]]]:
    """Names and rows of a pasted matrix: the first row names the columns if it holds texts alone and a later row does not."""
    texts = lambda row: all(isinstance(v, str) and v.strip() for v in row)
    width = max((len(r) for r in rows), default=0)
    if rows and len(rows[0]) == width and texts(rows[0]) and any(not texts(r) for r in rows[1:]):
        return [str(v).strip() for v in rows[0]], rows[1:]
    return [f"c{i + 1}" for i in range(width)], rows


def complete_rows(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """Rows without a missing value in the columns, and the aggregate that counts the dropped ones in df."""
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    return df.filter(full), F.count(F.when(~full, 1)).alias("dropped")
