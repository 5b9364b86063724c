"""Helpers of the queries: tables, rounding that Spark and DuckDB share, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Half away from zero on the binary value; never a negative zero."""
    x = F.col(x) if isinstance(x, str) else x
    scale = F.lit(10.0**digits)
    r = F.floor(F.abs(x) * scale + 0.5).cast("double") / scale
    return F.when(r == 0, 0.0).when(x < 0, -r).otherwise(r)


def round_all(df: DataFrame, digits: int = 6, but: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[rounded(c, digits).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


def r(x: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    s = f"CAST({10.0**digits!r} AS DOUBLE)"
    f = f"(floor(abs({x}) * {s} + 0.5)::DOUBLE / {s})"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {f} = 0 THEN 0.0::DOUBLE WHEN {x} < 0 THEN -{f} ELSE {f} END)"


def round_sql(inner: str, doubles: list[str], others: list[str], digits: int = 6) -> str:
    return f"SELECT {', '.join([*others, *[f'{r(c, digits)} AS {c}' for c in doubles]])} FROM ({inner})"
