"""Uniform numbers from hashed counters: independent of partitioning, repeatable in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 13 hexadecimal digits of a digest are 52 bits.
STEPS = 4503599627370496.0


def uniform(seed: int, name: str | Column, trial: Column | str) -> Column:
    """A number in the open unit interval for each (seed, name, trial)."""
    trial = F.col(trial) if isinstance(trial, str) else trial
    name = F.lit(name) if isinstance(name, str) else name
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), name, trial.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / STEPS


def uniform_sql(seed: int, name: str, trial: str, column: bool = False) -> str:
    """The same number as DuckDB SQL; with column, name is an expression."""
    name = name if column else f"'{name}'"
    return f"((('0x' || substr(md5('{seed}|' || {name} || '|' || ({trial})::VARCHAR), 1, 13))::UBIGINT::DOUBLE + 0.5) / {STEPS})"
