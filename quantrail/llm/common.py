"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_hot as join_hot  # for the operators here
from ..sources import folders
from ..sources.folders import delete as delete
from ..sources.folders import discard as discard
from ..sources.folders import own_folder as own_folder

#: Longest input a Python worker holds at a time, in rows of an Arrow batch.
BATCH_ROWS = 1024
#: The same where a row of text becomes many rows.
FEW_ROWS = 256

#: Column names that operators use inside; a user column of such a name is never read or overwritten.
PREFIX = "__qt_"

#: ASCII white space, the word separator of every operator here (bytes.split() uses the same six).
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Texts can be very long, so Arrow batches hold few rows; never raises a smaller setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


_memory: dict[str, Callable[[], None]] = {}
_working = ""


def remembers(operator: str, clear: Callable[[], None]) -> None:
    """Says how a worker forgets what an operator keeps between batches."""
    _memory[operator] = clear


def works(operator: str) -> None:
    """Python workers serve one stage after another; one holds the memory of its present operator alone."""
    global _working
    if _working != operator:
        for other, clear in _memory.items():
            if other != operator:
                clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # not every platform has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _working = operator


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that a lost executor costs no recomputation.

    Columns are compressed, and Spark knows the size of what it reads. A table stays until discard(), the end of within() or
    the end of the driver's program deletes it.
    """
    out = folders.cut(df, "zstd")
    for paths in _scopes:
        paths.append(out._cut_path)
    return out


def repeatable(df: DataFrame) -> DataFrame:
    """df, if every evaluation deals its rows to partitions alike, as a plain scan of files does; otherwise df cut."""
    nodes = [line.lstrip(" :+-") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    return df if all(n.startswith(("Project", "Filter", "Relation")) for n in nodes if n) else cut(df)


_scopes: list[list[str]] = []


@contextlib.contextmanager
def within(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables cut meanwhile: for a job whose result is written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


#: Bits of a sieve: a thousand rows of 4 KB, whatever it holds.
SIEVE_BITS = 1 << 25


def sieve(keys: DataFrame, column: str) -> DataFrame:
    """A bitmap of the hashes of some keys, of fixed size, cut: what it lacks is not among them, what it has may be."""
    place = F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS)) + 1
    found = keys.select(F.bitmap_bucket_number(place).alias("__qt_bucket"), F.bitmap_bit_position(place).alias("__qt_bit"))
    return cut(found.groupBy("__qt_bucket").agg(F.bitmap_construct_agg("__qt_bit").alias("__qt_bits")))


def sifted(rows: DataFrame, column: str, by: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the sieve, rows whose key is not): so texts that no one asks for are not shuffled. rows is read twice."""
    place = F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS)) + 1
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__qt_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.floor(byte / F.pow(F.lit(2.0), bit % 8)) % 2 == 1, F.lit(False))
    marked = rows.join(F.broadcast(by), F.bitmap_bucket_number(place) == F.col("__qt_bucket"), "left").withColumn("__qt_there", there)  # at most SIEVE_BITS / 32768 rows
    return tuple(marked.filter(c).drop("__qt_bucket", "__qt_bits", "__qt_there") for c in (F.col("__qt_there"), ~F.col("__qt_there")))


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under inner names: extra columns of the input cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def refuse(df: DataFrame, *names: str) -> None:
    """Raises an error if df has a column of a result's name, which would be overwritten."""
    if clash := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"rename these columns first, for the result has columns of that name: {sorted(clash)}")
