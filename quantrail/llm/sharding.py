"""Shards by jump consistent hashing, in DataFrame expressions alone.

A key's hash seeds a 64-bit linear congruential generator whose draws say at which shard count the key would next
move; the last move below the count is the key's shard. No ring table is kept, and one more shard takes rows only into
itself. Unsigned 64-bit arithmetic is done on two 32-bit halves, for signed longs would overflow.

Defined results: a null key is a key of its own; equal keys share a shard, whose slots stay gapless; a null text has no bytes.
A column named shard, grown_shard or slot is refused, not overwritten. A key that moved more than MOVES times would raise an
error; it moves about ln(shards) times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import refuse, repeatable

#: Fixed value: the multiplier of the generator in the published algorithm (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
#: Moves are rarer and rarer (about ln(count) of them); a key with more moves than this raises an error instead of a wrong shard.
MOVES = 200


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2^64."""
    mask = F.lit(0xFFFFFFFF)

    def low_product(x: Column, by: int) -> tuple[Column, Column]:
        """x * by for x, by under 2^32, as (bits from 32 on, lower 32 bits), by halves of x."""
        a = x.bitwiseAND(0xFFFF) * F.lit(by)
        b = F.shiftright(x, 16) * F.lit(by)
        t = a + F.shiftleft(b.bitwiseAND(0xFFFF), 16)
        return F.shiftright(b, 16) + F.shiftright(t, 32), t.bitwiseAND(mask)

    carry, low = low_product(lo, LOW)
    _, cross = low_product(hi, LOW)
    high = (carry + (lo * F.lit(HIGH)).bitwiseAND(mask) + cross).bitwiseAND(mask)
    return (high + F.shiftright(low + 1, 32)).bitwiseAND(mask), (low + 1).bitwiseAND(mask)


def key_hash(key: Column) -> Column:
    """60 bits of a key's MD5 digest: stable across engines and releases."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def jump_shard(hashed: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a non-negative 64-bit hash."""
    start = F.struct(F.shiftright(hashed, 32).alias("hi"), hashed.bitwiseAND(0xFFFFFFFF).alias("lo"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def move(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        # the published step: floor((b + 1) * (2^31 / ((key >> 33) + 1)))
        then = F.floor((s["next"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        return F.when(s["next"] >= shards, s).otherwise(F.struct(hi.alias("hi"), lo.alias("lo"), s["next"].alias("at"), then.cast("long").alias("next")))

    def last(s: Column) -> Column:
        return F.when(s["next"] >= shards, s["at"]).otherwise(F.raise_error(F.lit("a key moved too often")).cast("long")).cast("int")

    return F.aggregate(F.array(*[F.lit(i) for i in range(min(shards, MOVES) + 1)]), start, move, last)


def shard(df: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """df with shard, grown_shard (with one shard more) and slot (a row's place in its shard, gapless from 0).

    A slot is the row's place in its part of the input plus the rows of that shard in earlier parts. Rows are dealt
    by part and shard, so a group is never larger than a part, whatever key is frequent.
    """
    refuse(df, "shard", "grown_shard", "slot")
    hashed = key_hash(F.col(f"`{key}`"))
    df = repeatable(df).select("*", F.spark_partition_id().alias("__qt_part"), F.monotonically_increasing_id().alias("__qt_row"), hashed.alias("__qt_hash"))
    df = df.withColumns({"shard": jump_shard(F.col("__qt_hash"), shards), "grown_shard": jump_shard(F.col("__qt_hash"), shards + 1)})
    counts = df.groupBy("shard", "__qt_part").agg(F.count("*").alias("__qt_n"))
    earlier = Window.partitionBy("shard").orderBy("__qt_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "__qt_part", F.coalesce(F.sum("__qt_n").over(earlier), F.lit(0)).alias("__qt_before"))
    within = Window.partitionBy("shard", "__qt_part").orderBy("__qt_row")
    out = df.withColumn("__qt_rank", F.row_number().over(within) - 1).join(before, ["shard", "__qt_part"])
    return out.withColumn("slot", (F.col("__qt_rank") + F.col("__qt_before")).cast("long")).drop("__qt_part", "__qt_row", "__qt_hash", "__qt_rank", "__qt_before")
