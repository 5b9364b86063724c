"""Matrix products of tables of entries, by blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inner places (columns of the left matrix, rows of the right one) of a block.
BLOCK = 181
#: Rows of the left matrix and columns of the right one whose entries meet in a block.
ROWS, COLUMNS = 65536, 16384
#: Numbers of a product that a worker holds at a time.
HELD = 2**21


def _side(entries: DataFrame, outer: str, inner: str, wide: int, size: int, block: str) -> DataFrame:
    """The known entries of a matrix: outer and inner place in its block, value, and the block's numbers."""
    known = entries.select(F.col(outer).cast("long").alias("outer"), F.col(inner).cast("long").alias("k"), F.col("v").cast("double").alias("v")).dropna()
    return known.select(F.floor(F.col("k") / size).alias("bk"), F.floor(F.col("outer") / wide).alias(block), "outer", F.pmod("k", F.lit(size)).cast("int").alias("inner"), "v")


def multiply(a: DataFrame, b: DataFrame, size: int = BLOCK) -> DataFrame:
    """i, j, v: the product of two matrices given as entries (i, j, v); absent entries are zeros, and zeros of the product are left out. Entries of one place are summed.

    Entries, not filled blocks, are shuffled: those of a block of b ahead of those of a that meet it. A worker makes the rows of b's block over the
    columns that it has, and multiplies slices of a's entries by it, over the rows that they have; so it holds a bounded number of cells however
    few or many entries a block has. What a product has other than zeros is summed by place.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, met, right, columns = None, [], None, None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("bk", "bi", "bj", "side")]
            outer, inner, v = (batch.column(c).to_numpy() for c in ("outer", "inner", "v"))
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for low, high in pairwise([0, *changes.tolist(), batch.num_rows]):
                if low == high:
                    continue
                here = tuple(k[low] for k in keys[:3])
                if here != at:
                    at, met, right = here, [], None
                if keys[3][low] == 0:
                    met.append((outer[low:high], inner[low:high], v[low:high]))
                    continue
                if right is None:
                    places, of, values = (np.concatenate(x) for x in zip(*met, strict=True))
                    columns, place = np.unique(places, return_inverse=True)
                    right = np.bincount(of.astype(np.int64) * len(columns) + place, values, size * len(columns)).reshape(size, -1)
                step = max(1, HELD // max(size, len(columns)))
                for k in range(low, high, step):
                    mine = slice(k, min(k + step, high))
                    rows, place = np.unique(outer[mine], return_inverse=True)
                    made = np.bincount(place * size + inner[mine], v[mine], len(rows) * size).reshape(-1, size) @ right
                    i, j = np.nonzero(made)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[i]), pa.array(columns[j]), pa.array(made[i, j])], ["i", "j", "v"])

    left, right = _side(a, "i", "j", ROWS, size, "bi"), _side(b, "j", "i", COLUMNS, size, "bj")
    left, right = left.join(right.select("bk", "bj").distinct(), "bk"), right.join(left.select("bk", "bi").distinct(), "bk")
    names = ["bk", "bi", "bj", "side", "outer", "inner", "v"]
    both = left.withColumn("side", F.lit(1)).select(names).union(right.withColumn("side", F.lit(0)).select(names))
    made = both.repartition("bk", "bi", "bj").sortWithinPartitions("bk", "bi", "bj", "side").mapInArrow(products, "i long, j long, v double")
    return made.groupBy("i", "j").agg(F.sum("v").alias("v")).filter("v != 0")
