"""Best-fit packing of tokenised documents into sequences of a fixed capacity, with the best-two-fit exchange.

Packing looks at lengths alone, and there are at most `capacity` of them: the corpus is counted by length, the bins are
planned on those counts (each plan step makes as many equal bins as the counts allow), and every piece finds its place
from its length and its rank among the pieces of that length. So the plan sees the whole corpus, while what reaches
the driver is bounded by the capacity.

A step fills a bin greedily, longest fitting length first; then, while it helps, the bin's smallest document gives way to two
unpacked ones that fill the expanded gap more tightly.

Defined results: a null or empty text is one piece, the end token; repeated rows are packed each by itself; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_trie import encoder
from .common import cut, refuse, small_batches

PIECES = T.ArrayType(
    T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
)
PLACE = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def token_pieces(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", kept: int | None = None) -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32. Only documents over the capacity are cut. kept: bytes of words that a worker remembers."""
    small_batches(df.sparkSession)
    tail = end_id.to_bytes(4, "little")

    @F.pandas_udf(PIECES)
    def run(texts: pd.Series) -> pd.Series:
        rows = []
        for ids in encoder(path, "bytes", kept).packed(texts.tolist()):
            ids += tail
            rows.append([(k, k * capacity, min(capacity, len(ids) // 4 - k * capacity), zlib.crc32(ids[4 * k * capacity : 4 * (k + 1) * capacity])) for k in range(-(-len(ids) // 4 // capacity))])
        return pd.Series(rows, dtype=object)

    return df.select(F.col(f"`{key}`").alias(key), F.explode(run(F.col(f"`{text}`"))).alias("p")).select(key, "p.*")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for counted lengths: [([(length, copies in the bin)], number of equal bins)]."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sizes = np.arange(capacity + 1)
    plan = []

    def below(free: np.ndarray) -> np.ndarray:
        """below[x]: the largest length of at most x that is still there, 0 if none."""
        return np.maximum.accumulate(np.where(free > 0, sizes, 0))

    while left.any():
        free = left.copy()
        under = below(free)
        used: dict[int, int] = {}
        gap = capacity
        while length := int(under[gap]):
            n = min(int(free[length]), gap // length)
            used[length] = used.get(length, 0) + n
            free[length] -= n
            gap -= n * length
            if not free[length]:
                under = below(free)
        while gap and used:
            least = min(used)
            room = gap + least
            first = sizes[1:room][free[1:room] > 0]
            if not len(first):
                break
            second = under[np.minimum(room - first, first)]
            # a length that is to serve twice needs two documents
            second = np.where((second == first) & (free[first] < 2), under[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            best = int(total.argmax())
            if total[best] <= least:
                break
            used[least] -= 1
            free[least] += 1
            if not used[least]:
                del used[least]
            for x in (int(first[best]), int(second[best])):
                used[x] = used.get(x, 0) + 1
                free[x] -= 1
            gap = room - int(total[best])
            under = below(free)
        bins = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * bins
        plan.append((sorted(used.items(), reverse=True), bins))
    return plan


def pack(pieces: DataFrame, capacity: int = 4096, order: tuple[str, ...] = ()) -> DataFrame:
    """pieces with sequence_id and offset. Needs a column length of 1..capacity; order (all other columns unless given) only makes the numbering repeatable.

    Columns named sequence_id or offset are refused. Of what Spark may choose to broadcast, `before` has a row for each length in each
    part of the input; the plan's runs saturate below 1 MB.
    """
    refuse(pieces, "sequence_id", "offset")
    order = order or tuple(c for c in pieces.columns if c != "length")
    part, rank = F.col("__qt_part"), F.col("__qt_rank")
    pieces = cut(pieces.withColumn("__qt_part", F.spark_partition_id()))
    counts = cut(pieces.groupBy("length", "__qt_part").agg(F.count("*").alias("__qt_n")))
    by_length = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__qt_n")).collect()}  # at most `capacity` rows

    # Where each length's pieces go: runs of ranks, each run on the equal bins of one plan step.
    runs, bins_before, served = [], 0, dict.fromkeys(by_length, 0)
    for lengths, bins in plan_bins(by_length, capacity):
        at = 0
        for length, n in lengths:
            runs.append((length, served[length], bins_before, n, at))
            served[length] += n * bins
            at += n * length
        bins_before += bins
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast((table[:, 0] * (1 << 50) + table[:, 1], table))

    @F.pandas_udf(PLACE)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, runs = shared.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = runs[np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1]
        bin_, copy = np.divmod(rank - run[:, 1], run[:, 3])
        return pd.DataFrame({"sequence_id": run[:, 2] + bin_, "offset": run[:, 4] + copy * length})

    before = counts.withColumn("__qt_before", F.sum("__qt_n").over(Window.partitionBy("length").orderBy("__qt_part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "__qt_part", F.coalesce("__qt_before", F.lit(0)).alias("__qt_before"))
    within = Window.partitionBy("length", "__qt_part").orderBy(*order)
    ranked = pieces.withColumn("__qt_rank", F.row_number().over(within)).join(before, ["length", "__qt_part"])
    placed = ranked.withColumn("__qt_place", place("length", rank - 1 + F.col("__qt_before")))
    return placed.select(*[c for c in pieces.columns if c != "__qt_part"], "__qt_place.*")
