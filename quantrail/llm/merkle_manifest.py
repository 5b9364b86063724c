"""A Merkle manifest of a dataset: a digest for each row, a tree for each group of rows, and a tree over the groups.

Nodes are ordered by ranges, not by one sort, and dealt into aligned blocks of FANOUT ** LEVELS nodes. In a worker a block is one
contiguous matrix of hex digits: a level is that matrix reshaped so that a row is a run of FANOUT digests, and the siblings of every
node are rows found by index arithmetic. The heads of the blocks are the nodes of the next round, until each group has one node.
So a hot group is many blocks, and what a row needs from above its block is the same for the whole block.

Defined results: a null field is `-`, so a null text differs from an empty one; a null group is a group, the first; a null key comes
first in its group; rows of one key are ordered by digest, and repeated rows are leaves each. A group of one row is its own root, as is
a single group. An empty table gives no rows. Other columns are ignored; inner columns are `__qt_`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_hot, renamed, small_batches

FANOUT = 3
#: Levels of a block; 243 nodes of 64 digits are 16 KB.
LEVELS = 5
#: Blocks that a worker holds at a time; with all siblings a block is about 200 KB.
BLOCKS = 64
DIGITS = 64
_SIDE = T.ArrayType(T.StringType())
PROOFS = T.ArrayType(T.StructType([T.StructField("left", _SIDE), T.StructField("right", _SIDE)]))


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes in front, so that fields can't run together."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _digests(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8).reshape(-1, DIGITS)


def level_above(nodes: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """The digests of runs of nodes; the last run may be shorter."""
    whole = len(nodes) // fanout
    runs = [*nodes[: whole * fanout].reshape(whole, fanout * DIGITS), *([nodes[whole * fanout :].ravel()] if len(nodes) % fanout else [])]
    return _digests("".join(hashlib.sha256(run).hexdigest() for run in runs))


def levels(leaves: np.ndarray, whole: bool, fanout: int = FANOUT, most: int = LEVELS) -> list[np.ndarray]:
    """All levels of a block, its head last. A block of a larger tree (not whole) always rises by `most` levels."""
    out = [leaves]
    while len(out) <= most and (len(out[-1]) > 1 or not whole):
        out.append(level_above(out[-1], fanout))
    return out


def siblings(rows: list[np.ndarray], fanout: int = FANOUT) -> pa.Array:
    """For each leaf the digests left and right of its ancestor in its run, level by level."""
    n, height = len(rows[0]), len(rows) - 1
    sizes = np.array([len(r) for r in rows[:-1]], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if height else sizes
    at = np.arange(n)[:, None] // fanout ** np.arange(height)  # of the ancestor at each level
    run = at // fanout * fanout
    stacked = np.concatenate(rows[:-1]) if height else rows[0][:0]
    step = np.arange(fanout - 1)
    sides = []
    for start, end in ((run, at), (at + 1, np.minimum(run + fanout, sizes))):
        where = start[:, :, None] + step
        there = where < end[:, :, None]
        digits = stacked[(where + first[:, None])[there]]
        ends = np.concatenate([[0], np.cumsum(there.sum(2).ravel())]).astype(np.int32) * DIGITS
        texts = pa.StringArray.from_buffers(n * height, pa.py_buffer(ends.tobytes()), pa.py_buffer(digits.tobytes()))
        sides.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * height), texts))
    return pa.StructArray.from_arrays(sides, ["left", "right"])


def _heads(leaves: pa.Array, whole: pa.Array) -> pa.Array:
    return pa.array([levels(_digests(x), w)[-1].tobytes().decode() for x, w in zip(leaves.to_pylist(), whole.to_pylist(), strict=True)], pa.string())


def _all_siblings(leaves: pa.Array, whole: pa.Array) -> pa.Array:
    found = [siblings(levels(_digests(x), w)) for x, w in zip(leaves.to_pylist(), whole.to_pylist(), strict=True)]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(found))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with __qt_slot, the place in the group from 0, and __qt_n, the rows of the group.

    Rows are sorted by ranges of (group, order) and written; a slot is the place in the range plus the rows of the group in earlier ranges.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("__qt_part"), F.monotonically_increasing_id().alias("__qt_place")))
    counts = dealt.groupBy(group, "__qt_part").agg(F.count("*").alias("__qt_m"), F.min("__qt_place").alias("__qt_first"))
    parts = Window.partitionBy(group)  # a row for each range of the group
    earlier = parts.orderBy("__qt_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select(group, "__qt_part", (F.coalesce(F.sum("__qt_m").over(earlier), F.lit(0)) - F.col("__qt_first")).alias("__qt_shift"), F.sum("__qt_m").over(parts).alias("__qt_n")))
    return dealt.join(counts, [group, "__qt_part"]).withColumn("__qt_slot", F.col("__qt_place") + F.col("__qt_shift")).drop("__qt_part", "__qt_place", "__qt_shift")


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all nodes with the proof up to their group's root, as __qt_left, __qt_right and __qt_root; a row for each block of the lowest round, with the same from its head on).

    nodes: __qt_group, __qt_slot, __qt_n, __qt_digest and __qt_row, a struct that is carried along.
    """
    small_batches(nodes.sparkSession, BLOCKS)
    size = FANOUT**LEVELS
    member = F.struct("__qt_slot", "__qt_digest", "__qt_row")
    blocks = nodes.groupBy("__qt_group", F.expr(f"__qt_slot div {size}").alias("__qt_block")).agg(F.first("__qt_n").alias("__qt_n"), F.array_sort(F.collect_list(member), lambda a, b: (a["__qt_slot"] - b["__qt_slot"]).cast("int")).alias("__qt_members"))
    text, whole = F.array_join(F.transform("__qt_members", lambda m: m["__qt_digest"]), ""), F.col("__qt_n") <= size
    blocks = cut(blocks.withColumn("__qt_head", F.arrow_udf(_heads, T.StringType())(text, whole)))
    heads = blocks.select("__qt_group", F.col("__qt_block").alias("__qt_slot"), F.expr(f"(__qt_n + {size - 1}) div {size}").alias("__qt_n"), F.col("__qt_head").alias("__qt_digest"), F.struct(F.lit(0)).alias("__qt_row"))
    none = F.array().cast("array<string>")
    if (heads.agg(F.max("__qt_n")).first()[0] or 0) > 1:
        above = climb(heads)[0]
    else:
        above = heads.select("*", none.alias("__qt_left"), none.alias("__qt_right"), F.col("__qt_digest").alias("__qt_root"))
    above = cut(above.select("__qt_group", F.col("__qt_slot").alias("__qt_block"), F.col("__qt_n").alias("__qt_blocks"), "__qt_left", "__qt_right", "__qt_root"))
    each = blocks.drop("__qt_head").join(above, ["__qt_group", "__qt_block"]).withColumn("__qt_pairs", F.explode(F.arrays_zip("__qt_members", F.arrow_udf(_all_siblings, PROOFS)(text, whole).alias("__qt_near"))))
    near, row = F.col("__qt_pairs.__qt_near"), F.col("__qt_pairs.__qt_members")
    sides = [F.concat(near[side], F.col(f"__qt_{side}")).alias(f"__qt_{side}") for side in ("left", "right")]
    done = each.select("__qt_group", "__qt_block", row["__qt_slot"].alias("__qt_slot"), "__qt_n", row["__qt_digest"].alias("__qt_digest"), row["__qt_row"].alias("__qt_row"), *sides, "__qt_root")
    return done, above


def manifest(rows: DataFrame, group: str = "source", key: str = "doc_id", digest: str = "leaf") -> DataFrame:
    """rows with subroot, root and proof: for each level up to the root the digests left and right of the row's ancestor, an array of (left, right).

    digest: the column of leaves, as leaf() makes them. Columns beside these are carried along, so they should be few and short.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    # Null first: a text in front of every other one, so the group needs no null-safe joins.
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = cut(rows.select(named.alias("__qt_group"), F.col(f"`{key}`").alias("__qt_key"), F.col(f"`{digest}`").alias("__qt_digest"), F.monotonically_increasing_id().alias("__qt_at"), carried.alias("__qt_row")))
    done, blocks = climb(numbered(leaves, "__qt_group", ["__qt_key", "__qt_digest", "__qt_at"]).drop("__qt_key", "__qt_at"))
    roots = blocks.filter("__qt_block = 0").select(F.lit("").alias("__qt_group"), F.col("__qt_group").alias("__qt_name"), F.col("__qt_root").alias("__qt_digest"), F.struct(F.col("__qt_group").alias("name"), F.col("__qt_blocks").alias("blocks")).alias("__qt_row"))
    tops, _ = climb(numbered(roots, "__qt_group", ["__qt_name"]).drop("__qt_name"))
    tops = cut(tops.select(F.col("__qt_row.name").alias("__qt_group"), F.col("__qt_row.blocks").alias("__qt_blocks"), F.col("__qt_left").alias("__qt_l"), F.col("__qt_right").alias("__qt_r"), F.col("__qt_root").alias("__qt_top")))
    # A group's part of the proof goes to its blocks, which are few; a group may have a third of them.
    ends = join_hot(blocks.select("__qt_group", "__qt_block"), tops, ["__qt_group"], "__qt_blocks")
    proof = F.arrays_zip(F.concat("__qt_left", "__qt_l").alias("left"), F.concat("__qt_right", "__qt_r").alias("right"))
    return done.join(ends, ["__qt_group", "__qt_block"]).select("__qt_row.*", F.col("__qt_root").alias("subroot"), F.col("__qt_top").alias("root"), proof.alias("proof"))


def proof_digest(proof: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf gives with its proof."""
    return F.aggregate(proof, digest, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def dataset_leaves(df: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and claim: the leaf of the row as tampered with, where 2 divides the checksum of its doc_id: the text without line ends."""
    r = renamed(df, doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    original = leaf(*fields, F.col("text"))
    return r.select("doc_id", "source", original.alias("leaf"), F.when(tampered & F.contains("text", F.lit("\n")), leaf(*fields, F.replace("text", F.lit("\n"), F.lit("")))).otherwise(original).alias("claim"))
