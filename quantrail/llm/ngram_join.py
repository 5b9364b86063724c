"""Near-duplicate join on word n-grams: MinHash bands propose, full n-gram sets decide.

Documents with equal n-gram sets form a class, and classes stand for their members, so copies are never expanded.
Band and row counts follow from the target recall at the threshold. Classes meet in band buckets; buckets with the same
members count once; a large bucket is cut into blocks and each pair of blocks is a group of its own, so no task holds
an unbounded bucket. A pair is verified in the bucket of its first common band only. A block returns, for each class,
how many documents it links to and a spanning tree of the links, never the pairs.

Defined results: a null or empty text has no n-grams, and such documents are copies of each other; a text of fewer than
n words has one n-gram, all its words; repeated rows are copies; null keys are kept.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FEW_ROWS, cut, discard, join_hot, renamed, sieve, sifted, small_batches
from .words import mixed, runs, word_hashes

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Hash functions that the bands may use in all.
MOST_HASHES = 80
#: n-grams in a block of a bucket, about.
BLOCK = 400_000
#: What a member of a bucket weighs besides its n-grams: a block has at most BLOCK / MEMBER members, which bounds its matrix of pairs.
MEMBER = 200

SIGNED = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def band_shape(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands * rows stays in bounds and a pair at the threshold meets with probability `recall`."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def ngrams(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    h = word_hashes(text)
    return np.unique(runs(h, min(words, len(h)))) if len(h) else h


def constants(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:count] | np.uint64(1), seeds[count:]


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band of MinHash values."""
    a, c = constants(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 1024):
            least = np.minimum(least, (grams[at : at + 1024, None] * a + c).min(axis=0))
        band = np.arange(bands, dtype=np.uint64)
        for column in least.reshape(bands, rows).T:
            band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + column)
    return band.view(np.int64)


def _signer(words: int, bands: int, rows: int):
    @F.pandas_udf(SIGNED)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            grams = ngrams(t, words)
            out.append((hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), len(grams), signature(grams, bands, rows) if len(grams) else None))
        return pd.DataFrame(out, columns=SIGNED.names)

    return run


def _grams_of(words: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([ngrams(t, words).view(np.int64) for t in texts], dtype=object)

    return run


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right]."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left], np.int64).reshape(len(left), len(right))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    total = np.zeros((len(left), len(right)), np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        part = slice(*np.searchsorted(column, [at, at + 4096]))
        dense = np.zeros((len(sets), 4096), np.float32)
        dense[owner[part], column[part] - at] = 1
        total += dense[left] @ dense[right].T
    return total.round().astype(np.int64)


def _linked(rows: pa.Table, similarity: float) -> pa.Table:
    """Rows of one group of whole blocks: for each class with links, the documents they lead to and its tree's root."""
    part = {c: rows.column(c).to_numpy() for c in ("band", "h", "bi", "bj", "blk", "size")}
    keys = rows.column("key").to_pylist()
    grams = rows.column("grams").combine_chunks()
    values, at = grams.flatten().to_numpy(), np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy())])
    bands = rows.column("bands").combine_chunks()
    bands = bands.flatten().to_numpy().reshape(len(keys), -1) if len(keys) else np.zeros((0, 1), np.int64)
    order = np.lexsort((part["bj"], part["bi"], part["h"], part["band"]))
    same = np.ones(len(order), bool)
    for c in ("band", "h", "bi", "bj"):
        same[1:] &= part[c][order][1:] == part[c][order][:-1]
    out: list[tuple[bytes, int, bytes | None]] = []
    for group in np.split(order, np.nonzero(~same[1:])[0] + 1) if len(order) else []:
        bi, bj, band = part["bi"][group[0]], part["bj"][group[0]], part["band"][group[0]]
        left = np.nonzero(part["blk"][group] == bi)[0]
        right = np.nonzero(part["blk"][group] == bj)[0]
        if not len(left) or not len(right) or len(group) < 2:
            continue
        mine = bands[group]
        own = np.ones((len(left), len(right)), bool)
        for b in range(band):
            own &= mine[left, b][:, None] != mine[right, b][None, :]
        if bi == bj:
            own &= left[:, None] < right[None, :]
        if not own.any():
            continue
        sets = [values[at[g] : at[g + 1]] for g in group]
        count = np.array([len(s) for s in sets], np.int64)
        common = _common(sets, left, right)
        union = count[left][:, None] + count[right][None, :] - common
        i, j = np.nonzero(own & (common >= similarity * union - 1e-9))
        i, j = left[i], right[j]
        size = part["size"][group]
        links = np.zeros(len(group), np.int64)
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        root = list(range(len(group)))

        def find(x: int, root: list[int] = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        for g in np.nonzero(links)[0].tolist():
            r = find(g)
            out.append((keys[group[g]], int(links[g]), None if r == g else keys[group[r]]))
    return pa.table({"key": pa.array([o[0] for o in out], pa.binary()), "links": pa.array([o[1] for o in out], pa.int64()), "other": pa.array([o[2] for o in out], pa.binary())})


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for edges (a, b), by alternating large and small stars (Kiveris et al., 2014), until nothing changes.

    The middle of a large star is a frequent key: its least neighbour is found by partial minima and sent to its edges by join_hot.
    """
    edges = cut(edges.filter("a <> b").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before, now = None, state(edges)
    while now != before and now[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
        large = cut(join_hot(both, least, ["a"], "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct())
        nearest = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_hot(large, nearest, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").union(nearest.select("a", F.col("m").alias("b")))
        old, edges = edges, cut(small.distinct())
        discard(old, least, large, nearest)
        before, now = now, state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row for each row of df: key, class_id (least key of its near-duplicate group), n_links (rows that it resembles), copy_key (equal n-gram sets), keeps (it is the least of its group), text_hash."""
    spark = df.sparkSession
    small_batches(spark, FEW_ROWS)
    bands, rows = band_shape(similarity, recall)
    docs = renamed(df, doc=key, text=text).withColumn("th", F.xxhash64("text"))
    signed = cut(docs.select("doc", "th", _signer(words, bands, rows)("text").alias("s")).select("doc", "th", "s.*"))
    classes = cut(signed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("doc", "th")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    placed = classes.filter("n > 0").select("key", "n", F.posexplode("bands").alias("band", "h"))
    # Most buckets hold one class: a count alone leaves them out before anything else is added up.
    several = cut(placed.groupBy("band", "h").agg(F.count("*").alias("c")).filter("c > 1"))
    met = cut(join_hot(placed, several, ["band", "h"], "c"))
    buckets = met.groupBy("band", "h").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"), F.sum((F.col("n") + MEMBER).cast("long")).alias("weight"))
    # Buckets of equal members, known by count and two hashes, count once, as the one of the least band.
    buckets = cut(buckets.groupBy("c", "x", "y").agg(F.min(F.struct("band", "h")).alias("b"), F.first("weight").alias("weight")).select("b.*", "weight", "c"))
    members = cut(join_hot(met, buckets, ["band", "h"], "c").select("key", "band", "h", "weight"))
    discard(several, met, buckets)

    wanted = cut(members.select("key").distinct().join(classes, "key").select("key", "rep.doc", "rep.th", "size", "bands"))
    few, _ = sifted(docs, "th", sieve(wanted, "th"))
    texts = wanted.join(few, wanted["doc"].eqNullSafe(few["doc"]) & (wanted["th"] == few["th"]))
    sets = texts.select("key", "size", "bands", _grams_of(words)(few["text"]).alias("grams")).dropDuplicates(["key"])

    total = members.agg(F.sum("weight"), F.count("*")).first()
    # Small buckets share groups of about BLOCK n-grams; each pair of blocks of a large one has its own.
    shared = max(1, math.ceil((members.select("band", "h", "weight").distinct().agg(F.sum("weight")).first()[0] or 0) / BLOCK)) if total[1] else 1
    blocks = F.greatest(F.lit(1), F.ceil(F.col("weight") / F.lit(BLOCK))).cast("int")
    put = members.join(sets, "key").withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    put = put.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"bi": F.least("o", "blk"), "bj": F.greatest("o", "blk")})
    put = put.withColumn("group", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("band", "h"), F.lit(shared))).otherwise(F.xxhash64("band", "h", "bi", "bj")))
    put = put.select("group", "band", "h", "bi", "bj", "blk", "size", "key", "bands", "grams")
    found = cut(put.groupBy("group").applyInArrow(lambda t: _linked(t, similarity), "key binary, links long, other binary"))

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    known = classes.select("key", "size", "rep").join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    known = cut(known.withColumn("root", F.coalesce("root", "key")))
    discard(members, found)
    least = cut(known.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("n")))
    done = cut(join_hot(known, least, ["root"], "n").select("key", "size", "least", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    discard(classes, known, least)
    # A third of all rows can be copies of one text: its class then goes to them, not they to it.
    out = join_hot(signed.select("doc", "th", "key"), done, ["key"], "size")
    return out.select(F.col("doc").alias(key), F.col("least.doc").alias("class_id"), "n_links", F.hex("key").alias("copy_key"), (F.struct("doc", "th") == F.col("least")).alias("keeps"), F.col("th").alias("text_hash"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """df without near duplicates: of each group the row with the least key (then text hash) stays; of its equal rows, one."""
    found = near_duplicates(df, key, text, words, similarity, recall)
    named = F.xxhash64(F.col(f"`{key}`"))  # never null, so that null keys join
    marks = found.groupBy(named.alias("__qt_named"), F.col("text_hash").alias("__qt_hash")).agg(F.max("keeps").alias("__qt_keeps"), F.count("*").alias("__qt_n"))
    # Rows that stay as they are need no join: only those that go, and repeated rows, are looked up.
    special = cut(marks.filter("NOT __qt_keeps OR __qt_n > 1"))
    both = F.xxhash64("__qt_named", "__qt_hash")
    rows = df.withColumns({"__qt_named": named, "__qt_hash": F.xxhash64(F.col(f"`{text}`"))}).withColumn("__qt_both", both)
    some, rest = sifted(rows, "__qt_both", sieve(special.select(both.alias("__qt_both")), "__qt_both"))
    again = special.filter("__qt_keeps")
    once = some.join(special.select("__qt_named", "__qt_hash"), ["__qt_named", "__qt_hash"], "left_anti")
    several = some.join(again.select("__qt_named", "__qt_hash"), ["__qt_named", "__qt_hash"], "left_semi").dropDuplicates(["__qt_named", "__qt_hash"])
    return functools.reduce(DataFrame.union, [d.select(*[F.col(f"`{c}`") for c in df.columns]) for d in (rest, once, several)])
