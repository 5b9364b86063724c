"""Exact top-k inner-product search by the three-phase uniform threshold.

A vector's components are cut into parts, and each part of all vectors is a score list: a score is the sum of its local
scores. Equal vectors are one entry that knows its least ids, so copies cost nothing. Part lists lie in blocks of rows, and a
block meets a block of queries in a task of its own.

Phase one gathers, for each query, the k best entries of every local list; these are scored exactly, and the k-th best score is a
safe cutoff, for k rows reach it. Phase two sends the cutoff to every list, which collects its entries that reach an even
share of it: a row that stays below the share in every list stays below the cutoff. An entry is sufficient only if its local
score, with the most that the other parts' lengths allow, can reach the cutoff. Phase three resolves the remaining scores of
collected rows exactly: the pairs, not the vectors, go back to the lists that have not sent them.

Defined results: vectors that are null, or hold null or non-finite components, and rows without an id take no part;
missing trailing components count as zero; ties go to the smaller id; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_hot, renamed

#: Rows of a block, queries of a block, and queries scored at a time.
ROWS, QUERIES, TILE = 4096, 2048, 256
#: Score lists.
PARTS = 2
NONE = -(1 << 62)


def quantised(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """row, id, v = floor(scale * component) as longs, for the rows that take part. A key of whole numbers becomes a long, another one stays."""
    df = renamed(df, id=key, v=vector)
    whole = dict(df.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    df = df.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(~bad)
    return df.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long") if whole else F.col("id"), F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def asks(rows: DataFrame, every: int) -> DataFrame:
    """The queries among rows: those whose id is divisible, or, of an id that is no whole number, whose checksum is."""
    id_ = F.col("id") if dict(rows.dtypes)["id"] == "bigint" else F.crc32(F.col("id").cast("string").cast("binary"))
    return rows.filter(id_ % every == 0)


def distinct_vectors(rows: DataFrame, k: int, every: int) -> DataFrame:
    """v, row (one of its rows), members (the k + 1 rows of least id, with it), asked (how many queries have it)."""
    order = Window.partitionBy("v").orderBy("id", "row")  # of a frequent vector, every task sends its k + 1 first rows alone
    first = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    members = first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("members"))
    asked = asks(rows, every).groupBy("v").agg(F.count("*").alias("asked"))
    return members.join(asked, "v", "left").select("v", F.col("members")[0]["row"].alias("row"), "members", F.coalesce("asked", F.lit(0)).alias("asked"))


def inner_product(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, zero)), zero, lambda s, x: s + x)


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where every sum stays below 2^53."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
    return a.astype(kind) @ b.astype(kind).T


def tiles(queries: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Queries, their local scores, and which pairs are a vector with itself."""
    width = max([*map(len, queries.v), *map(len, rows.v)], default=0)
    b, own = matrix(rows.v, width), rows.row.to_numpy()
    for at in range(0, len(queries), TILE):
        tile = queries.iloc[at : at + TILE]
        yield tile, products(matrix(tile.v, width), b), tile.row.to_numpy()[:, None] == own[None, :]


def heads(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Phase one in a block: the k best entries of a local list."""
    out = []
    for tile, p, own in tiles(queries, rows):
        p = np.where(own, NONE, p)
        columns = np.argpartition(p, -min(k, p.shape[1]), axis=1)[:, -k:] if p.shape[1] else np.zeros((len(tile), 0), int)
        i = np.arange(len(tile))[:, None]
        good = ~own[i, columns]
        out.append(pd.DataFrame({"row": np.repeat(tile.row.to_numpy(), good.sum(axis=1)), "other": rows.row.to_numpy()[columns][good], "local": p[i, columns][good].astype(np.int64)}))
    return pd.concat(out, ignore_index=True).assign(part=queries.part.iloc[0])[["row", "other", "part", "local"]] if out else pd.DataFrame(columns=["row", "other", "part", "local"]).astype("int64")


def sufficient(queries: pd.DataFrame, rows: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Phase two in a block: the entries of a local list that reach an even share of the cutoff and can reach it in all."""
    out = []
    part = int(queries.part.iloc[0])
    there = np.stack(rows["size"].to_numpy())
    for tile, p, own in tiles(queries, rows):
        cutoff = tile.cutoff.to_numpy()[:, None]
        found = (parts * p >= cutoff) & ~own
        if found.any():
            # Cauchy and Schwarz: no other part adds more than the product of both lengths.
            here = np.stack(tile["size"].to_numpy())
            most = sum(np.outer(here[:, j], there[:, j]) for j in range(parts) if j != part)
            found &= (p + most) * (1 + 1e-9) + 1 >= cutoff
        i, c = np.nonzero(found)
        out.append(pd.DataFrame({"row": tile.row.to_numpy()[i], "other": rows.row.to_numpy()[c], "part": part, "local": p[i, c].astype(np.int64)}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["row", "other", "part", "local"]).astype("int64")


def _met(f, _key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    if not len(queries) or not len(rows):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "other", "part", "local")})
    return f(queries, rows.rename(columns={"crow": "row", "cv": "v", "csize": "size"}))


def remaining(pairs: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
    """Phase three in a block: the local scores of the pairs that a list has not sent, by looking their rows up."""
    queries, rows = (slices[slices.side == side] for side in (0, 1))
    width = max(map(len, slices.v), default=0)
    at = [pd.Index(t.row).get_indexer(pairs[c]) for t, c in ((queries, "row"), (rows, "other"))]
    a, b = matrix(queries.v, width), matrix(rows.v, width)
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, width)
    if most >= 1 << 62:
        a, b = a.astype(object), b.astype(object)
    local = [(a[at[0][i : i + 50_000]] * b[at[1][i : i + 50_000]]).sum(axis=1) for i in range(0, len(pairs), 50_000)]
    return pairs[["row", "other", "part"]].assign(local=np.concatenate(local).astype(np.int64) if local else np.zeros(0, np.int64))


def _looked_up(_key, pairs: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
    if not len(pairs):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "other", "part", "local")})
    return remaining(pairs, slices)


def search(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, parts: int = PARTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that take part; distinct vectors; row, other, score for the pairs of distinct vectors that phase two collects)."""
    rows = cut(quantised(df, key, vector, scale))
    vectors = cut(distinct_vectors(rows, k, every))
    s = vectors.agg(F.count("*"), F.count(F.when(F.col("asked") > 0, 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    row_blocks, query_blocks, width = -(-s[0] // ROWS) or 1, -(-s[1] // QUERIES) or 1, -(-s[2] // parts) or 1

    def block(blocks: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")

    def every_one(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    slices = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * width + 1, F.lit(width)))
    length = F.transform("__s", lambda s: F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))))
    cutting = vectors.withColumn("__s", slices).withColumn("size", length).select("row", "asked", "size", F.posexplode("__s").alias("part", "v"))
    queries = cutting.filter("asked > 0").withColumn("qb", block(query_blocks)).withColumn("rb", every_one(row_blocks)).drop("asked")
    placed = cutting.withColumn("crb", block(row_blocks)).withColumn("cqb", every_one(query_blocks))
    placed = placed.select("cqb", "crb", F.col("part").alias("cpart"), F.col("row").alias("crow"), F.col("v").alias("cv"), F.col("size").alias("csize"))

    schema = "row long, other long, part int, local long"

    def meet(queries: DataFrame, f) -> DataFrame:
        return queries.groupBy("part", "qb", "rb").cogroup(placed.groupBy("cpart", "cqb", "crb")).applyInPandas(partial(_met, f), schema)

    asked = queries.select("part", "qb", "rb", "row", "v", F.lit(0).alias("side"))
    slices = asked.union(placed.select("cpart", "cqb", "crb", "crow", "cv", F.lit(1)))

    def exact(entries: DataFrame) -> DataFrame:
        """row, other, score of pairs that some list has sent: the other lists' local scores are looked up where both rows lie."""
        entries = cut(entries)
        sent = entries.groupBy("row", "other").agg(F.collect_set("part").alias("parts"))  # a few parts
        missing = sent.select("row", "other", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(parts - 1)), "parts")).alias("part"))
        missing = missing.withColumns({"qb": block(query_blocks), "rb": F.pmod(F.xxhash64("other"), F.lit(row_blocks)).cast("int")})
        got = missing.groupBy("part", "qb", "rb").cogroup(slices.groupBy("part", "qb", "rb")).applyInPandas(_looked_up, schema)
        return entries.select("row", "other", "local").union(got.select("row", "other", "local")).groupBy("row", "other").agg(F.sum("local").alias("score"))

    best = meet(queries, partial(heads, k=k)).withColumn("n", F.row_number().over(Window.partitionBy("row", "part").orderBy(F.desc("local"), "other"))).filter(F.col("n") <= k)
    known = exact(best.drop("n")).withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))).filter(F.col("n") == k)
    cutoffs = cut(known.select("row", F.col("score").alias("cutoff")))
    # A query with fewer than k other vectors has no cutoff and takes them all.
    asking = queries.join(cutoffs, "row", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(NONE).cast("long")))
    found = exact(meet(asking, partial(sufficient, parts=parts))).join(cutoffs, "row", "left").filter("cutoff IS NULL OR score >= cutoff").drop("cutoff")
    return rows, vectors, cut(found)


def top_k(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, parts: int = PARTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by `every` (of other than whole numbers: whose checksum is)."""
    rows, vectors, found = search(df, k, every, key, vector, scale, parts)
    # The rows of the best k + 1 vectors, a query's own among them, hold its k best rows.
    own = vectors.filter("asked > 0").select("row", F.col("row").alias("other"), inner_product(F.col("v"), F.col("v")).alias("score"))
    members = vectors.select(F.col("row").alias("other"), "members")
    counts = found.groupBy("other").agg(F.count("*").alias("n")).join(members, "other", "right").select("other", "members", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    ids = join_hot(cut(found.unionByName(own)), cut(counts), ["other"], "n")
    first = Window.partitionBy("row").orderBy(F.desc("score"), F.col("members")[0]["id"])
    best = ids.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    lists = best.groupBy("row").agg(F.collect_list(F.struct("score", "members")).alias("best"))  # k + 1 entries at most
    lists = cut(vectors.filter("asked > 0").select("row", "v", "asked").join(lists, "row").select("v", "best", "asked"))
    asked = asks(rows, every)
    pairs = join_hot(asked, lists, ["v"], "asked").select("row", F.col("id").alias("query_id"), F.explode("best").alias("b"))
    pairs = pairs.select("row", "query_id", "b.score", F.explode("b.members").alias("m")).filter(F.col("m.row") != F.col("row"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "m.id", "m.row")
    out = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int"), F.col("m.id").alias("vec_id"), "score")


