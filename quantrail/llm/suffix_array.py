"""Repeated passages by a sparse suffix array over content-selected positions.

Of each document's suffixes only those at minimiser positions are kept: in every window of consecutive k-word runs the one
with the least hash. Two copies of a passage of at least `least` = window + k - 1 words keep the same positions.

Sort and compare: the kept suffixes are range-partitioned and sorted by the name of their first k words, then text, place
and document, and each is compared with its neighbours. One without a neighbour that begins alike is dropped. Ties are part of
the order, so a beginning that a third of the corpus shares is spread over many ranges; the groups at the borders of ranges,
two for each range, are counted afterwards. Groups too large for a worker are marked wide.

Extend: a suffix and its neighbours are extended left and right, to the runs of `least` words for which its position was
selected. Copies of a run have selected the same position, so they are in the same group of neighbours: a group is sorted
by its runs' names and equal neighbours make a repeated run. The runs of wide groups are compared by counts merged before
the shuffle. Overlapping repeated runs of a document form a passage, of any length.

A passage's first copy, in the order of document key and position, is marked; the other copies may be cut.

Defined results: null, empty and short texts have no passages; rows of equal key and text count as one document; null keys
come first; a passage that repeats within a document counts too.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import FEW_ROWS, cut, discard, join_hot, renamed, sieve, sifted, small_batches
from .words import runs, word_hashes

#: Words of a beginning, and windows of beginnings: passages of 51 words or more are found.
RUN, WINDOW = 12, 40
LEAST = RUN + WINDOW - 1
#: Suffixes of one group that a worker compares in memory; a larger group is wide.
GROUP = 20_000
#: Runs that a worker compares at a time, about.
COMPARED = 2_000_000

PASSAGE, SPAN = ("start_word", "end_word"), ("start_word", "end_word", "start", "end")
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def _spans_type(places: tuple[str, ...], key: T.DataType) -> T.ArrayType:
    """An array of (places, first, source_id), the last of the key's own type."""
    return T.ArrayType(T.StructType([*(T.StructField(c, T.IntegerType()) for c in places), T.StructField("first", T.BooleanType()), T.StructField("source_id", key)]))


def minimisers(hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, names, first window, windows) of the kept suffixes: in each window the last of its least runs.

    The windows that select a position follow each other.
    """
    names = runs(hashes, k)
    if len(names) < window:
        none = np.zeros(0, np.int64)
        return none, names[:0], none, none
    # The upper half of a name, then the distance from the end: the minimum tells the position, and of equal names the last.
    low = np.uint64(0xFFFFFFFF)
    least = (names & ~low) | (low - np.arange(len(names), dtype=np.uint64))
    size = 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: size - window], least[window - size :])
    at = (low - (least & low)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return at[first], names[at[first]], first, np.diff(np.append(first, len(at)))


def _kept(k: int, window: int, doc: pa.DataType):
    """name, th, place, doc of the kept suffixes. A place is a position, how far before it its first window begins, and its windows less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minimisers(word_hashes(t), k, window) for t in batch.column("text").to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            at, names, first, count = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
            place = (at << 16) | ((at - first) << 8) | (count - 1)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), batch.column("th").take(owner), pa.array(place), batch.column("doc").take(owner).cast(doc)], ["name", "th", "place", "doc"])

    return run


def _same(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first equals the one before it; nulls are equal."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a, b = column[:-1], column[1:]
    return pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _neighbours(most: int):
    """Compares each suffix of a sorted range with its neighbours and keeps those with one that begins alike.

    Of exact copies of a text, neighbours at the same place, the first stands for all. At most `most` rows and a batch are held.
    """

    def marked(rows: pa.Table, keep: np.ndarray, wide: np.ndarray, border: np.ndarray) -> Iterator[pa.RecordBatch]:
        if keep.any():
            name = pc.if_else(pa.array(border), rows.column("name"), pa.scalar(None, pa.int64()))
            out = rows.select(["doc", "th", "place"]).append_column("wide", pa.array(wide)).append_column("border", name).filter(pa.array(keep))
            yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the group that may go on
        first, large = True, False  # whether it is the first of the range; whether it is known to be large
        for batch in itertools.chain(batches, [None]):
            parts = [*([held] if held is not None else []), *([pa.Table.from_batches([batch])] if batch is not None else [])]
            rows = pa.concat_tables(parts).combine_chunks() if parts else None
            if rows is None or not len(rows):
                continue
            equal = np.append(False, _same(rows.column("name")))
            copy = equal & np.append(False, _same(rows.column("th")) & _same(rows.column("place")))
            group = np.cumsum(~equal) - 1
            sizes = np.bincount(group)
            end = group == group[-1]
            wide = (sizes > most)[group] | (large & (group == 0))
            border = (first & (group == 0)) | (end if batch is None else False)
            keep = ~copy & (border | wide | (sizes > 1)[group])
            if batch is None:
                yield from marked(rows, keep, wide, border)
                break
            yield from marked(rows, keep & ~end, wide, border)
            held = rows.filter(pa.array(end))
            if group[-1]:
                first = large = False
            if len(held) > most:
                # All but the last row go; that one tells the border, if the group reaches it, that the group is large.
                size = len(held) - 1
                yield from marked(held.slice(0, size), ~copy[end][:size], np.ones(size, bool), np.full(size, first))
                held, large = held.slice(size), True

    return run


def _extended(k: int, least: int, doc: pa.DataType):
    """The suffixes of each document, extended left and right: the names of their runs of `least` words, from the first one at `lo`."""
    names_of = ["name", "doc", "th", "lo", "copied", "wide", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("places")
            place, wide = (found.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
            sizes = found.value_lengths().to_numpy()
            at, back, count = place >> 16, (place >> 8) & 255, (place & 255) + 1
            lo = at - back
            name, long, end = [], [], np.cumsum(sizes)
            for text, e, size in zip(batch.column("text").to_pylist(), end, sizes, strict=True):
                mine, h = slice(e - size, e), word_hashes(text)
                name.append(runs(h, k)[at[mine]])
                n = count[mine]
                long.append(runs(h, least)[np.repeat(lo[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            flat = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array((np.concatenate(long) if long else np.zeros(0, np.uint64)).view(np.int64)))
            columns = [pa.array((np.concatenate(name) if name else np.zeros(0, np.uint64)).view(np.int64)), batch.column("doc").take(owner).cast(doc), batch.column("th").take(owner), pa.array(lo.astype(np.int32)), batch.column("copied").take(owner), pa.array(wide.astype(bool)), flat]
            yield pa.RecordBatch.from_arrays(columns, names_of)

    return run


def _segments(rows: pa.Table) -> pa.RecordBatch:
    """Equal neighbours among the sorted runs of whole groups, as stretches of runs of one document and one standing."""
    lists = rows.column("runs").combine_chunks()
    flat, count = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    owner = np.repeat(np.arange(len(count)), count)
    start = rows.column("lo").to_numpy()[owner] + np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
    copied = rows.column("copied").to_numpy()[owner]
    order = np.argsort(flat, kind="stable")  # of equal runs the first is that of the least document and position
    new = np.append(True, flat[order][1:] != flat[order][:-1])
    group = np.cumsum(new) - 1
    origin = order[np.flatnonzero(new)]
    several = (np.bincount(group) > 1) | (np.maximum.reduceat(copied[order], np.flatnonzero(new)) if len(flat) else np.zeros(0, bool))
    repeated, first, source = np.zeros(len(flat), bool), np.zeros(len(flat), bool), np.zeros(len(flat), np.int64)
    repeated[order], source[order], first[origin] = several[group], owner[origin[group]], True
    state = np.where(first, -1, source)
    begins = repeated & np.append(True, (owner[1:] != owner[:-1]) | (state[1:] != state[:-1]) | ~repeated[:-1])
    ends = repeated & np.append((owner[1:] != owner[:-1]) | (state[1:] != state[:-1]) | ~repeated[1:], True)
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    at = pa.array(owner[a])
    docs = rows.column("doc").combine_chunks()
    columns = [docs.take(at), rows.column("th").combine_chunks().take(at), pa.array(start[a].astype(np.int32)), pa.array(start[b].astype(np.int32)), pa.array(first[a]), docs.take(pa.array(source[a]))]
    return pa.RecordBatch.from_arrays(columns, ["doc", "th", "a", "b", "first", "source"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the runs of some whole groups at a time; rows are sorted by name, document and position."""
    held: pa.Table | None = None
    size = 0
    for batch in batches:
        mine = pa.Table.from_batches([batch])
        held = mine if held is None else pa.concat_tables([held, mine]).combine_chunks()
        again = np.logical_and.reduce([_same(held.column(c)) for c in ("name", "doc", "th", "lo")])  # repeated rows
        held = held.filter(pa.array(~np.append(False, again))) if len(held) else held
        size += len(batch.column("runs").flatten())
        if size > COMPARED:
            held = held.combine_chunks()
            other = np.flatnonzero(~_same(held.column("name")))
            if len(other):
                end = int(other[-1]) + 1
                yield _segments(held.slice(0, end).combine_chunks())
                held = held.slice(end)
                size = pc.sum(pc.list_value_length(held.column("runs"))).as_py()
    if held is not None and len(held):
        yield _segments(held.combine_chunks())


def _united(least: int, key: T.DataType):
    """Unites stretches of runs into passages: overlapping ones of equal standing."""

    @F.pandas_udf(_spans_type(PASSAGE, key))
    def run(found: pd.Series) -> pd.Series:
        out = []
        for rows in found:
            spans: list[list] = []
            for first in (True, False):
                mine: list[list] = []
                for r in sorted((r for r in rows if bool(r["first"]) is first), key=lambda r: (r["a"], r["b"])):
                    if mine and r["a"] <= mine[-1][1]:
                        mine[-1][1] = max(mine[-1][1], r["b"] + least)
                    else:
                        mine.append([r["a"], r["b"] + least, first, r["source"]])
                spans += mine
            out.append([tuple(s) for s in sorted(spans, key=lambda s: (s[0], s[2]))])
        return pd.Series(out, dtype=object)

    return run


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = RUN, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """key, text_hash, passages: array<struct<start_word, end_word, first, source_id>> for the documents that have any.

    `first` marks words of which this is the first copy; `source_id` is the key of the document with the first copy of a
    passage's first run. A window is at most 256.
    """
    small_batches(df.sparkSession, FEW_ROWS)
    least = k + window - 1
    docs = renamed(df, doc=key, text=text).filter("text IS NOT NULL").withColumn("th", F.xxhash64("text"))
    kind = docs.schema["doc"].dataType
    doc, doc_type = f"doc {kind.simpleString()}", to_arrow_type(kind)
    # Of equal texts the one with the least key stands for the others.
    equal = docs.groupBy("th").agg(F.min(F.struct("doc")).alias("a"), F.max(F.struct("doc")).alias("b"), F.count("*").alias("n")).filter(F.col("a") != F.col("b"))
    equal = cut(equal.select("th", F.col("a.doc").alias("rep"), "n"))
    copies = cut(join_hot(docs.select("doc", "th"), equal, ["th"], "n").distinct())

    kept = cut(docs.mapInArrow(_kept(k, window, doc_type), f"name long, th long, place long, {doc}"))
    order = ["name", "th", "place", "doc"]
    seeds = cut(kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(group), f"{doc}, th long, place long, wide boolean, border long"))
    discard(kept)
    # A group that a border cuts is wide if one of its parts is, or all together are too large: two names for each range.
    sizes = seeds.filter("border IS NOT NULL").groupBy("border").agg((F.max("wide") | (F.count("*") > group)).alias("far"))

    of = copies.select(F.col("doc").alias("d"), F.col("th").alias("t"), "rep")
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    marks = seeds.join(F.broadcast(sizes), "border", "left").withColumn("wide", F.coalesce("far", "wide"))
    places = marks.groupBy("doc", "th").agg(F.collect_set(F.struct("place", "wide")).alias("places"))  # one document's
    places = places.join(of, same, "left").filter("d IS NULL AND t IS NULL OR d <=> rep")
    places = places.select(F.col("doc").alias("d"), F.col("th").alias("t"), "places", F.col("t").isNotNull().alias("copied"))
    places = cut(places)
    few, _ = sifted(docs, "th", sieve(places, "t"))
    moved = few.join(places, same).select("doc", "th", "copied", "places", "text")
    extended = cut(moved.mapInArrow(_extended(k, least, doc_type), f"name long, {doc}, th long, lo int, copied boolean, wide boolean, runs array<long>"))
    discard(seeds, places)

    segment = f"{doc}, th long, a int, b int, first boolean, source {kind.simpleString()}"
    near = extended.filter("NOT wide").select("name", "doc", "th", "lo", "copied", "runs")
    near = near.repartition("name").sortWithinPartitions("name", "doc", "th", "lo").mapInArrow(_compared, segment)
    wide = extended.filter("wide").select("doc", "th", "lo", "copied", F.posexplode("runs").alias("i", "run")).select("run", "copied", F.struct("doc", "th", (F.col("lo") + F.col("i")).alias("at")).alias("x"))
    best = cut(wide.groupBy("run").agg(F.min("x").alias("p"), F.max("x").alias("q"), F.max("copied").alias("c"), F.count("*").alias("n")).filter("p <> q OR c").select("run", "p", "n"))
    far = join_hot(wide, best, ["run"], "n").select("x.doc", "x.th", F.col("x.at").alias("a"), F.col("x.at").alias("b"), (F.col("x") == F.col("p")).alias("first"), F.col("p.doc").alias("source"))
    segments = cut(near.union(far))
    discard(extended, best)

    found = segments.groupBy("doc", "th").agg(F.collect_set(F.struct("a", "b", "first", "source")).alias("found"))
    found = cut(found.select("doc", "th", _united(least, kind)("found").alias("passages")))
    # A later copy of a whole text is one passage of all its words, which the first copy's passages end with.
    later = copies.filter(~F.col("doc").eqNullSafe(F.col("rep"))).select("doc", "th", F.col("rep").alias("source"))
    words = found.select("th", F.array_max(F.transform("passages", lambda p: p["end_word"])).alias("n_words")).groupBy("th").agg(F.max("n_words").alias("n_words"))
    words = cut(words.join(equal.select("th", "n"), "th"))
    whole = join_hot(later, words, ["th"], "n").select("doc", "th", F.array(F.struct(F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), F.lit(False).alias("first"), F.col("source").alias("source_id"))).alias("passages"))
    return found.union(whole).select(F.col("doc").alias(key), F.col("th").alias("text_hash"), "passages")


def _spans(passages, text: str) -> list[tuple]:
    """The passages with their code points."""
    words = [m.span() for m in WORD.finditer(text)]
    return [(p["start_word"], p["end_word"], words[p["start_word"]][0], words[p["end_word"] - 1][1], p["first"], p["source_id"]) for p in passages]


def _placed(texts: pd.Series, passages: pd.Series) -> pd.Series:
    return pd.Series([_spans(p, t) for t, p in zip(texts, passages, strict=True)], dtype=object)


def _with_passages(df: DataFrame, key: str, text: str, k: int, window: int, how: str, only=None) -> DataFrame:
    """df with __qt_passages, joined by key and text."""
    found = repeated_passages(df, key, text, k, window)
    found = cut(found if only is None else found.filter(only))
    found = found.select(F.col(f"`{key}`").alias("__qt_key"), F.col("text_hash").alias("__qt_th"), F.col("passages").alias("__qt_passages"))
    rows = df.withColumn("__qt_text", F.xxhash64(F.col(f"`{text}`")))
    few, rest = sifted(rows, "__qt_text", sieve(found, "__qt_th"))
    out = few.join(found, F.col(f"`{key}`").eqNullSafe(F.col("__qt_key")) & (F.col("__qt_text") == F.col("__qt_th")), how)
    return out if how == "inner" else out.unionByName(rest, allowMissingColumns=True)


def passage_rows(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = RUN, window: int = WINDOW) -> DataFrame:
    """One row for each passage: key, start_word, end_word, start, end (code points), first, source_id."""
    found = _with_passages(renamed(df, **{key: key, text: text}), key, text, k, window, "inner")
    return found.select(F.col(f"`{key}`"), F.explode(F.pandas_udf(_placed, _spans_type(SPAN, df.schema[key].dataType))(F.col(f"`{text}`"), "__qt_passages")).alias("p")).select(F.col(f"`{key}`"), "p.*").distinct()


def without_repeats(text: str, passages: list) -> str:
    """The text without the words of later copies; what is left stays as it stood."""
    out, done = [], 0
    for _, _, start, end, first, _ in sorted(_spans(passages, text), key=lambda p: p[2:4]):
        if not first:
            out.append(text[done:start] if start > done else "")
            done = max(done, end)
    return "".join([*out, text[done:]])


@F.pandas_udf(T.StringType())
def _cut_text(texts: pd.Series, passages: pd.Series) -> pd.Series:
    return pd.Series([t if p is None else without_repeats(t, p) for t, p in zip(texts, passages, strict=True)], dtype=object)


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = RUN, window: int = WINDOW) -> DataFrame:
    """df, every row, with the later copies of repeated passages cut from its text."""
    out = _with_passages(df, key, text, k, window, "left", F.exists("passages", lambda p: ~p["first"]))
    return out.withColumn(text, F.when(F.col("__qt_passages").isNull(), F.col(f"`{text}`")).otherwise(_cut_text(F.col(f"`{text}`"), "__qt_passages"))).select(*[F.col(f"`{c}`") for c in df.columns])
