"""Fingerprints of documents: Merkle trees over paragraphs and sections, in DataFrame expressions alone.

A paragraph is a line, a leaf of the tree. A section ends at a blank line, or at a paragraph whose digest starts with one of a quarter of the
digits; content sets its borders, so an edit moves none but its own. A section's node is the digest of its paragraphs', the root that of
the sections'. A paragraph is also cut into phrases of some words, at borders that words set; short digests of these say how much of a
differing paragraph is left. The fingerprint is text: the root, then for each section its node and its paragraphs with their phrases.

    root|node;leaf,phrase,phrase;leaf,phrase|node;leaf,phrase

Equal roots mean equal texts. Where roots differ, equal nodes and leaves show what is left, and edits() lists the rest. likeness() is 1
for equal roots, else 2 * (distinct phrases in both) / (those of one and of the other).

Defined results: a null text is an empty one, which is one empty paragraph. A column that with_next() adds is refused if it is there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, refuse, repeatable

#: White space within a line.
GAP = r" \t\x0b\x0c\r"
#: Scripts without spaces: each of these is a word.
SIGNS = r"\x{2e80}-\x{9fff}\x{ac00}-\x{d7af}"
#: A word with the white space behind it; at a line's start, white space.
WORD = rf"[{SIGNS}][{GAP}]*|[^{GAP}{SIGNS}]+[{GAP}]*|[{GAP}]+"
#: First digits of digests that set a border: a quarter of all.
BORDER = "0123"
#: Hex digits of a phrase's digest, and of a node and a leaf in the text of a fingerprint.
PHRASE, SHORT = 6, 16
#: Between phrases while a line is cut.
MARK = "\x01"


def _phrases(line: Column) -> Column:
    """The runs of words of a line."""
    words = F.transform(F.regexp_extract_all(line, F.lit(WORD), 0), lambda w: F.when(F.substring(F.md5(w), 1, 1).isin(*BORDER), F.concat(w, F.lit(MARK))).otherwise(w))
    return F.split(F.regexp_replace(F.array_join(words, ""), f"{MARK}\\z", ""), MARK)


def _paragraph(line: Column) -> Column:
    """;leaf,phrase,phrase and | where its section ends."""
    leaf = F.sha2(line, 256)
    phrases = F.array_join(F.transform(_phrases(line), lambda p: F.concat(F.lit(","), F.substring(F.md5(p), 1, PHRASE))), "")
    ends = F.substring(leaf, 1, 1).isin(*BORDER) | (F.trim(line) == "")
    return F.concat(F.lit(";"), leaf, phrases, F.when(ends, "|").otherwise(""))


def _section(paragraphs: Column) -> Column:
    """|node;leaf,phrase: the leaves are shortened."""
    node = F.sha2(F.array_join(F.regexp_extract_all(paragraphs, F.lit(";([0-9a-f]{64})"), 1), ""), 256)
    return F.concat(F.lit("|"), node, F.regexp_replace(paragraphs, f"(;[0-9a-f]{{{SHORT}}})[0-9a-f]*", "$1"))


def fingerprint(text: Column) -> Column:
    """root|node;leaf,phrase,...;leaf,...|node;..."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    sections = F.split(F.regexp_replace(F.array_join(F.transform(lines, _paragraph), ""), r"\|\z", ""), r"\|")
    whole = F.array_join(F.transform(sections, _section), "")
    root = F.sha2(F.array_join(F.regexp_extract_all(whole, F.lit(r"\|([0-9a-f]{64})"), 1), ""), 256)
    return F.concat(root, F.regexp_replace(whole, rf"(\|[0-9a-f]{{{SHORT}}})[0-9a-f]*", "$1"))


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1."""
    phrases = [F.array_distinct(F.regexp_extract_all(x, F.lit(f",([0-9a-f]{{{PHRASE}}})"), 1)) for x in (a, b)]
    share = F.aggregate(F.array(F.struct(phrases[0].alias("a"), phrases[1].alias("b"))), F.lit(0.0), lambda _, x: 2.0 * F.size(F.array_intersect(x["a"], x["b"])) / (F.size(x["a"]) + F.size(x["b"])))
    return F.when(root(a) == root(b), 1.0).otherwise(share)


def edits(a: Column, b: Column) -> Column:
    """The paragraphs of a that b lacks, as (section, paragraph) from 0: sections whose node b has are passed by, as are leaves that it has."""
    sections = F.slice(F.split(a, r"\|"), 2, F.greatest(F.size(F.split(a, r"\|")) - 1, F.lit(0)))
    nodes, leaves = (F.regexp_extract_all(b, F.lit(rf"{sign}([0-9a-f]{{{SHORT}}})"), 1) for sign in (r"\|", ";"))

    def of(section: Column, k: Column) -> Column:
        own = F.transform(F.regexp_extract_all(section, F.lit(f";([0-9a-f]{{{SHORT}}})"), 1), lambda leaf, j: F.struct(k.alias("section"), j.alias("paragraph"), leaf.alias("leaf")))
        return F.when(F.array_contains(nodes, F.substring(section, 1, SHORT)), F.slice(own, 1, 0)).otherwise(F.filter(own, lambda x: ~F.array_contains(leaves, x["leaf"])))

    return F.transform(F.flatten(F.transform(sections, of)), lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph")))


#: Ranges are powers of two, at most this many; a range holds about so many bytes of text.
MOST_RANGES, RANGE_BYTES = 1 << 19, 128 << 20
#: Sampled keys for each range: they set where ranges lie, not what they hold.
SAMPLED = 8


def _ranges(rows: DataFrame) -> tuple[DataFrame, int]:
    """(one row: the borders of 2^depth ranges of __qt_k as a heap, depth), from a sample of the keys."""
    spark = rows.sparkSession
    n, size = rows.agg(F.count("*"), F.sum("__qt_bytes")).first()
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    depth = math.ceil(math.log2(min(MOST_RANGES, max(least, (size or 0) / RANGE_BYTES, 2))))
    share = min(1.0, SAMPLED * 2**depth / max(n, 1))
    some = rows.filter(F.pmod(F.xxhash64("__qt_k.at"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = some.agg(F.array_sort(F.collect_list("__qt_k")).alias("s"))  # about SAMPLED keys a range

    # the heap's node i stands at (2 * (i - 2^l) + 1) / 2^(l + 1) of the sample, l the level of i
    heap = f"transform(sequence(1, {2**depth - 1}), i -> element_at(s, cast(1 + floor((2 * (i - pow(2, floor(log2(i)))) + 1) / pow(2, floor(log2(i)) + 1) * (size(s) - 1)) as int)))"
    return cut(found.select(F.expr(f"if(size(s) = 0, null, {heap})").alias("__qt_heap"))), depth


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, fingerprint, next_text and next_fingerprint: the next row has the next smaller key; after the last comes the first.

    Nulls are the smallest key; rows of one key follow one another by falling 64-bit hashes of their texts. Rows are dealt into ranges
    of (key, hash, place in the input), so neither a frequent key nor a group of equal rows meets in one task; the last row of a range
    is put in front of the next range too. Each text is shuffled once.
    """
    refuse(df.select(*[f"`{c}`" for c in (key, text)]), "fingerprint", "next_text", "next_fingerprint")
    rows = repeatable(df.select(F.col(f"`{key}`").alias("__qt_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__qt_text")))
    rows = rows.withColumn("__qt_at", F.monotonically_increasing_id())
    rows = rows.select("__qt_text", F.struct(F.col("__qt_key").alias("key"), F.xxhash64("__qt_text").alias("hash"), F.col("__qt_at").alias("at")).alias("__qt_k"))
    keys = cut(rows.select("__qt_k", F.octet_length("__qt_text").cast("long").alias("__qt_bytes")))
    heap, depth = _ranges(keys)
    down = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), lambda i, _: i * 2 + F.when(F.element_at("__qt_heap", i) < F.col("__qt_k"), 1).otherwise(0))
    dealt = lambda x: x.join(F.broadcast(heap)).withColumn("__qt_range", down).drop("__qt_heap")  # noqa: E731  one row
    # The last row of each range, at most MOST_RANGES of them, goes before the next range's first; the greatest of all before the least.
    lasts = dealt(keys).groupBy("__qt_range").agg(F.max("__qt_k").alias("k"))
    upto = Window.orderBy("__qt_range")
    to = F.coalesce(F.lead("__qt_range").over(upto), F.min("__qt_range").over(Window.partitionBy()))
    ghosts = cut(lasts.select(to.alias("__qt_range"), F.col("k.at").alias("at")))
    fore = rows.join(F.broadcast(ghosts), F.col("__qt_k.at") == F.col("at")).drop("at")
    both = dealt(rows).withColumn("__qt_own", F.lit(True)).unionByName(fore.withColumn("__qt_own", F.lit(False)))
    both = both.withColumn("fingerprint", fingerprint(F.col("__qt_text")))
    order = Window.partitionBy("__qt_range").orderBy("__qt_own", "__qt_k")
    out = both.withColumns({"next_text": F.lag("__qt_text").over(order), "next_fingerprint": F.lag("fingerprint").over(order)}).filter("__qt_own")
    return out.select(F.col("__qt_k.key").alias(key), F.col("__qt_text").alias(text), "fingerprint", "next_text", "next_fingerprint")
