"""Language-model scores from a subword lattice: the probability of a text summed over all its segmentations.

The pieces are those of an existing vocabulary file; their unigram weights are learned from the training documents by
expectation-maximisation: they start from one segmentation of every distinct word, and in each round every distinct word's
count is shared among all its segmentations, by a forward and a backward pass, in proportion to their probability. A text's
probability is the product over its words (for no piece crosses a word) of the sum over all ways to cut the word into
pieces, by a forward recursion in log space, times that of the end piece. A character that is no piece is spelled in byte
pieces, so every text has a probability.

Work per distinct word: chunks of documents send their words once, words are counted, weighed and scored once over the
whole corpus, and go back to the chunks that hold them; each chunk then scores its documents. Nothing but the piece counts,
at most one for each piece of the vocabulary, reaches the driver. A chunk is a stretch of a partition; the input is read twice,
so one whose rows could lie otherwise the second time is cut first.

Defined results: a null or empty text is the end token alone; repeated rows are documents of their own; a null key counts
as the empty string. A-Z is lower-cased; a word is a run without ASCII white space.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, renamed, repeatable, small_batches

#: Text of a chunk, in bytes; a longer document is a chunk by itself.
CHUNK_BYTES = 12_000_000
#: Rounds of expectation-maximisation.
ROUNDS = 1
#: Longest word that the backward pass adds up without logarithms, in characters, and what a character is scaled by against underflow.
PLAIN_LENGTH, SCALE = 200, math.exp(2.5)
SPACE = "▁"


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """Log weights of pieces, and the forward recursion over the pieces that match a word."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, weights: np.ndarray):
        self.pieces = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.bytes: dict[int, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = float(weights[i])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces.add_word(piece, (len(piece), float(weights[i]), i))
                if len(piece) == 1:
                    self.single.add(piece)
        self.pieces.make_automaton()
        self.end = float(weights[model.eos_id()])

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the summed probability of all segmentations of a word."""
        text = SPACE + word
        total = [0.0] + [-math.inf] * len(text)
        exp, log1p, at = math.exp, math.log1p, 0
        spelled = {i: sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass")) for i, c in enumerate(text) if c not in self.single}
        for end, (size, weight, _) in self.pieces.iter(text):
            while spelled and at < end:  # characters before this end that no match settles any more
                if at in spelled:
                    total[at + 1] = np.logaddexp(total[at + 1], total[at] + spelled[at])
                at += 1
            a, b = total[end + 1], total[end + 1 - size] + weight
            if b > a:
                a, b = b, a
            total[end + 1] = a if b == -math.inf else a + log1p(exp(b - a))
        for i in range(at, len(text)) if spelled else ():
            if i in spelled:
                total[i + 1] = np.logaddexp(total[i + 1], total[i] + spelled[i])
        return float(total[-1])


class Shares:
    """The expectation step: adds a word's count to its pieces, over all segmentations, by their probability."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, weights: np.ndarray):
        self.lattice = Lattice(model, weights)
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        self.scaled = (np.exp(weights) * SCALE ** np.array([len(model.id_to_piece(i)) for i in range(len(weights))])).tolist()
        self.total = np.zeros(len(weights)).tolist()

    def matches(self, text: str) -> list[tuple[int, int, float, list[int]]]:
        """(start, end, log weight, pieces) of all steps of the lattice, by end; an unknown character is one step of byte pieces."""
        out = [(end + 1 - size, end + 1, weight, [i]) for end, (size, weight, i) in self.lattice.pieces.iter(text)]
        for at, c in enumerate(text):
            if c not in self.lattice.single:
                found = c.encode("utf-8", "surrogatepass")
                out.append((at, at + 1, sum(self.lattice.bytes[b] for b in found), [self.byte_ids[b] for b in found]))
        return sorted(out, key=lambda m: m[1])

    def add(self, word: str, count: int) -> None:
        text = SPACE + word
        single, total, scaled = self.lattice.single, self.total, self.scaled
        n = len(text)
        if n <= PLAIN_LENGTH and single.issuperset(text):
            found = [(end + 1 - size, end + 1, i) for end, (size, _, i) in self.lattice.pieces.iter(text)]
            ahead, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            for a, b, i in found:
                ahead[b] += ahead[a] * scaled[i]
            if 1e-290 < ahead[n] < 1e290:
                for a, b, i in reversed(found):
                    back[a] += back[b] * scaled[i]
                share = count / ahead[n]
                for a, b, i in found:
                    total[i] += ahead[a] * scaled[i] * back[b] * share
                return
        steps = self.matches(text)
        ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = back[n] = 0.0
        for a, b, w, _ in steps:
            ahead[b] = np.logaddexp(ahead[b], ahead[a] + w)
        for a, b, w, _ in reversed(steps):
            back[a] = np.logaddexp(back[a], back[b] + w)
        for a, b, w, found in steps:
            for i in found:
                total[i] += count * math.exp(ahead[a] + w + back[b] - ahead[n])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut at chunk ends, with the number of the chunk."""
    number, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        chunk = (size + np.cumsum(length)) // CHUNK_BYTES
        for c in np.unique(chunk):
            lo, hi = np.searchsorted(chunk, [c, c + 1])
            yield number + int(c), batch.slice(lo, hi - lo)
        size += int(length.sum())


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, word, training count: once for each distinct word of a chunk."""

    def out(chunk: int, seen: Counter, known: Counter) -> Iterator[pa.RecordBatch]:
        words = [*seen]
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part, pa.binary()), pa.array([known[w] for w in part], pa.int64())], ["chunk", "word", "n"])

    at, seen, known = None, Counter(), Counter()
    for chunk, batch in _chunks(batches):
        if chunk != at and at is not None:
            yield from out(at, seen, known)
            seen, known = Counter(), Counter()
        at = chunk
        for text, held in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
            (seen if held else known).update(_words(text))
        if known:
            seen.update(dict.fromkeys(known, 0))
    if at is not None:
        yield from out(at, seen, known)


def _with_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, batch in _chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), chunk)), *batch.columns], ["chunk", *batch.schema.names])


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        total = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            found = model.encode(words, num_threads=1)
            sizes = [len(f) for f in found]
            np.add.at(total, np.fromiter((i for f in found for i in f), np.int64, sum(sizes)), np.repeat(batch.column("c").to_numpy(), sizes))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "n"])

    return run


def _shared(path: str, weights):
    """The expected counts of the pieces of some words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = Shares(vocabulary(path), weights.value)
        for batch in batches:
            for word, count in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True):
                shares.add(word.decode("utf-8", "replace"), count)
        total = np.array(shares.total)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "n"])

    return run


def _scored(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path), shared.value)
        for batch in batches:
            scores = [lattice.log_probability(w.decode("utf-8", "replace")) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(scores, pa.float64())], ["word", "c", "lp"])

    return run


def _texts(total: int, distinct: int, ends: int, end: float, key_type: pa.DataType):
    """Scores the documents of a chunk with the counts and scores of its words."""
    below = total + 0.5 * (distinct + 1)
    end_base = math.log10((ends + 0.5) / below)

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        index = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        count = words.column("c").to_numpy()
        base, score = np.log10((count + 0.5) / below), words.column("lp").to_numpy() / math.log(10)
        rows = []
        for text in docs.column("text").to_pylist():
            found = _words(text)
            i = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
            rows.append((len(found) + 1, int((count[i] > 0).sum()) + (ends > 0), float(base[i].sum()) + end_base, float(score[i].sum()) + end / math.log(10)))
        columns = [*zip(*rows, strict=True)] or [(), (), (), ()]
        return pa.table(
            {
                "doc": docs.column("doc").cast(key_type),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(columns[0], pa.int64()),
                "n_known": pa.array(columns[1], pa.int64()),
                "train_tokens": pa.array([total] * len(rows), pa.int64()),
                "base_score": pa.array(columns[2], pa.float64()),
                "score": pa.array(columns[3], pa.float64()),
            }
        )

    return run


def lm_scores(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score (base 10 logarithms)."""
    spark = df.sparkSession
    small_batches(spark)
    docs = repeatable(renamed(df, doc=key, text=text)).withColumn("held_out", F.crc32(F.coalesce(F.col("doc").cast("string"), F.lit("")).cast("binary")) % 5 == 1)
    pairs = cut(docs.mapInArrow(_chunk_words, "chunk long, word binary, n long"))
    words = cut(pairs.groupBy("word").agg(F.sum("n").alias("c")))
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = docs.agg(F.count(F.when(~F.col("held_out"), 1))).first()[0]

    model = vocabulary(path)
    training = words.filter("c > 0").select("word", "c")

    def weights_of(found: DataFrame) -> np.ndarray:
        counts = np.zeros(model.get_piece_size())
        for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most one row for each piece
            counts[r[0]] = r[1]
        counts[model.eos_id()] += ends
        return np.log((counts + 0.5) / (counts.sum() + 0.5 * len(counts)))

    weights = weights_of(training.mapInArrow(_piece_counts(path), "piece int, n long"))
    for _ in range(rounds):
        weights = weights_of(training.mapInArrow(_shared(path, spark.sparkContext.broadcast(weights)), "piece int, n double"))
    scored = words.mapInArrow(_scored(path, spark.sparkContext.broadcast(weights)), "word binary, c long, lp double")

    back = pairs.select("chunk", "word").join(scored, "word").select(F.col("chunk").alias("to"), "word", "c", "lp")
    kind = docs.schema["doc"].dataType
    schema = f"doc {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    score = _texts(seen[0] + ends, seen[1] + (ends > 0), ends, float(weights[model.eos_id()]), to_arrow_type(kind))
    placed = docs.mapInArrow(_with_chunk, f"chunk long, doc {kind.simpleString()}, text string, held_out boolean")
    # As many partitions as chunks, so that a task's share does not grow with the corpus.
    chunks = pairs.agg(F.approx_count_distinct("chunk", 0.01)).first()[0] or 1
    placed, back = placed.repartition(chunks, "chunk"), back.repartition(chunks, "to")
    return placed.groupBy("chunk").cogroup(back.groupBy("to")).applyInArrow(score, schema).withColumnRenamed("doc", key)
