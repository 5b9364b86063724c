"""BPE encoding and decoding: the distinct words of a batch form a trie, walked depth first so that a shared prefix is encoded once.

A BPE encoding is fixed by its neighbouring pairs: tokens t1..tn are the encoding of their text exactly if each pair
(ti, ti+1) is the encoding of its own text. So each prefix of a word has one possible last token, found from the last
tokens of shorter prefixes; the state of a trie node is that token. Words are visited in sorted order, which is the
trie's preorder: the stack holds the states along the current path, and a word starts from its longest prefix shared
with the word before.

Defined results: a null or empty text has no tokens; repeated rows get equal results; extra columns pass through.
"""

from __future__ import annotations

import functools
import hashlib
import json
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import remembers, works

assert sys.byteorder == "little" and array("I").itemsize == 4

#: Stands for the end of a word in the automaton; no byte symbol.
MARK = "\n"
#: Below this character, lower-casing and normal forms are those of single characters.
PLAIN = "ƀ"
#: Bounds a worker's memory of words, in bytes of each of two generations, and of pieces of words.
BYTES_KEPT = {"digest": 170 << 20, "bytes": 160 << 20}
#: What a remembered word takes beside its characters: the objects and its place in the dictionary.
WORD_BYTES = {"digest": 400, "bytes": 180}
#: Text whose distinct words go into one trie, in characters; a longer text is one slice by itself.
SLICE_CHARS = 2_000_000

ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: itself if visible, else the next free code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in visible else free))
        free += b not in visible
    return out


class TrieEncoder:
    """A tokenizer file with word-end BPE, its merges as a table of splits, and a bounded memory of encoded words."""

    def __init__(self, path: str, form: str = "digest", kept: int | None = None):
        """form: what is remembered of a word, its parts of the digests or its ids as bytes (4 each, little-endian); kept: bytes of a generation, BYTES_KEPT unless given."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.rest = Tokenizer.from_file(path)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        self.special_split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.symbols = dict(enumerate(byte_symbols()))
        self.symbols_but_line = {b: c for b, c in self.symbols.items() if b != 10}
        self.rank: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b, c = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merged[a, b] = r
            if c not in self.split:
                self.split[c], self.rank[c] = (a, b), r
        self.fits: dict[tuple[int, int], bool] = {}
        whole = {i for i in self.vocab.values() if i not in self.split or self._pair(*self.split[i], top=self.rank[i])}
        # One automaton holds the tokens, those that end a word with a mark in place of the suffix.
        tokens = {t: i for t, i in self.vocab.items() if i in whole}
        tokens = {t[: -len(self.end)] + MARK if t.endswith(self.end) else t: i for t, i in tokens.items()}
        self.longest = max(map(len, tokens))
        self.ends = ahocorasick.Automaton()
        for t, i in tokens.items():
            self.ends.add_word(t, (i, len(t)))
        self.ends.make_automaton()
        number, token = {i: str(i) for i in self.token}, self.token
        if form == "bytes":
            self.form, self.joined = lambda ids: array("I", ids).tobytes(), b"".join
        else:
            self.form = lambda ids: (" ".join([number[i] for i in ids]), len(ids), " ".join([token[i] for i in ids]))
            self.joined = lambda parts: (" ".join([p[0] for p in parts]), sum([p[1] for p in parts]), " ".join([p[2] for p in parts]))
        self.most, self.word_bytes = kept or BYTES_KEPT[form], WORD_BYTES[form]
        self.size = self.pieces_size = 0
        self.none = self.form([])
        self.blank = False  # whether some word had no tokens
        self.known: dict[bytes, tuple[str, int, str] | bytes] = {}
        self.older: dict[bytes, tuple[str, int, str] | bytes] = {}
        self.pieces_known: dict[str, tuple[str, int, str] | bytes] = {}

    def _pair(self, a: int, b: int, top: int = 1 << 60) -> bool:
        """Whether no merge of rank below top crosses the border between the encodings a and b while they are built."""
        limit, merged, split, rank = top, self.merged, self.split, self.rank
        while True:
            r = merged.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            # Undo the later of the two merges beside the border; of equal ones the right one, which was made last.
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, split[a][1]
            else:
                limit, b = rb + 1, split[b][0]

    def _fits(self, a: int, b: int) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            got = self.fits[a, b] = self._pair(a, b)
        return got

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Token ids of sorted distinct words (in byte symbols), along the trie of their prefixes."""
        ends, known, fits, longest = self.ends.iter, self.fits.get, self._fits, self.longest
        out, last, before = [], [], ""  # last[i]: the last token of the prefix of i + 1 symbols, and where it starts
        for word in words:
            n = len(word)
            shared, most = 0, min(len(last), n)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared:]
            at = shared
            for end, (t, size) in ends(word + MARK, shared - longest if shared > longest else 0):  # at each end, the longest first
                if end == at:
                    start = end - size + 1
                    if start:
                        a = last[start - 1][0]
                        good = known((a, t))
                        if not good and (good is not None or not fits(a, t)):
                            continue
                    last.append((t, start))
                    at += 1
            t, i = last.pop()  # the token of the mark
            ids = [t]
            while i:
                t, i = last[i - 1]
                ids.append(t)
            ids.reverse()
            out.append(ids)
            before = word
        return out

    def symbols_of(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols)

    def words_of(self, part: str) -> list[str]:
        """The words, in byte symbols, that normalisation and pre-tokenisation make of a part without special tokens."""
        if part.isprintable() and (part.isascii() or max(part) < PLAIN):
            return [self.symbols_of(w) for w in self.pieces(part.lower())]
        return [w for w, _ in self.rest.pre_tokenizer.pre_tokenize_str(self.rest.normalizer.normalize_str(part))]

    def learn(self, words: set[bytes]) -> None:
        """Makes all these words (runs without ASCII white space) known. Of other words a bounded number stays known, the latest."""
        if self.size > self.most:
            self.known, self.older, self.size = {}, self.known, 0
        if self.pieces_size > self.most:
            self.pieces_known, self.pieces_size = {}, 0
        known, older, pieces, form, joined = self.known, self.older.get, self.pieces_known, self.form, self.joined
        raws: list[bytes] = []
        new = words.difference(known)
        for raw in new:
            if (got := older(raw)) is not None:
                known[raw] = got
            else:
                raws.append(raw)
        odd: list[tuple[bytes, list]] = []
        joint = b"\n".join(raws)
        self.size += self.word_bytes * len(new) + 3 * len(joint)
        text = joint.decode()
        if "<|" in text or not text.isascii() and max(text) >= PLAIN:
            plain = []
            for raw in raws:
                word = raw.decode()
                if self.special_split and "<|" in word and (m := self.special_split.findall(word)):
                    odd.append((raw, [x for a, b in zip(self.special_split.split(word), [*m, None], strict=True) for x in (self.words_of(a) if a else []) + ([self.special[b]] if b else [])]))
                elif not word.isascii() and max(word) >= PLAIN:
                    odd.append((raw, self.words_of(word)))
                else:
                    plain.append(raw)
            raws, text = plain, b"\n".join(plain).decode()
        # Below U+0180 every character is its own normal form, so case and symbols change for all words at once.
        low = text.lower()
        shown = low if low.isascii() else low.encode().decode("latin-1").translate(self.symbols_but_line)
        one: list[tuple[bytes, str]] = []
        two: list[tuple[bytes, str, str]] = []
        get, tails = pieces.get, ".,!?;:"
        for raw, word, piece in zip(raws, low.split("\n"), shown.split("\n"), strict=True) if raws else ():
            if word.isalpha():
                if (got := get(piece)) is not None:
                    known[raw] = got
                else:
                    one.append((raw, piece))
            elif word[-1] in tails and word[:-1].isalpha():
                two.append((raw, piece[:-1], word[-1]))
            else:
                odd.append((raw, self.words_of(raw.decode())))
        fresh = {p for _, p in one}
        fresh.update([p for _, p, _ in two], tails, [w for _, found in odd for w in found if w.__class__ is str])
        distinct = sorted(fresh.difference(pieces))
        self.pieces_size += self.word_bytes * len(distinct) + sum(map(len, distinct))
        pieces.update(zip(distinct, map(form, self.encode_sorted(distinct)), strict=True))
        known.update([(raw, pieces[p]) for raw, p in one])
        for raw, p, t in two:
            known[raw] = joined((pieces[p], pieces[t]))
        for raw, found in odd:
            known[raw] = joined([pieces[w] if w.__class__ is str else form([w]) for w in found]) if found else self.none
            self.blank |= not found

    def in_slices(self, texts: list[str | None]) -> Iterator[list[bytes]]:
        """The words of each text, all known. The trie is built over slices of texts with some SLICE_CHARS of text."""
        held, size = [], 0
        for i, text in enumerate(texts):
            held.append(words := (text or "").encode().split())
            size += len(text or "")
            if size >= SLICE_CHARS or i + 1 == len(texts):
                self.learn(set().union(*held))
                yield from held
                held, size = [], 0

    def packed(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as bytes; for an encoder of that form."""
        for words in self.in_slices(texts):
            yield b"".join(map(self.known.__getitem__, words))

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Token count, digest of the ids and digest of the decoded text (tokens joined by spaces, as there is no decoder)."""
        out = []
        for words in self.in_slices(texts):
            got = [*map(self.known.__getitem__, words)]
            if self.blank:  # some word had no tokens
                got = [g for g in got if g[1]]
            ids, counts, decoded = zip(*got, strict=True) if got else ((), (), ())
            out.append((sum(counts), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(decoded).encode()).hexdigest()))
        return out


_encoder = functools.lru_cache(maxsize=2)(TrieEncoder)
remembers("bpe", _encoder.cache_clear)


def encoder(path: str, form: str = "digest", kept: int | None = None) -> TrieEncoder:
    """One encoder for each worker process."""
    works("bpe")
    return _encoder(path, form, kept)


def bpe_digests(text: Column | str, path: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> of a text column."""

    @F.pandas_udf(ENCODED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(encoder(path).digests(texts.tolist()), columns=ENCODED.names)

    return run(F.col(text) if isinstance(text, str) else text)


def bpe_ids(text: Column | str, path: str) -> Column:
    """array<int> of token ids."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<u4").astype("i4") for x in encoder(path, "bytes").packed(texts.tolist())], dtype=object)

    return run(F.col(text) if isinstance(text, str) else text)


def bpe_decode(ids: Column | str, path: str) -> Column:
    """The text of an array of token ids: tokens joined by one space; null ids count as none."""

    @F.pandas_udf(T.StringType())
    def run(rows: pd.Series) -> pd.Series:
        token = encoder(path).token
        return pd.Series(["" if r is None else " ".join([token[i] for i in r]) for r in rows], dtype=object)

    return run(F.col(ids) if isinstance(ids, str) else ids)
