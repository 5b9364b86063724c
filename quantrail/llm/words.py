"""Words of a text as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import remembers, works

#: Bounds a worker's memory of words, in entries.
WORDS_KEPT = 150_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_known = _Hashes()
_hash = _known.__getitem__
remembers("words", _known.clear)


def word_hashes(text: str | None) -> np.ndarray:
    """One hash for each word, a run without ASCII white space."""
    works("words")
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(_hash, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # sums of h[i] * BASE^(k-1-i), by doubling: a run of 2m words is a run of m words and the one after it
    with np.errstate(over="ignore"):
        total, length, power = None, 0, hashes
        size, scale = 1, BASE
        left = k
        while left:
            if left & 1:
                total = power[: len(hashes) - size + 1] if total is None else total[: len(hashes) - length - size + 1] * scale + power[length : len(hashes) - size + 1]
                length += size
            left >>= 1
            if left:
                power = power[:-size] * scale + power[size:]
                scale, size = scale * scale, size * 2
        return mixed(total[:n] + np.uint64(k))
