"""Texts as arrays of hashed words, for the operators that need no spelling."""

from __future__ import annotations

import re
import zlib

import numpy as np


class WordHasher(dict):
    """Words of a text as numbers below 2**bits; a bounded table remembers words."""

    def __init__(self, pattern: str, bits: int, lower: bool, limit: int = 300_000):
        super().__init__()
        self.find, self.mask, self.lower, self.limit = re.compile(pattern).findall, (1 << bits) - 1, lower, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & self.mask
        return got

    def ids(self, text: str | None) -> np.ndarray:
        words = self.find(text.lower() if self.lower else text) if text else ()
        return np.array(list(map(self.__getitem__, words)), dtype=np.int64)


class WideHasher(WordHasher):
    """The same with 64-bit numbers, for exact comparison of words by number."""

    def __init__(self, pattern: str = r"\w+", lower: bool = True, limit: int = 300_000):
        super().__init__(pattern, 32, lower, limit)

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got

    def ids(self, text: str | None) -> np.ndarray:
        words = self.find(text.lower() if self.lower else text) if text else ()
        return np.array(list(map(self.__getitem__, words)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit numbers of the n-word windows; a shorter, non-empty text is one window."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return out


def quick_ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """The same windows as sums of 64-bit word numbers with odd factors: cheaper, and as good for numbers that are scrambled already."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out += words[i : len(words) - n + 1 + i] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1) ** 3 | 1) & 0xFFFFFFFFFFFFFFFF)
    return out
