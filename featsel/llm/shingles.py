"""Word shingles and MinHash signatures of texts, in numpy, inside Spark tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHash(dict):
    """Word -> 64-bit hash, remembering at most `most` words of 64 bytes at the most (some 20 MB)."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def runs(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes (none, if there are fewer words)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(width + (salt << 32)), np.uint64)
    for k in range(width):
        out *= _P
        out += hashes[k : k + n]
    return mixed(out)


def shingle_set(text: bytes, hashed: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles, A-Z lower-cased; a text of fewer words has
    its whole sequence as the one shingle, a text without words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(runs(hashed.of(words), min(SHINGLE, len(words))))


class MinHash:
    """`size` minimum hashes of each of many sets at once."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**64, size, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray], block: int = 32_768) -> np.ndarray:
        """uint32 array (len(sets), size); no set may be empty."""
        out = np.empty((len(sets), len(self.a)), np.uint32)
        at = 0
        while at < len(sets):
            end, n = at, 0
            while end < len(sets) and (end == at or n + len(sets[end]) <= block):
                n += len(sets[end])
                end += 1
            flat = np.concatenate(sets[at:end])
            starts = np.cumsum([0, *map(len, sets[at : end - 1])])
            buf = np.empty_like(flat)
            for k in range(len(self.a)):
                np.multiply(flat, self.a[k], out=buf)
                np.add(buf, self.b[k], out=buf)
                out[at:end, k] = np.minimum.reduceat(buf, starts) >> np.uint64(32)
            at = end
        return out
