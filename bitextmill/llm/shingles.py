"""Word shingles of whole texts as 64-bit hashes, with a bounded memory of words seen."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which close inputs part."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHasher(dict):
    """Hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """uint64 hashes of the words, A-Z in lower case, separated by ASCII white space."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.array(list(map(self.__getitem__, words)), dtype=np.uint64)


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; of shorter sequences, the whole as one; of none, empty."""
    n = len(words)
    if not n:
        return words
    size = min(n, width)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = mixed(total + words[k : n - size + 1 + k])
    return np.unique(total)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
