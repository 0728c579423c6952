"""Five-word shingles of whole texts as 64-bit hashes (numpy, in tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

MULT = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word -> 64-bit hash, the same in every process; forgets at a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_shingles(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles. A text of fewer than ``width`` words has one
    shingle of all its words; a null text or one without a word has none."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.array([hashes[x] for x in words], dtype=np.uint64)
    k = min(width, len(w))
    out = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * MULT + w[i : len(w) - k + 1 + i]
    return np.unique(mix(out))
