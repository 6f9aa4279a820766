"""Word shingles as 64-bit numbers, and MinHash signatures of their sets."""

from __future__ import annotations

import numpy as np

WORD_CACHE = 200_000
CHUNK = 8_192


class WordNumbers(dict):
    """64-bit numbers of words, remembered; forgets all when it has grown too large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        number = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return number


def shingle_set(text: str, size: int, numbers: WordNumbers) -> np.ndarray:
    """Sorted numbers of the different runs of ``size`` words; of all words, if there are fewer; empty without words.

    Words are what white space separates.
    """
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    mixed = np.zeros(len(ids) - size + 1, np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + len(mixed)]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def multipliers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(numbers: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16 bits of the smallest product for each factor. Long sets are taken in chunks."""
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for i in range(0, len(numbers), CHUNK):
        # Row by factor, so that the minimum runs along memory.
        part = factors[:, None] * numbers[None, i : i + CHUNK]
        np.minimum(least, part.min(axis=1), out=least)
    return ((least >> np.uint64(20)) & np.uint64(0xFFFF)).astype("<u2")
