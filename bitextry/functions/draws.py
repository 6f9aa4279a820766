"""Counter-based pseudo-random integers: the finaliser of MurmurHash3, vectorised, which SQL can state too."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

# Fixed values of the 32-bit finaliser (Appleby), and the golden ratio as a step between counters.
FIRST_FACTOR, SECOND_FACTOR, COUNTER_STEP = 2246822507, 3266489909, 2654435769
ROUNDS = 4


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers whose bits depend on all bits of the input."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(FIRST_FACTOR)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(SECOND_FACTOR)
    return x ^ (x >> np.uint32(16))


def counter_draws(first: np.ndarray, second: np.ndarray, draws: int) -> np.ndarray:
    """``draws`` 32-bit numbers for each row (row, draw), fixed by the row's two 32-bit words and the draw's number."""
    counters = np.arange(draws, dtype=np.uint32) * np.uint32(COUNTER_STEP)
    return mix32(first.astype(np.uint32)[:, None] ^ mix32(second.astype(np.uint32)[:, None] + counters))


def round_keys(seed: int, epoch: int) -> list[int]:
    """The keys of a permutation's rounds."""
    return [int(hashlib.md5(f"{seed}:{epoch}:{r}".encode()).hexdigest()[:8], 16) for r in range(ROUNDS)]


def permute(numbers: np.ndarray, size: int, keys: Sequence[int]) -> np.ndarray:
    """A permutation of ``0 .. size - 1`` given by ``keys``, evaluated at ``numbers``.

    A Feistel network over the next even number of bits; what leaves the range walks on along its cycle (Black and
    Rogaway 2002), fewer than four steps on average.
    """
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    low_bits = np.uint64((1 << half) - 1)
    out = np.asarray(numbers, np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & low_bits
        for key in keys:
            mixed = mix32(right.astype(np.uint32) ^ np.uint32(key)).astype(np.uint64)
            left, right = right, left ^ (mixed & low_bits)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= size]
    return out.astype(np.int64)
