"""Byte-pair merges of many words at once: words of one length are rows of a matrix that loses a column with each merge."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_END = "</w>"
NEVER = np.int32(2**31 - 1)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in prints)
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


def slot(keys: np.ndarray, factor: int, slots: int) -> np.ndarray:
    """Where each key stands among ``slots``, a power of two, if it does."""
    # The high bits of a product depend on all bits of the key.
    return (keys.astype(np.uint64) * np.uint64(factor) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def slots(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Two hash tables, as factor, keys and their places in ``keys``: the second has the keys that found their slot taken.

    Two lookups take less time than a search among sorted keys. Of equal keys the first counts.
    """
    left, factor, room = np.sort(np.unique(keys, return_index=True)[1]), 0x9E3779B97F4A7C15, 16
    for last in (False, True):
        while True:
            size = 1 << (room * len(left) + 1).bit_length()
            at = slot(keys[left], factor, size)
            _, first = np.unique(at, return_index=True)
            if not last or len(first) == len(left):
                break
            # Another factor, and in the end more room, sets them all apart.
            factor, room = (factor * 0xD1342543DE82EF95 + 2) % 2**64 | 1, room + 8
        table, places = np.full(size, -1, np.int64), np.full(size, NEVER)
        table[at[first]], places[at[first]] = keys[left[first]], left[first]
        yield factor, table, places
        left = np.delete(left, first)


class PairMerges:
    """The merges of a ``tokenizers`` file whose words end in a mark, for words of up to ``longest`` bytes."""

    longest = 32

    def __init__(self, file: str) -> None:
        model = json.loads(file)["model"]
        if model["end_of_word_suffix"] != WORD_END or model["dropout"] or model.get("ignore_merges"):
            raise ValueError("the file's merges follow another rule")
        vocabulary = model["vocab"]
        letters = byte_letters()
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[letters[b] + WORD_END] for b in range(256)], np.int32)
        self.size = max(vocabulary.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.tables = list(slots(keys))
        bytes_, inner = np.arange(256), self.inner.astype(np.int64)[:, None]
        self.inner_ranks = self.rank(inner[bytes_[:, None], 0], self.inner[bytes_[None, :]])
        self.last_ranks = self.rank(inner[bytes_[:, None], 0], self.last[bytes_[None, :]])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair among the merges."""
        wanted = left.astype(np.int64) * self.size + right
        found = NEVER
        for factor, keys, ranks in self.tables:
            at = slot(wanted, factor, len(keys))
            found = np.where(keys[at] == wanted, ranks[at], found)
        return found

    def encode(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all; none for an empty word, and -1 of them for one that is too long."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        lengths = np.diff(offsets)
        counts = np.where(lengths > self.longest, -1, 0)
        order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], np.arange(1, self.longest + 2))
        parts = []
        for length, low, high in zip(range(1, self.longest + 1), bounds[:-1], bounds[1:], strict=True):
            if low < high:
                places = order[low:high]
                letters = data[offsets[places][:, None] + np.arange(length)]
                for rows, ids in self.merged(letters):
                    parts.append((places[rows], ids))
                    counts[places[rows]] = ids.shape[1]
        starts = np.cumsum(np.maximum(counts, 0))
        out = np.empty(starts[-1] if len(starts) else 0, np.uint32)
        starts -= np.maximum(counts, 0)
        for places, ids in parts:
            out[starts[places][:, None] + np.arange(ids.shape[1])] = ids
        return counts, out

    def merged(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and ids of the words, rows of bytes, that no further merge changes, by their number of ids.

        Each step merges one pair of every word: the first one of the lowest rank.
        """
        # A word is a column here, so that each operation runs along many words.
        letters = letters.T
        symbols = self.inner[letters]
        symbols[-1] = self.last[letters[-1]]
        rows = np.arange(symbols.shape[1])
        ranks = self.inner_ranks[letters[:-1], letters[1:]]
        ranks[-1:] = self.last_ranks[letters[-2:-1], letters[1:][-1:]]
        while len(symbols) > 1:
            n = len(symbols)
            best = ranks.argmin(axis=0)
            rank = ranks[best, np.arange(len(rows))]
            done = rank == NEVER
            if done.any():
                yield rows[done], symbols[:, done].T
                going = np.flatnonzero(~done)
                rows, symbols, ranks, best, rank = rows[going], symbols[:, going], ranks[:, going], best[going], rank[going]
            if not len(rows):
                return
            each = np.arange(len(rows))
            symbols[best, each] = self.made[rank]
            # The symbol after the merged one leaves, and so does the rank of the merged pair.
            symbols = np.where(np.arange(n - 1)[:, None] > best, symbols[1:], symbols[:-1])
            ranks = np.where(np.arange(n - 2)[:, None] >= best, ranks[1:], ranks[:-1])
            before, after = np.flatnonzero(best), np.flatnonzero(best < n - 2)
            word = np.concatenate([before, after])
            at = np.concatenate([best[before] - 1, best[after]])
            ranks[at, word] = self.rank(symbols[at, word], symbols[at + 1, word])
        if len(rows):
            yield rows, symbols.T
