"""A HAT-trie over word ids: hash containers that burst into nodes of a shallow trie, and give up whole subtrees."""

from __future__ import annotations

from collections import Counter

import numpy as np

# A phrase is one number: the ids of its words from the left, 0 where it has ended.
WORD_BITS = 21
MOST_WORDS = 3
FAN_BITS = 6
FAN = 1 << FAN_BITS
DEPTH = 5


def packed(columns: list[np.ndarray]) -> np.ndarray:
    """Numbers of phrases from the ids of their first, second, ... words."""
    key = np.zeros(len(columns[0]), np.int64)
    for k, column in enumerate(columns):
        key |= column << (WORD_BITS * (MOST_WORDS - 1 - k))
    return key


def unpacked(keys: np.ndarray) -> list[np.ndarray]:
    """The ids of the words of each phrase, by place."""
    mask = (1 << WORD_BITS) - 1
    return [keys >> (WORD_BITS * (MOST_WORDS - 1 - k)) & mask for k in range(MOST_WORDS)]


def branch_shift(depth: int) -> int:
    """Where the digit of this depth lies: three digits of the first word's id, the lowest first, then the second's."""
    place, level = divmod(depth, 3)
    return WORD_BITS * (MOST_WORDS - 1 - place) + FAN_BITS * level


class HatTrie:
    """Counts of phrases. ``burst`` entries turn a container into a node whose branches are containers."""

    def __init__(self, burst: int = 16_384) -> None:
        self.burst = burst
        self.root: list = [Counter() for _ in range(FAN)]

    def add(self, keys: np.ndarray) -> None:
        """Count these phrases, each as often as it stands there."""
        self._add(self.root, keys, 0, None)

    def _add(self, node: list, keys: np.ndarray, depth: int, counts: np.ndarray | None) -> None:
        branch = (keys >> branch_shift(depth) & (FAN - 1)).astype(np.uint8)
        order = np.argsort(branch, kind="stable")
        keys = keys[order]
        ends = np.cumsum(np.bincount(branch, minlength=FAN)).tolist()
        counts = None if counts is None else counts[order]
        low = 0
        for b, high in enumerate(ends):
            if high > low:
                child, part = node[b], keys[low:high]
                some = None if counts is None else counts[low:high]
                if isinstance(child, list):
                    self._add(child, part, depth + 1, some)
                else:
                    if some is None:
                        child.update(part.tolist())
                    else:
                        child.update(dict(zip(part.tolist(), some.tolist(), strict=True)))
                    if len(child) > self.burst and depth + 1 < DEPTH:
                        node[b] = [Counter() for _ in range(FAN)]
                        entries = np.fromiter(child.keys(), np.int64, len(child))
                        self._add(node[b], entries, depth + 1, np.fromiter(child.values(), np.int64, len(child)))
                low = high

    def containers(self, node: object) -> list[Counter]:
        return [c for child in node for c in self.containers(child)] if isinstance(node, list) else [node]

    def sizes(self) -> np.ndarray:
        """Entries of each subtree below the root."""
        return np.array([sum(map(len, self.containers(child))) for child in self.root])

    def take(self, subtrees: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and counts of these subtrees of the root, which leave the trie."""
        found = [c for b in subtrees for c in self.containers(self.root[b])]
        for b in subtrees:
            self.root[b] = Counter()
        n = sum(map(len, found))
        keys, counts = np.empty(n, np.int64), np.empty(n, np.int64)
        low = 0
        for c in found:
            high = low + len(c)
            keys[low:high], counts[low:high] = list(c.keys()), list(c.values())
            low = high
        return keys, counts
