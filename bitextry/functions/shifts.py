"""Translation edit rate of one row: edit distance plus greedy block shifts (Snover et al. 2006).

What a shift is, its size and its distance, is part of the metric. Edit distances use bit-parallel rows. A shifted
hypothesis differs from the current one only between the block and its target: its distance is the smallest sum of
a row computed over that window, from the state before it, and the row of all that follows. Of both passes every
``STRIDE``-th state is kept, and those in between are made again when they are asked for, so that memory grows with the
reference and the hypothesis, not with the matrix.

A shift moves words and changes none, so the edits that the counts of words alone ask for stay whatever is moved. A row
that needs no others is done after one pass, and a shift that cannot save enough is not measured.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np

from bitextry.functions.kernels import Texts, _rows, clipped_matches, word_edits, word_edits_by_row


@dataclass(frozen=True)
class ShiftLimits:
    """Longest block, and farthest place it may come from, as in the published tools.

    ``tried`` ends the search of a row after so many shifts, as those tools do after 1000, which changes the result of
    long rows; by default all are tried.
    """

    size: int = 10
    distance: int = 50
    tried: int | None = None


# Bytes of word masks that a prepared reference keeps.
MASK_BYTES = 4_000_000


class _Reference:
    """A reference prepared for edit distances against many hypotheses."""

    def __init__(self, words: list[int]):
        self.words = words
        self.full = (1 << len(words)) - 1
        self.last = 1 << (len(words) - 1)
        self.bits: dict[int, int] = {}
        self.places: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            self.places.setdefault(word, []).append(i)

    def equal(self, word: int) -> int:
        """The places of a word as bits; masks are kept up to ``MASK_BYTES``."""
        mask = self.bits.get(word)
        if mask is None:
            size = len(self.words) // 8 + 1
            marked = bytearray(size)
            for i in self.places.get(word, ()):
                marked[i >> 3] |= 1 << (i & 7)
            mask = int.from_bytes(marked, "little")
            if len(self.bits) * size >= MASK_BYTES:
                self.bits.clear()
            self.bits[word] = mask
        return mask

    def start(self) -> tuple[int, int, int]:
        return self.full, 0, len(self.words)

    def advance(self, state: tuple[int, int, int], word: int) -> tuple[tuple[int, int, int], int, int]:
        """The next row of the edit matrix, with its free-diagonal and horizontal-increase bits."""
        up, down, edits = state
        equal = self.equal(word)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        increase = down | ~(diagonal | up) & self.full
        decrease = up & diagonal
        edits += bool(increase & self.last) - bool(decrease & self.last)
        grown = (increase << 1 | 1) & self.full
        up = (decrease << 1 & self.full) | ~(diagonal | grown) & self.full
        return (up, grown & diagonal, edits), diagonal, increase

    def row(self, state: tuple[int, int, int], start: int) -> np.ndarray:
        """Distances to every prefix of the reference, after a hypothesis of ``start`` words."""
        n = len(self.words)
        size = (n + 7) // 8
        up, down = (
            np.unpackbits(np.frombuffer(bits.to_bytes(size, "little"), np.uint8), bitorder="little", count=n)
            for bits in state[:2]
        )
        out = np.empty(n + 1, np.int32)
        out[0] = start
        np.cumsum(up.astype(np.int32) - down, out=out[1:])
        out[1:] += start
        return out


# Words of a reference up to which the masks of all its words are small.
SHORT = 2000
# Rows of the edit matrix between two states that are kept.
STRIDE = 64


def _common(a: list[int], b: list[int]) -> int:
    """How many words both begin with."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    return next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)


class _States:
    """The states after each number of words of a hypothesis, made when they are asked for.

    As long as the hypothesis is equal to the reference the distances are known: those of the lengths.
    """

    def __init__(self, ref: _Reference, words: list[int]):
        self.ref, self.words = ref, words
        self.same = _common(words, ref.words)
        self.kept: list[tuple[int, int, int]] = []
        self.segments: dict[int, list[tuple[int, int, int]]] = {}

    def equal(self, count: int) -> tuple[int, int, int]:
        """The state after words that are all equal to those of the reference."""
        passed = (1 << count) - 1
        return self.ref.full ^ passed, passed, len(self.ref.words) - count

    def base(self, number: int) -> tuple[int, tuple[int, int, int]]:
        """A place in a segment at or before which all states are known, and its state."""
        at = number * STRIDE
        if at <= self.same:
            at = min(self.same, at + STRIDE)
            return at, self.equal(at)
        first = self.same // STRIDE + 1
        while len(self.kept) <= number - first:
            at, state = self.base(first + len(self.kept) - 1)
            for word in self.words[at : (first + len(self.kept)) * STRIDE]:
                state = self.ref.advance(state, word)[0]
            self.kept.append(state)
        return number * STRIDE, self.kept[number - first]

    def after(self, count: int) -> tuple[int, int, int]:
        """The state after ``count`` words. The last few segments asked for stay, as calls come from near places."""
        if count <= self.same:
            return self.equal(count)
        number = count // STRIDE
        at, state = self.base(number)
        if number not in self.segments:
            if len(self.segments) >= 4:
                self.segments.pop(next(iter(self.segments)))
            self.segments[number] = [state]
        states = self.segments[number]
        for word in self.words[at + len(states) - 1 : count]:
            states.append(self.ref.advance(states[-1], word)[0])
        return states[count - at]

    def steps(self, number: int, end: int) -> list[tuple[int, int]]:
        """Free-diagonal and horizontal-increase bits of the words of a segment, those before ``end``."""
        at, state = self.base(number)
        out = [(self.ref.full, (1 << i) - 1) for i in range(number * STRIDE, at)]
        for word in self.words[at : min(end, (number + 1) * STRIDE)]:
            state, diagonal, increase = self.ref.advance(state, word)
            out.append((diagonal, increase))
        return out


class _Suffixes:
    """Distances of what follows a position in the hypothesis to every suffix of the reference."""

    def __init__(self, ref: _Reference, words: list[int]):
        self.back = _Reference(ref.words[::-1])
        self.states = _States(self.back, words[::-1])
        self.size = len(words)
        self.rows: dict[int, np.ndarray] = {}

    def row(self, at: int) -> np.ndarray:
        """For each reference position the distance of the words from ``at`` on to the rest from there."""
        if at not in self.rows:
            done = self.size - at
            if len(self.rows) >= 2 * STRIDE:
                self.rows.clear()
            self.rows[at] = self.back.row(self.states.after(done), done)[::-1]
        return self.rows[at]


def _alignment(ref: _Reference, words: list[int], states: _States):
    """For each reference word its hypothesis position, and flags for the words that need an edit."""
    segment, steps = -1, []
    ref_wrong, hyp_wrong = [False] * len(ref.words), [False] * len(words)
    aligned = [-1] * len(ref.words)
    after = _common(words[::-1], ref.words[::-1])
    i, j = len(words) - after, len(ref.words) - after
    aligned[j:] = range(i, len(words))
    while i or j:
        if i == j <= states.same:
            # All words before are equal.
            aligned[:j] = range(i)
            break
        take_hyp, take_ref = i > 0, j > 0
        same = False
        if i and j:
            if (i - 1) // STRIDE != segment:
                segment = (i - 1) // STRIDE
                steps = states.steps(segment, i)
            diagonal, increase = steps[i - 1 - segment * STRIDE]
            bit = 1 << (j - 1)
            same = words[i - 1] == ref.words[j - 1]
            if not same and diagonal & bit:
                take_hyp = bool(increase & bit)
                take_ref = not take_hyp
        if take_ref:
            aligned[j - 1] = i - 1
            ref_wrong[j - 1] = not same
        if take_hyp:
            hyp_wrong[i - 1] = not same
        i, j = i - take_hyp, j - take_ref
    return aligned, ref_wrong, hyp_wrong


def _right_run(wrong: list[bool]) -> list[int]:
    """How many words from each position on are right; more than any block where no wrong one follows."""
    runs, run = [0] * len(wrong), 1 << 60
    for i in range(len(wrong) - 1, -1, -1):
        run = 0 if wrong[i] else run + 1
        runs[i] = run
    return runs


def _blocks(ref: _Reference, words: list[int], ref_wrong: list[bool], hyp_wrong: list[bool], limits: ShiftLimits):
    """Every (hypothesis start, reference start, length) of equal words that has an error on both sides."""
    if True not in hyp_wrong:
        return
    hyp_runs, ref_runs = _right_run(hyp_wrong), _right_run(ref_wrong)
    for at in range(max(hyp_wrong.index(True) - limits.size + 1, 0), len(words)):
        word = words[at]
        if hyp_runs[at] >= limits.size:
            continue
        places = ref.places.get(word, ())
        for k in range(bisect_left(places, at - limits.distance), len(places)):
            place = places[k]
            if place > at + limits.distance:
                break
            longest = min(limits.size, len(words) - at, len(ref.words) - place)
            shortest = max(hyp_runs[at], ref_runs[place]) + 1
            length = 1
            while shortest <= longest and length <= longest and words[at + length - 1] == ref.words[place + length - 1]:
                if length >= shortest:
                    yield at, place, length
                length += 1


def _target(at: int, length: int, before: int, size: int) -> int:
    """Where a block goes among the other words."""
    return min(before - length if before > at + length else before, size - length)


def _move(words: list[int], at: int, length: int, target: int) -> list[int]:
    rest = words[:at] + words[at + length :]
    return rest[:target] + words[at : at + length] + rest[target:]


def unmovable_edits(hyp: list[int], reference: list[int]) -> int:
    """Edits that remain in whatever order the words of the hypothesis come."""
    common = (Counter(hyp) & Counter(reference)).total()
    return max(len(hyp), len(reference)) - common


# Blocks that are put in order before their shifts are measured.
BLOCKS = 100_000


def _targets(aligned: list[int], block: tuple[int, int, int]) -> list[int]:
    """The places in the hypothesis that a block may move to."""
    at, place, length = block
    if at <= aligned[place] < at + length:
        return []
    targets = [0] if place == 0 else [aligned[place - 1] + 1]
    targets += [aligned[p] + 1 for p in range(place, place + length)]
    return [before for k, before in enumerate(targets) if not k or before != targets[k - 1]]


def _best_shift(ref: _Reference, words: list[int], edits: int, tried: int, limits: ShiftLimits, room: int):
    """The shift that saves most; then the longest block, the earliest block, the earliest target.

    None saves more than ``room``, and only one that saves something counts. Long blocks can save most and are moved
    first, so that most others need not be.
    """
    states = _States(ref, words)
    aligned, ref_wrong, hyp_wrong = _alignment(ref, words, states)
    rest = _Suffixes(ref, words)
    best = None

    def measure(blocks: list[tuple[int, int, int]]) -> None:
        nonlocal best
        blocks.sort(key=lambda block: -block[2])
        for at, place, length in blocks:
            if best is not None and (min(room, 2 * length), length) < best[0][:2]:
                break
            for before in _targets(aligned, (at, place, length)):
                target = _target(at, length, before, len(words))
                # The words between are passed by the block or the block by them: no move saves more than both ways.
                most = min(room, 2 * min(length, abs(at - target)))
                if most <= 0 or best is not None and (most, length, -at, -before) <= best[0]:
                    continue
                same, end, moved = min(at, target), max(at, target) + length, _move(words, at, length, target)
                state = states.after(same)
                for word in moved[same:end]:
                    state = ref.advance(state, word)[0]
                saved = edits - int((ref.row(state, end) + rest.row(end)).min())
                rank = (saved, length, -at, -before)
                if saved > 0 and (best is None or rank > best[0]):
                    best = rank, moved

    waiting = []
    for block in _blocks(ref, words, ref_wrong, hyp_wrong, limits):
        waiting.append(block)
        if len(waiting) >= BLOCKS:
            measure(waiting)
            waiting = []
        if limits.tried is not None:
            tried += len(_targets(aligned, block))
            if tried >= limits.tried:
                break
    measure(waiting)
    return best, tried


def long_edits(hyp: list[int], reference: list[int]) -> int:
    """:func:`word_edits`, in memory that grows with the words even where the reference is long."""
    if len(reference) <= SHORT:
        return word_edits(hyp, reference)
    ref = _Reference(reference)
    state = ref.start()
    for word in hyp:
        state = ref.advance(state, word)[0]
    return state[2]


def translation_edits(
    hyp: list[int],
    reference: list[int],
    limits: ShiftLimits = ShiftLimits(),
    edits: int | None = None,
    least: int | None = None,
) -> int:
    """Shifts plus word edits that turn the hypothesis into the reference.

    ``edits`` and ``least`` are the word edits and the unmovable ones, where they are known.

    What both end with needs no edit and is aligned word by word, and no block starts in it. Those words are left
    out, but for as many as a block, and the words it is moved over, can reach.
    """
    if not reference:
        return len(hyp)
    least = unmovable_edits(hyp, reference) if least is None else least
    edits = long_edits(hyp, reference) if edits is None else edits
    words, shifts, tried, ref = hyp, 0, 0, None
    while edits > least:
        cut = max(_common(words[::-1], reference[::-1]) - 2 * limits.size - 2, 0)
        if ref is None or len(ref.words) != len(reference) - cut:
            ref = _Reference(reference[: len(reference) - cut])
        end = len(words) - cut
        best, tried = _best_shift(ref, words[:end], edits, tried, limits, edits - least)
        if best is None:
            break
        shifts, edits, words = shifts + 1, edits - best[0][0], best[1] + words[end:]
        if limits.tried is not None and tried >= limits.tried:
            break
    return shifts + edits


def plain_edits(hyp: Texts, ref: Texts) -> np.ndarray:
    """Word edits of every row, from the token codes and the lengths of both sides."""
    return word_edits_by_row(hyp, ref, long_edits)


def translation_edits_by_row(hyp: Texts, ref: Texts, limits: ShiftLimits = ShiftLimits()) -> np.ndarray:
    """:func:`translation_edits` of every row. Only rows with edits that a shift may save are looked at one by one."""
    edits = plain_edits(hyp, ref)
    least = np.maximum(hyp[1], ref[1]) - clipped_matches(hyp, [ref], 1)[:, 0]
    rows = np.flatnonzero((edits > least) & (ref[1] > 0))
    for i, h, r in zip(rows.tolist(), _rows(hyp, rows), _rows(ref, rows)):
        edits[i] = translation_edits(h, r, limits, int(edits[i]), int(least[i]))
    return edits
