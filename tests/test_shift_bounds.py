"""Translation edits of rows in which no shift can help, and their bounds."""

import random

import numpy as np
import pytest

from bitextry.functions import shifts
from bitextry.functions.kernels import word_edits
from bitextry.functions.shifts import ShiftLimits, translation_edits, unmovable_edits


@pytest.mark.parametrize("size", [300, shifts.SHORT + 500])
def test_no_shift_is_looked_for_where_none_can_help(size, monkeypatch):
    def searched(*_):
        raise AssertionError("a search for shifts")

    monkeypatch.setattr(shifts, "_best_shift", searched)
    rng = random.Random(4)
    ref = [int(rng.paretovariate(0.8)) for _ in range(size)]
    hyp = [-1 if i % 11 == 5 else w for i, w in enumerate(ref) if i % 7 != 2]
    # Left out or replaced words need an edit each, wherever the others stand.
    assert translation_edits(hyp, ref) == unmovable_edits(hyp, ref) == word_edits(hyp, ref)


def test_bounds_never_exceed_the_edits():
    rng = random.Random(9)
    for _ in range(300):
        hyp, ref = ([rng.randrange(5) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        edits = translation_edits(hyp, ref)
        assert unmovable_edits(hyp, ref) <= edits <= word_edits(hyp, ref)
        assert translation_edits(hyp, ref, ShiftLimits(tried=2)) >= unmovable_edits(hyp, ref)


def test_words_that_both_sides_begin_and_end_with_are_not_passed(monkeypatch):
    calls = []
    advance = shifts._Reference.advance
    monkeypatch.setattr(shifts._Reference, "advance", lambda *args: calls.append(1) or advance(*args))
    ref = list(range(1500))
    hyp = ref[:700] + ref[703:706] + ref[700:703] + ref[706:]
    assert translation_edits(hyp, ref) == 1
    assert len(calls) < 200


def test_edits_of_rows_measured_together():
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 20, 63, 64, 65, 127, 128, 129, 200]) for _ in range(400)]
    refs = [[rng.randrange(30) for _ in range(size)] for size in sizes]
    hyps = [[w for w in ref if rng.random() < 0.8] + [rng.randrange(40)] * rng.randrange(3) for ref in refs]
    for i in range(0, 400, 40):
        hyps[i] = refs[i][5:9] + refs[i][:5] + refs[i][9:]
    sides = [
        (np.array([w for row in rows for w in row], dtype=np.int64), np.array([len(row) for row in rows])) for rows in (hyps, refs)
    ]
    assert shifts.plain_edits(*sides).tolist() == [word_edits(h, r) for h, r in zip(hyps, refs)]
    assert shifts.translation_edits_by_row(*sides).tolist() == [translation_edits(h, r) for h, r in zip(hyps, refs)]
