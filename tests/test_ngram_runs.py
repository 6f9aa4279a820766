"""N-gram matches as runs of sorted numbers, and the tokenizer that leaves spaces alone."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitextry.functions import kernels, tokenizers


def counted(hyp, refs, order):
    def grams(tokens):
        return Counter(tuple(tokens[i : i + order]) for i in range(len(tokens) - order + 1))

    most = Counter()
    for ref in refs:
        most |= grams(ref)
    return sum((grams(hyp) & most).values())


@pytest.mark.parametrize("top", [2, 5, 300, 0x10FFFF])
@pytest.mark.parametrize("refs", [1, 2, 3])
def test_matches_by_one_sort(top, refs, monkeypatch):
    rng = np.random.default_rng(top + refs)
    rows = 12
    sides = [[rng.integers(0, top, rng.integers(0, rng.choice([1, 4, 60]))).tolist() for _ in range(rows)] for _ in range(refs + 1)]
    pairs = [(np.array(sum(side, []), dtype=np.int64), np.array([len(x) for x in side])) for side in sides]
    by_hash = kernels._matches_by_hash
    monkeypatch.setattr(kernels, "_matches_by_hash", None)
    for orders in (1, 4, 6):
        found = kernels.clipped_matches(pairs[0], pairs[1:], orders)
        want = [[counted(sides[0][i], [s[i] for s in sides[1:]], n) for n in range(1, orders + 1)] for i in range(rows)]
        assert found.tolist() == want and by_hash(pairs[0], pairs[1:], orders).tolist() == want


def test_a_text_with_too_many_different_tokens():
    many = np.arange(5000)
    pair = (np.concatenate([many, many, many[:3]]), np.array([5000, 0, 5003]))
    found = kernels.clipped_matches(pair, [(np.concatenate([many, many[:7], many[::-1]]), np.array([5000, 7, 5000]))], 6)
    assert found.tolist() == [[5000 - n for n in range(6)], [0] * 6, [5000, 0, 0, 0, 0, 0]]


def test_tokens_beside_spaces(spark):
    pieces = ["a", "7", ".", ",", "-", " ", "  ", "!", "&", " ", "_", "(", "'"]
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(3000)]
    made = spark.createDataFrame([(x,) for x in lines], "x string")
    out = F.concat(F.lit(" "), "x", F.lit(" "))
    as_written = tokenizers.whitespace_tokens(tokenizers._rewrite(out, tokenizers.MTEVAL_13A_RULES))
    assert made.filter(tokenizers.mteval_13a_tokens("x") != as_written).count() == 0
    assert made.filter(~tokenizers.mteval_13a_tokens("x").eqNullSafe(as_written)).count() == 0
    # Plain lines take one pass.
    assert made.filter(F.regexp_replace(out, tokenizers.MTEVAL_13A_APART, "").contains("!")).count() == 0
