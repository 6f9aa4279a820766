"""The worker's index of a broadcast vocabulary."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from bitextry.operators.vocabulary import FIRST_ID, UNKNOWN_ID, TokenIndex, build_vocabulary, encode


class Crowded(TokenIndex):
    """Many tokens with one hash."""

    def _hashes(self, tokens):
        return np.fromiter((hash(t) % 7 for t in tokens.to_pylist()), np.int64, len(tokens))


@pytest.mark.parametrize("kind", [TokenIndex, Crowded])
def test_ids_equal_a_dictionary(kind):
    rng = random.Random(2)
    known = [f"w{i}" for i in range(500)] + ["", "É", "漢"]
    words = rng.choices([*known, None, "unknown", "w9999"], k=3000)
    places = {w: i + FIRST_ID for i, w in enumerate(known)}
    found = kind(pa.array(known)).ids(pa.array(words)).to_pylist()
    assert found == [places.get(w, UNKNOWN_ID) for w in words]


def test_empty_vocabulary_and_no_words():
    index = TokenIndex(pa.array([], pa.string()))
    assert index.ids(pa.array(["a", None])).to_pylist() == [UNKNOWN_ID] * 2
    assert TokenIndex(pa.array(["a"])).ids(pa.array([], pa.string())).to_pylist() == []


def test_a_batch_costs_the_same_with_a_million_tokens():
    batch = pa.array([f"w{i % 4000}" for i in range(100_000)])

    def seconds(size):
        index = TokenIndex(pa.array([f"w{i}" for i in range(size)]))
        times = []
        for _ in range(5):
            start = time.perf_counter()
            index.ids(batch)
            times.append(time.perf_counter() - start)
        return min(times)

    assert seconds(1_000_000) < 5 * seconds(5_000) + 0.01


def test_encode_with_the_index(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "a", None, "zz"]), (2, []), (3, None)], "k int, t array<string>")
    vocabulary = build_vocabulary(spark.createDataFrame([("a",), ("a",), ("b",)], "token string"))
    found = {r.k: r.ids for r in encode(rows, "t", vocabulary, ["k"]).collect()}
    assert found[1] == [4, 3, 3, UNKNOWN_ID, UNKNOWN_ID] and found[2] == []
