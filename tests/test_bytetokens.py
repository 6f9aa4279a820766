"""Words found in bytes against the column tokenizers, and n-gram matches of pairs against hash tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitextry.functions import bytetokens, kernels
from bitextry.functions.strings import WHITESPACE
from bitextry.functions.tokenizers import mteval_13a_tokens, whitespace_tokens

PARTS = [
    *" .,-0123&;<>\t\n\r\x0b\x1c\x1f\x85\xa0 ᠎ ​   　",
    *"abzÄßéñ«»¿İ中\U0001f600!\"#$%'()*+/:=?@[\\]^_`{|}~",
    "<skipped>", "&quot;", "&amp;", "1,5", "3.", "...", "x-1", "1-x", " 7-", "wort ", "-\n",
]


def hostile(count):
    rng = random.Random(count)
    made = ["".join(rng.choices(PARTS, k=rng.randrange(40))) for _ in range(count)]
    plain = ["".join(rng.choices([p for p in PARTS if p not in ".,&\n" and len(p) < 3], k=30)) for _ in range(count)]
    return [None, "", " ", "　", *made, None, *plain]


@pytest.mark.parametrize("limit", [7, 1_000_000])
def test_words_are_those_of_the_columns(spark, limit, monkeypatch):
    monkeypatch.setattr(bytetokens, "BYTES_PER_SLICE", limit)
    texts = hostile(1500)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    rows = frame.select(
        whitespace_tokens("t").alias("plain"),
        mteval_13a_tokens("t").alias("marked"),
        F.when(bytetokens.needs_order(F.col("t")), mteval_13a_tokens("t")).alias("given"),
        F.regexp_replace("t", f"(?U){WHITESPACE}+", "").alias("squeezed"),
    ).collect()
    column = pa.concat_arrays([pa.array(texts[:9]), pa.array(texts[9:])]).slice(0)
    given = pa.array([r["given"] for r in rows], pa.list_(pa.string()))
    assert bytetokens.words(column).to_pylist() == [r["plain"] or [] for r in rows]
    assert bytetokens.ordered_words(column, given).to_pylist() == [r["marked"] or [] for r in rows]
    assert bytetokens.squeezed(column).to_pylist() == [r["squeezed"] or "" for r in rows]
    assert sum(r["given"] is None for r in rows) > 1000
    assert bytetokens.words(column.slice(5, 50)).to_pylist() == [r["plain"] or [] for r in rows[5:55]]


def test_scores_of_texts_make_no_token_columns(spark):
    from bitextry.operators.scoring import Bleu, Chrf, Ter, row_statistics

    pairs = spark.createDataFrame([("a b", "a c")], "hyp string, ref string")
    plan = row_statistics(pairs, [Bleu(), Chrf(), Ter()])._jdf.queryExecution().executedPlan().toString()
    # Once per side, for texts that need the rules in order.
    assert plan.count("split(") == 2


def test_matches_of_pairs():
    rng = random.Random(3)
    for size in (0, 1, 2, 7, 60):
        sides = []
        for _ in range(2):
            lengths = np.array([rng.randrange(size + 1) for _ in range(50)], dtype=np.int64)
            sides.append((np.array([rng.randrange(4) for _ in range(lengths.sum())], dtype=np.int64), lengths))
        for order in (1, 2, 4, 6):
            found = kernels.clipped_matches(sides[0], [sides[1]], order)
            assert (found == kernels._matches_by_hash(sides[0], [sides[1]], order)).all()
