"""Vocabularies that are too large to broadcast as a whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitextry.operators import vocabulary
from bitextry.operators.vocabulary import FIRST_ID, UNKNOWN_ID, build_vocabulary, prepare


def test_packed_numbers_come_back():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1, 5])
    lists = vocabulary.packed(numbers, np.array([0, 3, 0, 7, 1, 0]))
    for part, first, last in ((lists, 0, 11), (lists[1:4], 0, 10), (lists[4:], 10, 11)):
        back, at = vocabulary.unpacked(part)
        assert back.tolist() == numbers[first:last].tolist() and at[0] == 0 and at[-1] == last - first
    assert vocabulary.unpacked(lists[:1])[1].tolist() == [0, 0] and vocabulary.unpacked(lists[:0])[0].tolist() == []


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(20_000)]
    made = [(i // 3, i % 3, f"x{i}", words[9 * i : 9 * i + rng.randrange(10)]) for i in range(2000)]
    made += [(9000, 0, None, None), (9001, 0, "e", []), (9002, 0, "u", ["w1", None, "never", "w2"]), (None, 0, "n", ["w1"])]
    return spark.createDataFrame(made, "a int, b int, x string, t array<string>").repartition(5)


@pytest.fixture(scope="module")
def table(spark, rows):
    return build_vocabulary(rows.select(F.explode("t").alias("token")).filter("token is not null and token != 'never'"))


def shown(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("limit", [200, 4000])
def test_a_part_in_place_and_the_rest_by_blocks(spark, rows, table, limit, monkeypatch):
    monkeypatch.setattr(vocabulary, "BLOCK_ELEMENTS", 500)
    whole, part = prepare(table), prepare(table, limit)
    assert whole.whole and not part.whole
    sizes = part.frame.filter(F.col("id") < FIRST_ID + len(part.tokens.value)).agg(F.sum(F.octet_length("token") + 8)).first()[0]
    assert 0 < sizes <= limit
    want = vocabulary.encode(rows, "t", whole, ["a", "b"])
    found = vocabulary.encode(rows, "t", part, ["a", "b"])
    assert found.columns == want.columns and shown(found) == shown(want)
    assert found.filter("a = 9002").first().ids[1:3] == [UNKNOWN_ID] * 2
    strange = want.withColumn("ids", F.concat("ids", F.array(F.lit(-5), F.lit(None).cast("int"), F.lit(999_999_999), F.lit(0))))
    want, found = (vocabulary.decode(strange, "ids", v, ["a", "b"]) for v in (whole, part))
    assert found.columns == want.columns and shown(found) == shown(want)


def test_each_token_is_joined_once_per_block(spark, rows, table):
    keyed = rows.filter("a is not null")
    part = prepare(table, 0)
    assert part.tokens is None
    many = keyed.withColumn("t", F.flatten(F.array_repeat("t", 50)))
    plan = vocabulary.encode(many, "t", part, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    # Elements leave their rows as the values of a block, not one by one with their keys.
    assert "_values" in plan and "array_repeat" not in plan
    assert shown(vocabulary.encode(many, "t", part, ["a", "b"])) == shown(vocabulary.encode(many, "t", prepare(table), ["a", "b"]))


def test_without_any_broadcast_keys_must_identify_rows(spark, table):
    twice = spark.createDataFrame([(1, ["w1", "w2"]), (1, ["w1", "w2"]), (2, ["w2"]), (None, ["w1"])], "k int, t array<string>")
    part = prepare(table, 0)
    ids = {r.token: r.id for r in table.filter("token in ('w1', 'w2')").collect()}
    found = [(r.k, r.ids) for r in vocabulary.encode(twice, "t", part, ["k"]).collect()]
    doubled = (1, [ids["w1"]] * 2 + [ids["w2"]] * 2)
    assert sorted(found, key=repr) == sorted([doubled, doubled, (2, [ids["w2"]]), (None, [])], key=repr)
    found = [(r.k, r.ids) for r in vocabulary.encode(twice.filter("k is null or k = 2"), "t", part, ["k"]).collect()]
    assert sorted(found, key=repr) == sorted([(2, [ids["w2"]]), (None, [])], key=repr)
