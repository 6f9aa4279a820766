"""Prediction files of steps and their pairing with references: what is written and moved."""

import os

from pyspark.sql import functions as F

from bitextry.operators.align import pair_in_blocks
from bitextry.plans import views
from bitextry.session import shared_dir
from bitextry.suite.files import numbered_lines, written_steps

WORDS = "some words that every line of these documents has once and again".split()


def stored_documents(spark, tmp_path, ids):
    text = [" ".join(WORDS[(i + j) % 12] for j in range(200)) + f"\nline two of {i}" for i, _ in enumerate(ids)]
    rows = [(doc, t, "en", "web", len(t)) for doc, t in zip(ids, text)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def size_below(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_step_files_take_less_room_than_their_lines(spark, tmp_path):
    sf_dir = stored_documents(spark, tmp_path, [(i * 37) % 1000 for i in range(1000)])
    before = size_below(shared_dir(spark))
    base, refs = written_steps(spark, sf_dir, "room")
    assert size_below(shared_dir(spark)) - before < 400_000
    lines = views.lines(spark, sf_dir).orderBy("doc_id", "line_no").collect()
    assert [(r["line_no"], r["ref"]) for r in refs.orderBy("line_no").collect()] == [(i, r["line"]) for i, r in enumerate(lines)]


def test_ids_that_repeat_or_are_missing(spark, tmp_path):
    sf_dir = stored_documents(spark, tmp_path, [None, 5, 5, 2])
    rows = numbered_lines(spark, sf_dir).orderBy("row_no", "line").collect()
    # A missing id takes numbers but meets no line; lines of equal ids meet each of their numbers.
    assert [r["row_no"] for r in rows] == [2, 3, 4, 4, 5, 5, 6, 6, 7, 7]


def test_lines_move_in_blocks_and_meet_as_in_a_join(spark):
    steps = spark.range(0, 900).select(
        (F.col("id") % 3 * 500).cast("int").alias("step"), F.floor(F.col("id") / 3).alias("line_no"), F.repeat(F.lit("hyp "), 50).alias("hyp")
    )
    steps = steps.withColumn("hyp", F.when(F.col("line_no") % 50 != 7, F.concat("hyp", F.col("line_no").cast("string"))))
    refs = spark.range(-5, 290).select(F.col("id").alias("line_no"), F.concat(F.lit("r"), "id").alias("ref"))
    refs = refs.union(refs.filter("line_no % 7 = 0")).union(spark.createDataFrame([(None, "x")], "line_no bigint, ref string"))
    refs = refs.orderBy(F.rand(3))
    joined = steps.join(refs, "line_no").select("step", "line_no", "hyp", "ref")
    for count in (1, 3, 16_384 // 10, 100_000):
        paired = pair_in_blocks(steps, refs, count)
        assert sorted(map(str, paired.collect())) == sorted(map(str, joined.collect()))
        plan = paired._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(block" in plan and "hashpartitioning(line_no" not in plan
    assert pair_in_blocks(steps.filter("step < 0"), refs, 3).count() == 0
