"""Streams of prediction files and of evaluations against the batch operators."""

import math
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bitextry.operators import checkpoints
from bitextry.operators.scoring import Bleu, Chrf
from bitextry.plans import jobs
from bitextry.sources import corpora
from bitextry.streaming.early_stop import run_outcomes, watch_runs
from bitextry.streaming.step_metrics import step_score_stream, step_scores, watch_steps

REFS = [f"the reference line number {i} is here" for i in range(20)]


class Counted(Bleu):
    """BLEU whose kernel counts the rows it is given."""

    rows = None

    def statistics(self, hyp, refs):
        seen = Counted.rows

        @F.pandas_udf("string")
        def count(texts: pd.Series) -> pd.Series:
            seen.add(len(texts))
            return texts

        return super().statistics(count(hyp), refs)


def arrive(tmp_path, name, lines):
    """A file that is moved into place whole."""
    held = tmp_path / "held"
    held.write_text("".join(line + "\n" for line in lines), encoding="utf-8")
    target = tmp_path / "run" / name
    target.parent.mkdir(parents=True, exist_ok=True)
    os.rename(held, target)


def test_three_arrivals_score_each_line_once(spark, tmp_path):
    Counted.rows = spark.sparkContext.accumulator(0)
    metrics = [Counted(), Chrf()]
    references = spark.createDataFrame(list(enumerate(REFS)), "line_no int, ref string")
    state, progress = str(tmp_path / "state"), str(tmp_path / "progress")

    def catch_up():
        watch_steps(str(tmp_path / "run"), references, metrics, state, progress).awaitTermination()
        return Counted.rows.value

    arrive(tmp_path, "dev.step_500.pred", [r[:12] for r in REFS])
    assert catch_up() == 20
    # A step in parts: the second one comes first, and alone scores nothing; names that are no predictions are ignored.
    arrive(tmp_path, "dev.step_1000.pred/part-1", [r[:22] for r in REFS[8:]])
    arrive(tmp_path, "eval.pred.trg", ["ignored"])
    assert catch_up() == 20
    arrive(tmp_path, "dev.step_1000.pred/part-0", [r[:22] for r in REFS[:8]])
    arrive(tmp_path, "dev.step_1500.pred", REFS)
    assert catch_up() == 60
    assert catch_up() == 60
    live = {r["step"]: r.asDict() for r in step_scores(spark, state, metrics).collect()}
    files = corpora.find_step_predictions(spark, str(tmp_path / "run"))
    batch = {r["step"]: r.asDict() for r in jobs.score_step_files(spark, files, references, [Bleu(), Chrf()]).collect()}
    assert live == batch and live[1500]["bleu"] == pytest.approx(100)


def test_too_many_lines_are_an_error(spark, tmp_path):
    references = spark.createDataFrame(list(enumerate(REFS)), "line_no int, ref string")
    arrive(tmp_path, "dev.step_5.pred", [*REFS, "one more"])
    query = watch_steps(str(tmp_path / "run"), references, [Bleu()], str(tmp_path / "s"), str(tmp_path / "p"))
    with pytest.raises(Exception, match="20 references, but in step 5 21"):
        query.awaitTermination()


def outcomes_in_batch(log, value, threshold, patience, greater):
    counted = checkpoints.patience_counter(log, value, threshold, greater)
    last = counted.groupBy("run").agg(F.count(F.lit(1)).alias("evaluations"), F.max_by("counter", "step").alias("counter"))
    tracked = jobs.track_checkpoints(log, value, threshold, patience, greater)
    return {r["run"]: tuple(r) for r in tracked.join(last, "run").select("run", "best_step", "best_value", "stop_step", "evaluations", "counter").collect()}


@pytest.mark.parametrize("greater", [False, True])
def test_shuffled_arrivals_and_restarts_equal_the_batch(spark, tmp_path, greater):
    rng = random.Random(4)
    rows = [(run, 500 * i, rng.choice([None, round(rng.random(), 2), 0.5, math.nan])) for run in "abc" for i in range(40)]
    rows += [("empty", i, None) for i in range(12)]
    schema = "run string, step int, eval_loss double"
    rng.shuffle(rows)
    arrivals = str(tmp_path / "log")

    def catch_up():
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
        watch_runs(log, str(tmp_path / "state"), str(tmp_path / "progress"), "eval_loss", 0.05, 7, greater).awaitTermination()

    for part in (rows[:60], rows[60:61], rows[61:]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(arrivals)
        catch_up()
    live = {r["run"]: tuple(r) for r in run_outcomes(spark, str(tmp_path / "state")).collect()}
    want = outcomes_in_batch(spark.createDataFrame(rows, schema), "eval_loss", 0.05, 7, greater)
    assert {k: str(v) for k, v in live.items()} == {k: str(v) for k, v in want.items()}
    assert live["empty"][1] is None and live["empty"][4] == 12


def test_scores_feed_the_early_stop(spark, tmp_path):
    metrics = [Bleu(), Chrf()]
    references = spark.createDataFrame(list(enumerate(REFS)), "line_no int, ref string")
    state = str(tmp_path / "state")
    for step, cut in ((500, 12), (1000, 99), (1500, 20), (2000, 20)):
        arrive(tmp_path, f"dev.step_{step}.pred", [r[:cut] for r in REFS])
        watch_steps(str(tmp_path / "run"), references, metrics, state, str(tmp_path / "p1")).awaitTermination()
        scores = step_score_stream(spark, state, metrics).select(F.lit("mine").alias("run"), "step", "chrf")
        watch_runs(scores, str(tmp_path / "runs"), str(tmp_path / "p2"), "chrf", 0.05, 2, True).awaitTermination()
    found = run_outcomes(spark, str(tmp_path / "runs")).first()
    assert (found["best_step"], found["stop_step"], found["evaluations"]) == (1000, 2000, 4)
    assert found["best_value"] == pytest.approx(100)
