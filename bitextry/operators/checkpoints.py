"""Checkpoint analytics over metric histories ``run, step, <metric>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextry.operators.numbering import running

# Evaluations of one run that a single task sorts.
CHUNK_STEPS = 100_000


def best_checkpoint(
    log: DataFrame, value: str = "eval_loss", greater_is_better: bool = False, runs: Sequence[str] = ("run",)
) -> DataFrame:
    """The best value of each run and the first step that reached it; both null for a run without any value.

    A plain aggregation, no sort.
    """
    sign = -1 if greater_is_better else 1
    row = F.struct((F.col(value) * sign).alias("v"), F.col("step"), F.col(value).alias("raw"))
    ranked = log.groupBy(*runs).agg(F.min(F.when(F.col(value).isNotNull(), row)).alias("b"))
    return ranked.select(*runs, F.col("b.step").alias("best_step"), F.col("b.raw").alias("best_value"))


def patience_counter(
    log: DataFrame,
    value: str = "eval_loss",
    threshold: float = 0.05,
    greater_is_better: bool = False,
    runs: Sequence[str] = ("run",),
    chunk: Column | None = None,
) -> DataFrame:
    """Add ``evaluation`` (from 1), ``improved`` and ``counter``, the evaluations since the last improvement.

    An evaluation improves on the best so far when it is better by more than ``threshold``, or is the
    first. One without a value never does, unless it is the first. Any better value becomes the best. Runs of any length are processed in step chunks.
    """
    runs = list(runs)
    chunk = F.floor(F.col("step") / CHUNK_STEPS) if chunk is None else chunk
    loss = F.col(value) * (-1 if greater_is_better else 1)
    seen = running(
        log,
        runs,
        "step",
        chunk,
        {"evaluation": ("count", F.lit(1), True), "_best": ("min", loss, False)},
    )
    improved = F.col("_best").isNull() | F.coalesce(loss < F.col("_best") - threshold, F.lit(False))
    flagged = seen.withColumn("improved", improved).drop("_best")
    at = F.when(F.col("improved"), F.col("evaluation"))
    marked = running(flagged, runs, "step", chunk, {"_last": ("max", at, True)})
    return marked.withColumn("counter", F.col("evaluation") - F.col("_last")).drop("_last")


def early_stop_step(counted: DataFrame, patience: int = 100, runs: Sequence[str] = ("run",)) -> DataFrame:
    """The first step at which a run's counter reaches the patience; null when it never does."""
    reached = F.when(F.col("counter") >= patience, F.col("step"))
    return counted.groupBy(*runs).agg(F.min(reached).alias("stop_step"))
