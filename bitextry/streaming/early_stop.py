"""Best checkpoint and early stop of training runs while their evaluations arrive, in any order."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOME = "best_step bigint, best_value double, stop_step bigint, evaluations bigint, counter bigint"
STATE = (
    "steps binary, losses binary, missing binary, evaluations bigint, best double, any boolean, "
    "best_step bigint, last bigint, stop bigint"
)


def lower(a: float, b: float) -> bool:
    """Whether ``a`` is less than ``b``, where NaN is more than any number, as it sorts in a table."""
    return not math.isnan(a) and (math.isnan(b) or a < b)


@dataclass
class Progress:
    """What the evaluations so far, in the order of their steps, amount to; ``last`` is the one that improved last."""

    evaluations: int = 0
    best: float = math.nan
    any: bool = False
    best_step: int | None = None
    last: int = 0
    stop: int | None = None

    def add(self, step: int, loss: float, missing: bool, threshold: float, patience: int) -> None:
        """The rules of ``checkpoints.patience_counter`` for one more evaluation."""
        self.evaluations += 1
        if not self.any or not missing and lower(loss, self.best - threshold):
            self.last = self.evaluations
        if not missing and (not self.any or lower(loss, self.best)):
            self.best, self.best_step = loss, step
        self.any |= not missing
        if self.stop is None and self.evaluations - self.last >= patience:
            self.stop = step


def watch_runs(
    log: DataFrame,
    state: str,
    checkpoint: str,
    value: str = "eval_loss",
    threshold: float = 0.05,
    patience: int = 100,
    greater_is_better: bool = False,
    runs: Sequence[str] = ("run",),
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the best step, the counter and the stop step of each run of a streaming ``log`` (runs..., step, value).

    Each run is a keyed state of its evaluations, 17 bytes each, with the fold over them. An evaluation after the last
    step continues the fold; one that comes late is put in its place and the fold starts again, so any order of arrival ends in
    the answer of the batch operators. A step that arrives again counts once, with its last value. Micro-batches write
    their runs under their number in ``state``, and a restart goes on from ``checkpoint``.
    """
    runs = list(runs)
    loss = F.col(value).cast("double") * (-1 if greater_is_better else 1)
    rows = log.select(*runs, F.col("step").cast("bigint").alias("step"), F.coalesce(loss, F.lit(0.0)).alias("loss"), loss.isNull().alias("missing"))
    keys = T.StructType([rows.schema[r] for r in runs])

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        steps, losses, missing = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        progress = Progress()
        if held.exists:
            old = held.get
            steps, losses, missing = np.frombuffer(old[0], np.int64), np.frombuffer(old[1], float), np.frombuffer(old[2], bool)
            progress = Progress(*old[3:])
        new = pd.concat(list(frames)).dropna(subset=["step"]).drop_duplicates("step", keep="last").sort_values("step")
        fresh = new["step"].to_numpy(np.int64), new["loss"].to_numpy(float), new["missing"].to_numpy(bool)
        done = len(steps)
        if done and len(new) and fresh[0][0] <= steps[-1]:
            stays = ~np.isin(steps, fresh[0])
            steps, losses, missing = (np.concatenate([a[stays], b]) for a, b in zip((steps, losses, missing), fresh))
            order = np.argsort(steps, kind="stable")
            steps, losses, missing = steps[order], losses[order], missing[order]
            progress, done = Progress(), 0
        else:
            steps, losses, missing = (np.concatenate([a, b]) for a, b in zip((steps, losses, missing), fresh))
        for step, x, none in zip(steps[done:].tolist(), losses[done:].tolist(), missing[done:].tolist()):
            progress.add(step, x, none, threshold, patience)
        held.update((steps.tobytes(), losses.tobytes(), missing.tobytes(), *astuple(progress)))
        best = None if not progress.any else progress.best * (-1 if greater_is_better else 1)
        counter = progress.evaluations - progress.last
        outcome = (*key, progress.best_step, best, progress.stop, progress.evaluations, counter)
        columns = [*runs, *(part.split()[0] for part in OUTCOME.split(", "))]
        yield pd.DataFrame([outcome], columns=columns).astype({"best_step": "Int64", "stop_step": "Int64"})

    outcome = T.StructType([*keys, *T.StructType.fromDDL(OUTCOME)])
    grouped = rows.groupBy(*runs)
    followed = grouped.applyInPandasWithState(update, outcome, T.StructType.fromDDL(STATE), "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    writer = followed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_outcomes(spark: SparkSession, state: str, runs: Sequence[str] = ("run",)) -> DataFrame:
    """The latest outcome of each run from what :func:`watch_runs` keeps."""
    table = spark.read.parquet(state)
    names = [c for c in table.columns if c not in (*runs, "epoch")]
    latest = table.groupBy(*runs).agg(F.max_by(F.struct(*names), "epoch").alias("o"))
    return latest.select(*runs, "o.*")
