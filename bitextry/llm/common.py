"""What the corpus operators share: table access, frozen copies with row ids, size-checked joins."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextry.session import checkpointed
from bitextry.worker import once

# Rows of whole texts that an Arrow batch may hold: workers have a few copies of a batch at once.
TEXTS_PER_BATCH = 2000
T = TypeVar("T")
Query = Callable[[SparkSession, str], DataFrame]


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``TEXTS_PER_BATCH`` rows, for the jobs that follow too."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= TEXTS_PER_BATCH:
        spark.conf.set(setting, str(TEXTS_PER_BATCH))


def held(operator: str, key: str, build: Callable[[], T]) -> T:
    """What an operator keeps in a worker. The next operator takes its place: word caches are large."""
    return once("corpus", f"{operator}-{key}", build, kept=1)


def given_back(rows: Iterator[T]) -> Iterator[T]:
    """``rows``, and then the memory that a task has freed goes back from its worker to the system.

    Idle workers stay alive beside the next jobs, so what one keeps others lack.
    """
    try:
        yield from rows
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def frozen(df: DataFrame, row: str = "_row", part: str | None = None) -> DataFrame:
    """``df`` written to the shared folder with a unique row id, which stays the same when executors are lost.

    ``part`` names a further column for the number of the task that wrote the row.
    """
    numbered = df.withColumn(row, F.monotonically_increasing_id())
    return checkpointed(numbered.withColumn(part, F.spark_partition_id()) if part else numbered)


def by_group(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows placed and sorted so that :func:`whole_groups` finds each group in one piece."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups with the first row of each group, and the number of rows at the end.

    One call per group costs far more than most groups do; here a batch of rows is handled at a time, and a
    group that a batch cuts waits for its rest.
    """
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        changed = np.zeros(len(batch), bool)
        for key in keys:
            values = batch[key].to_numpy()
            changed[1:] |= values[1:] != values[:-1]
            changed[0] |= bool(waiting) and waiting[-1][key].iloc[-1] != values[0]
        starts = np.flatnonzero(changed)
        if not len(starts):
            waiting.append(batch)
            continue
        frame = pd.concat([*waiting, batch.iloc[: starts[-1]]], ignore_index=True)
        shift = len(frame) - starts[-1]
        waiting = [batch.iloc[starts[-1] :]]
        if len(frame):
            bounds = starts + shift
            yield frame, bounds if bounds[0] == 0 else np.concatenate([[0], bounds])
    if waiting:
        frame = pd.concat(waiting, ignore_index=True)
        yield frame, np.array([0, len(frame)])


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its columns of these names, whatever the case of their letters."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))
