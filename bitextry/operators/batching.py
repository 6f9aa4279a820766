"""Row selection and batches, all by explicit line numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextry.functions.arrays import attention_mask, pad
from bitextry.functions.draws import permute, round_keys
from bitextry.operators.numbering import shuffled_ordinal
from bitextry.session import checkpointed


def head(df: DataFrame, n: int, line_no: str = "line_no") -> DataFrame:
    """The rows numbered below ``n``; fewer than ``n`` of them is an error."""
    picked = df.filter(F.col(line_no) < n)
    found = picked.count()
    if found < n:
        raise ValueError(f"asked for the first {n} rows, but there are only {found}")
    return picked


def ordered_head(df: DataFrame, order_by: Sequence[str], n: int, line_no: str = "line_no") -> DataFrame:
    """The first ``n`` rows in ``order_by`` order with their numbers; fewer of them is an error.

    Each task sends its own first rows at most, so nothing is sorted or written as a whole.
    """
    picked = checkpointed(df.orderBy(*order_by).limit(n))
    numbered = picked.withColumn(line_no, F.row_number().over(Window.orderBy(*order_by)) - 1)
    return head(numbered, n, line_no)


def batch_id(line_no: Column | str, size: int) -> Column:
    """Consecutive batches of ``size`` rows; the last one may be short."""
    line_no = F.col(line_no) if isinstance(line_no, str) else line_no
    return F.floor(line_no / size).cast("bigint")


def pad_to_longest(df: DataFrame, ids: str, batch: str, pad_id: int = 0, side: str = "right") -> DataFrame:
    """Pad each row to the longest row of its batch and add ``attention_mask`` and ``width``.

    A batch holds a fixed number of rows, so no window partition can grow.
    """
    width = F.max(F.size(ids)).over(Window.partitionBy(batch))
    sized = df.withColumn("width", width)
    return sized.withColumns(
        {"attention_mask": attention_mask(ids, F.col("width"), side), ids: pad(ids, F.col("width"), pad_id, side)}
    )


def seeded_batches(df: DataFrame, key: Column, batch_size: int, max_steps: int, seed: int = 42) -> DataFrame:
    """Shuffled training batches: ``epoch, step`` for ``max_steps`` batches, repeating the data as needed.

    The order of every epoch depends on the seed, the epoch and the row key only. Batches run across
    the end of an epoch, so each of them is full.
    """
    rows = df.count()
    wanted = batch_size * max_steps
    if not rows or not wanted:
        raise ValueError("no rows to batch")
    epochs = math.ceil(wanted / rows)
    repeated = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    done = F.col("epoch").cast("bigint") * rows
    shuffled = shuffled_ordinal(
        repeated, F.concat_ws(":", "epoch", key), seed, "position", ["epoch"], F.lit(wanted) - done, epochs
    )
    return shuffled.withColumn("step", batch_id(F.col("position") + done, batch_size))


def permuted_batches(
    df: DataFrame, batch_size: int, max_steps: int, seed: int = 42, line_no: str = "line_no", rows: int | None = None
) -> DataFrame:
    """Shuffled training batches of numbered rows: ``epoch, position, step``, repeating the data as needed.

    Each epoch's order is a keyed permutation of the row numbers, so nothing is sorted or shuffled, and a row is copied
    only to epochs in which it has a place before ``max_steps`` batches are full. ``rows`` is the number of rows, which
    are numbered from 0; other numbers are errors.
    """
    rows = df.count() if rows is None else rows
    wanted = batch_size * max_steps
    if not rows or not wanted:
        raise ValueError("no rows to batch")
    keys = [round_keys(seed, epoch) for epoch in range(math.ceil(wanted / rows))]

    @F.pandas_udf("array<struct<epoch int, position bigint>>")
    def places(numbers: pd.Series) -> pd.Series:
        if numbers.isna().any() or ((numbers < 0) | (numbers >= rows)).any():
            raise ValueError(f"rows must be numbered from 0 to {rows - 1}")
        out: list[list[dict]] = [[] for _ in range(len(numbers))]
        for epoch, epoch_keys in enumerate(keys):
            positions = permute(numbers.to_numpy(np.uint64), rows, epoch_keys)
            for i in np.flatnonzero(positions < wanted - epoch * rows):
                out[i].append({"epoch": epoch, "position": int(positions[i])})
        return pd.Series(out)

    placed = df.withColumn("_place", F.explode(places(F.col(line_no).cast("bigint")))).select("*", "_place.*").drop("_place")
    return placed.withColumn("step", batch_id(F.col("position") + F.col("epoch").cast("bigint") * rows, batch_size))
