"""Strict one-to-one joins of tables that run in parallel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextry.session import small


def _fail(wrong: Column, message: str, *values: Column) -> Column:
    """A condition that is true for every row, or an error if ``wrong`` holds for one."""
    text = F.concat_ws(" ", F.lit(message), *(v.cast("string") for v in values))
    return F.when(wrong, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))


def align(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on unique keys; a row without a partner, or with two, is an error, not a dropped or a null row.

    Keys are unique per side, so the shuffle is even whatever the data looks like.
    """
    keys = list(keys)
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), keys, "full_outer")
    place = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    alone = F.col("_l").isNull() | F.col("_r").isNull()
    # The join has placed the rows by these keys.
    counted = both.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return (
        counted.filter(_fail(alone, "sides differ in length: no partner for row", place))
        .filter(_fail(F.col("_n") > 1, "a side has twice the row", place))
        .drop("_l", "_r", "_n")
    )


def pair_with_references(hyps: DataFrame, refs: DataFrame, keys: Sequence[str] = ("line_no",)) -> DataFrame:
    """Hypotheses with their references, one to one."""
    return align(hyps, refs, keys)


# Lines of all steps together that meet their references at once.
LINES_PER_BLOCK = 16_384


def _packed(df: DataFrame, text: str, block: int) -> DataFrame:
    """``block, step, lines``: lines in runs of the same block of line numbers and step, as compressed Arrow data.

    Runs are as long as the order of the rows allows, which changes no result.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            if not batch.num_rows:
                continue
            steps = batch.column(0).to_numpy(zero_copy_only=False)
            blocks = batch.column(1).to_numpy(zero_copy_only=False) // block
            starts = np.flatnonzero(np.append(True, (steps[1:] != steps[:-1]) | (blocks[1:] != blocks[:-1])))
            held, lines = [], batch.select([1, 2])
            for begin, end in zip(starts, np.append(starts[1:], len(steps))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, lines.schema, options=options) as out:
                    out.write_batch(lines.slice(begin, end - begin))
                held.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks[starts]), pa.array(steps[starts], pa.int32()), pa.array(held, pa.binary())],
                names=["block", "step", "lines"],
            )

    rows = df.filter(F.col("line_no").isNotNull()).select("step", F.col("line_no").cast("bigint"), text)
    return rows.mapInArrow(pack, "block bigint, step int, lines binary")


def _unpacked(packed: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Steps, line numbers and texts of packed runs."""
    tables = [pa.ipc.open_stream(lines.as_buffer()).read_all() for lines in packed.column("lines")]
    steps = np.repeat(packed.column("step").to_numpy(), [t.num_rows for t in tables])
    if not tables:
        return steps, np.empty(0, dtype=np.int64), pa.array([], pa.string())
    rows = pa.concat_tables(tables)
    return steps, rows.column(0).to_numpy(), rows.column(1).combine_chunks()


def pair_in_blocks(steps: DataFrame, refs: DataFrame, count: int) -> DataFrame:
    """``step, line_no, hyp, ref`` of ``count`` steps: a join on ``line_no`` that moves compressed runs of lines.

    Lines in the order of their numbers make long runs.
    """
    block = max(LINES_PER_BLOCK // max(count, 1), 1)

    def pair(hyps: pa.Table, refs: pa.Table) -> pa.Table:
        step, line_no, hyp = _unpacked(hyps)
        _, ref_no, ref = _unpacked(refs)
        order = np.argsort(ref_no, kind="stable")
        ref_no = ref_no[order]
        first = np.searchsorted(ref_no, line_no)
        found = np.searchsorted(ref_no, line_no, side="right") - first
        row = np.repeat(np.arange(len(line_no)), found)
        place = np.arange(len(row)) - np.repeat(np.cumsum(found) - found - first, found)
        columns = [step[row], line_no[row], hyp.take(pa.array(row)), ref.take(pa.array(order[place]))]
        return pa.table(columns, names=["step", "line_no", "hyp", "ref"])

    left = _packed(steps, "hyp", block).groupBy("block")
    right = _packed(refs.withColumn("step", F.lit(0)), "ref", block).groupBy("block")
    return left.cogroup(right).applyInArrow(pair, "step int, line_no bigint, hyp string, ref string")


def step_sizes(steps: DataFrame) -> DataFrame:
    """``step, predictions``: the lines of each step."""
    return steps.groupBy("step").agg(F.count(F.lit(1)).alias("predictions"))


def pair_steps_with_references(steps: DataFrame, refs: DataFrame, key: str = "line_no") -> DataFrame:
    """Predictions of many steps with the same references, each of which every step must have once.

    A prediction without a reference, a line that a step has twice, and a step with fewer lines than there are
    references are errors.
    """
    expected = refs.count()
    sizes = step_sizes(steps)
    joined = (
        steps.join(refs.withColumn("_r", F.lit(True)), key, "left")
        # One row per step.
        .join(small(sizes, sizes.count()), "step")
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "step")))
    )
    return (
        joined.filter(_fail(F.col("_r").isNull(), "no reference for row", F.col(key)))
        .filter(_fail(F.col("_n") > 1, "a side has twice the row", F.col(key)))
        .filter(_fail(F.col("predictions") != expected, f"there are {expected} references, but in step", F.col("step")))
        .drop("_r", "_n", "predictions")
    )
