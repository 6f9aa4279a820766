"""Ranks by a distributed radix sort: stable counting-sort passes over the digits of a composite integer key.

Rows have positions from 0, which are cut into blocks of a bounded size, one task each. A pass counts the digits of each
block, turns the counts into global offsets, and sends each row to its exact destination: the offset of its digit
and block, plus its place among the block's rows of that digit. So no task holds more than a block, whatever the keys,
and a key that many rows share is spread like any other. Passes go from the last digit of the last key to the first
digit of the first key; the positions after the last pass are the ranks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextry.llm.common import frozen, without
from bitextry.session import checkpointed

LOWEST = -(1 << 63)


@dataclass(frozen=True)
class RadixSpec:
    """Bits of a digit at most, and rows of a block at most; small tables get a block for each shuffle partition."""

    bits: int = 11
    block_rows: int = 1 << 18


def digits(low: int, high: int, bits: int) -> list[tuple[int, int]]:
    """Shift and width of the digits that tell the values from ``low`` to ``high`` apart, the least first."""
    wide = (high - low).bit_length()
    if not wide:
        return []
    count = -(-wide // bits)
    width = -(-wide // count)
    return [(k * width, width) for k in range(count)]


def digit(key: Column, low: int, high: int, shift: int, width: int) -> Column:
    """This digit of ``key`` above ``low``."""
    # A range beyond 63 bits has no signed difference; the key with its sign turned orders as an unsigned number.
    above = key - F.lit(low) if high - low < 1 << 63 else key.bitwiseXOR(F.lit(LOWEST))
    return F.shiftrightunsigned(above, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def place(batches: Iterator[pa.RecordBatch], tag: str, width: int) -> Iterator[pa.RecordBatch]:
    """The rows of one block with their destinations as positions. The block's offsets come before its rows."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    found = table[f"{tag}digit"].to_numpy()
    heads = int((table[f"{tag}pos"].to_numpy() < 0).sum())
    offsets = np.zeros(1 << width, np.int64)
    offsets[found[:heads]] = table[f"{tag}offset"].to_numpy()[:heads]
    rows, found = table.slice(heads), found[heads:]
    order = np.argsort(found, kind="stable")
    ordered = found[order]
    first = np.searchsorted(ordered, ordered)
    destination = np.empty(len(found), np.int64)
    destination[order] = offsets[ordered] + np.arange(len(found)) - first
    rows = rows.drop_columns([f"{tag}block", f"{tag}digit", f"{tag}offset"])
    at = rows.schema.get_field_index(f"{tag}pos")
    yield from rows.set_column(at, f"{tag}pos", pa.array(destination)).to_batches()


def one_pass(rows: DataFrame, tag: str, width: int, blocks: int) -> DataFrame:
    """Rows with block, position and digit, and others: new positions by a stable counting sort by digit."""
    block, pos, found, offset = (f"{tag}{c}" for c in ("block", "pos", "digit", "offset"))
    counts = rows.groupBy(block, found).agg(F.count(F.lit(1)).alias("n"))
    # One row per digit goes through a task here; the rows of a digit below are one per block.
    below = Window.orderBy(found).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.groupBy(found).agg(F.sum("n").alias("all"))
    bases = bases.select(found, F.coalesce(F.sum("all").over(below), F.lit(0)).alias("base"))
    earlier = Window.partitionBy(found).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(F.broadcast(bases), found)
        .select(block, F.lit(-1).cast("long").alias(pos), found, (F.col("base") + F.col("before")).alias(offset))
    )
    stacked = rows.withColumn(offset, F.lit(0).cast("long")).unionByName(offsets, allowMissingColumns=True)
    dealt = stacked.repartitionById(blocks, F.col(block).cast("int")).sortWithinPartitions(pos)
    schema = rows.drop(block, found).schema
    return dealt.mapInArrow(lambda batches: place(batches, tag, width), schema)


def ranked(rows: DataFrame, keys: Sequence[Column], rank: str = "rank", spec: RadixSpec = RadixSpec()) -> DataFrame:
    """Add ``rank``, from 1 in ascending order of the integer ``keys``, the most significant key first.

    A null in a key comes after all numbers. Rows with equal keys keep the order in which they are read. All columns
    of ``rows`` stay, but for one named ``rank``, which is replaced. An empty table stays empty.
    """
    tag = "_radix_"
    while any(c.lower().startswith(tag) for c in rows.columns):
        tag += "_"
    # A key that may be null counts as two: whether it is null, then its number.
    columns = [c for key in keys for c in (key.isNull().cast("long"), F.coalesce(key.cast("long"), F.lit(0)))]
    names = [f"{tag}{i}" for i in range(len(columns))]
    named = rows.select("*", *(c.alias(n) for c, n in zip(columns, names, strict=True)))
    block, pos = f"{tag}block", f"{tag}pos"
    placed = frozen(without(named, rank), row=pos, part=block)
    ends = [f(name).alias(f"{word}{name}") for name in names for f, word in ((F.min, "low"), (F.max, "high"))]
    found = placed.agg(F.count(F.lit(1)).alias("n"), F.max(block).alias("last"), *ends).first()
    n, blocks = found["n"], (found["last"] or 0) + 1
    wanted = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // spec.block_rows))
    size = max(1, -(-n // wanted))
    steps = [
        (name, found[f"low{name}"], found[f"high{name}"], shift, width)
        for name in reversed(names)
        if n
        for shift, width in digits(found[f"low{name}"], found[f"high{name}"], spec.bits)
    ]
    # Without a digit all keys are equal, and one pass gives positions without gaps.
    for name, low, high, shift, width in steps or [(names[0], 0, 0, 0, 1)]:
        digit_here = digit(F.col(name), low, high, shift, width).alias(f"{tag}digit")
        passed = one_pass(placed.select("*", digit_here), tag, width, blocks)
        placed = checkpointed(passed).withColumn(block, F.floor(F.col(pos) / size).cast("int"))
        blocks = -(-n // size) if n else 1
    return placed.withColumn(rank, F.col(pos) + 1).drop(pos, block, *names)
