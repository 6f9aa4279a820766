"""Row numbers and running values that never put a whole table, or a whole key, in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextry.session import checkpointed, small

HASH_BUCKETS_HEX = 4


def with_ordinal(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "row_no", start: int = 0, compression: str | None = None
) -> DataFrame:
    """Add the position of each row in ``order_by`` order.

    The range-partitioned sort is written out, so that partition ids stay put when executors are
    lost. Then one count per partition is added up; the numbers themselves need no further shuffle.
    """
    placed = checkpointed(
        df.orderBy(*order_by).select(
            "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")
        ),
        compression,
    )
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))
    # One row per sort partition, of which there are at most spark.sql.shuffle.partitions.
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        "_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + start).alias("_shift")
    )
    return (
        placed.join(small(shifts, most), "_part")
        .withColumn(name, F.col("_shift") + F.col("_id"))
        .drop("_part", "_id", "_shift")
    )


def shuffled_ordinal(
    df: DataFrame,
    key: Column,
    seed: int,
    name: str = "row_no",
    by: Sequence[str] = (),
    keep: Column | None = None,
    groups: int = 1,
) -> DataFrame:
    """Add each row's position in a seeded random order: the order of ``md5(seed, key)``, then ``key``.

    Hash prefixes cut the order into even buckets. Their counts give each bucket's offset, so a row is
    ranked inside its bucket only. Positions start anew per ``by`` group, of which there are ``groups``.
    Rows at or beyond position ``keep`` are left out, whole buckets of them before any shuffle.
    """
    by = list(by)
    hashed = df.withColumn("_key", key).withColumn(
        "_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_key")).cast("binary"))
    )
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, HASH_BUCKETS_HEX))
    # At most 16 ** HASH_BUCKETS_HEX rows per group.
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*by, "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    )
    if keep is not None:
        starts = starts.filter(F.col("_start") < keep)
    ranked = Window.partitionBy(*by, "_bucket").orderBy("_hash", "_key")
    out = (
        hashed.join(small(starts, groups * 16**HASH_BUCKETS_HEX), [*by, "_bucket"])
        .withColumn(name, F.col("_start") + F.row_number().over(ranked) - 1)
        .drop("_key", "_hash", "_bucket", "_start")
    )
    return out if keep is None else out.filter(F.col(name) < keep)


def _with_carried(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one row per ``keys`` and chunk to its rows; null keys and null chunks are values like others."""
    renamed = carried.select(*(F.col(k).alias(f"_of_{k}") if k in keys else F.col(k) for k in carried.columns))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(renamed, same)


_AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str,
    chunk: Column,
    values: Mapping[str, tuple[str, Column, bool]],
) -> DataFrame:
    """Running aggregates per key in ``order_by`` order, split into chunks.

    ``values`` maps a new column to (``count|sum|min|max``, expression, inclusive). ``chunk`` must not
    decrease along ``order_by``; rows whose order is null come first, and rows with a null key are a key of their own.
    A key that holds a third of the table is sorted chunk by chunk in many
    tasks; the chunk totals, one row per chunk, carry over what came before.
    """
    keys = list(keys)
    inputs = df.withColumn("_chunk", chunk)
    for name, (_, expression, _) in values.items():
        inputs = inputs.withColumn(f"_in_{name}", expression)
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(order_by)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = inputs.groupBy(*keys, "_chunk").agg(
        *(_AGGREGATES[kind](f"_in_{name}").alias(f"_all_{name}") for name, (kind, _, _) in values.items())
    )
    carried = totals.select(
        *keys,
        "_chunk",
        *(
            (F.sum if kind == "count" else _AGGREGATES[kind])(f"_all_{name}").over(across).alias(f"_carry_{name}")
            for name, (kind, _, _) in values.items()
        ),
    )
    local = inputs.select(
        *df.columns,
        "_chunk",
        *(
            _AGGREGATES[kind](f"_in_{name}")
            .over(in_chunk.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
            .alias(f"_here_{name}")
            for name, (kind, _, inclusive) in values.items()
        ),
    )
    out = _with_carried(local, carried, [*keys, "_chunk"])
    columns = []
    for name, (kind, _, _) in values.items():
        here, carry = F.col(f"_here_{name}"), F.col(f"_carry_{name}")
        if kind in ("count", "sum"):
            combined = F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))
        else:
            combined = F.least(here, carry) if kind == "min" else F.greatest(here, carry)
        columns.append(combined.alias(name))
    return out.select(*df.columns, *columns)


def following(df: DataFrame, keys: Sequence[str], order_by: str, chunk: Column, columns: Sequence[str]) -> DataFrame:
    """Add ``next_<column>`` of the next row per key, chunk by chunk as in :func:`running`."""
    keys = list(keys)
    row = F.struct(order_by, *columns)
    inputs = df.withColumn("_chunk", chunk)
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(order_by)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    firsts = inputs.groupBy(*keys, "_chunk").agg(F.min_by(row, order_by).alias("_first"))
    carried = firsts.select(*keys, "_chunk", F.lead("_first").over(across).alias("_carry"))
    out = _with_carried(inputs.withColumn("_next", F.lead(row).over(in_chunk)), carried, [*keys, "_chunk"])
    following_row = F.coalesce("_next", "_carry")
    return out.select(*df.columns, *(following_row[c].alias(f"next_{c}") for c in columns))
