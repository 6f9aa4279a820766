"""Ordered text files: numbered scans over file lists, and sinks whose part files follow line order."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitextry.functions.strings import as_column, clean_output
from bitextry.session import checkpointed, small

# File blocks, each one short row, that a broadcast may hold; at 128 MB a block this is beyond 100 TB.
BLOCK_LIMIT = 1_000_000

_ROOT = r"^file:/+"


def _listed_files(spark: SparkSession, groups: Mapping[str, Sequence[str]]) -> list[tuple[str, int, str]]:
    """(group, position, file) in list order; a folder stands for its files in name order."""
    rows = []
    for group, paths in groups.items():
        files = [uri for path in paths for uri in sorted(spark.read.text(path).inputFiles())]
        rows += [(group, i, uri) for i, uri in enumerate(files)]
    return rows


def scan_groups(
    spark: SparkSession, groups: Mapping[str, Sequence[str]], column: str = "text", freeze: bool | None = None
) -> DataFrame:
    """``group, line_no, <column>``: the lines of each group's file list, numbered from 0 in list order.

    Line numbers need two passes and no sort: count the lines of every file block, add the counts up
    in (file, block) order, then add the position inside the block. A block's lines stay together
    in one task, so that position is a difference of row ids.

    The counting pass runs at once; its result is checkpointed and so small that the second pass
    needs no shuffle. Both passes must see the same blocks. With dynamic allocation block sizes may
    move between them, so the rows are then checkpointed first (``freeze``); a mismatch raises either way.
    """
    listed = _listed_files(spark, groups)
    if freeze is None:
        freeze = spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true"
    files = spark.createDataFrame(listed, "group string, file_ord int, file string").withColumn(
        "file", F.regexp_replace("file", _ROOT, "file:/")
    )
    paths = list(dict.fromkeys(path for each in groups.values() for path in each))
    rows = spark.read.text(paths).select(
        F.col("value").alias(column),
        F.regexp_replace("_metadata.file_path", _ROOT, "file:/").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    if freeze:
        rows = checkpointed(rows)
    blocks = (
        rows.groupBy("file", "block")
        .agg(F.count(F.lit(1)).alias("block_lines"), F.min("row_id").alias("first_id"))
        .join(small(files, len(listed)), "file")
    )
    # One row per file, then one per block of a file: far fewer than lines, and never one big group.
    of_group = Window.partitionBy("group").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy("group", "file_ord").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    file_starts = (
        blocks.groupBy("group", "file_ord")
        .agg(F.sum("block_lines").alias("file_lines"))
        .select("group", "file_ord", F.coalesce(F.sum("file_lines").over(of_group), F.lit(0)).alias("file_start"))
    )
    starts = checkpointed(
        blocks.withColumn("block_start", F.coalesce(F.sum("block_lines").over(of_file), F.lit(0)))
        .join(small(file_starts, len(listed)), ["group", "file_ord"])
        .select(
            "file",
            "block",
            "group",
            "block_lines",
            "first_id",
            (F.col("file_start") + F.col("block_start") - F.col("first_id")).alias("shift"),
        )
    )
    inside = F.col("row_id") - F.col("first_id")
    # A filter, which no later choice of columns takes away.
    checked = F.when(
        inside.isNull() | (inside < 0) | (inside >= F.col("block_lines")),
        F.raise_error(F.concat(F.lit("file blocks changed while lines were numbered: "), F.col("file"))).cast("boolean"),
    ).otherwise(F.lit(True))
    placed = rows.join(small(starts, starts.count(), BLOCK_LIMIT), ["file", "block"], "left").filter(checked)
    # Columns of both sides, so that a later filter on the group cannot turn the join into an inner one.
    group = F.when(inside.isNotNull(), F.col("group"))
    return placed.select(group.alias("group"), (F.col("shift") + F.col("row_id")).alias("line_no"), column)


def read_lines(spark: SparkSession, paths: str | Sequence[str], column: str = "text") -> DataFrame:
    """``line_no, <column>``: the lines of a file list in list order, blank lines included."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return scan_groups(spark, {"all": paths}, column).select("line_no", column)


def _in_line_order(df: DataFrame, order_by: str, lines_per_file: int) -> DataFrame:
    """Partitions that follow each other in ``order_by`` order, each sorted.

    The bounds come from a pass over the key column alone, so whatever made the text (a model, say)
    runs once. Numbers with large gaps could crowd into few partitions; those are range-partitioned by
    sample instead.
    """
    rows, low, high = df.agg(F.count(order_by), F.min(order_by), F.max(order_by)).first()
    if not rows:
        return df.coalesce(1)
    span = high - low + 1
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(rows / lines_per_file), min(cores, math.ceil(rows / 1000)))
    if span > 2 * rows:
        placed = df.repartitionByRange(parts, order_by)
    else:
        width = math.ceil(span / parts)
        placed = df.repartitionById(parts, F.floor((F.col(order_by) - low) / width).cast("int"))
    return placed.sortWithinPartitions(order_by)


def write_lines(
    df: DataFrame,
    text: Column | str,
    path: str,
    order_by: str = "line_no",
    lines_per_file: int = 1_000_000,
    compression: str | None = None,
) -> None:
    """One line per row. Part files, read in name order, give the rows in ``order_by`` order.

    A compressed part file is read by one task, so ``lines_per_file`` is then also the most lines of a task.

    A line break inside a row would shift every later line, so it is an error; so is a null.
    """
    text = as_column(text)
    one_line = F.when(
        text.isNull() | text.rlike(r"[\r\n]"), F.raise_error(F.lit("each row must be exactly one line")).cast("string")
    ).otherwise(text)
    lines = df.select(F.col(order_by), one_line.alias("value"))
    _in_line_order(lines, order_by, lines_per_file).select("value").write.text(path, compression=compression)


def write_batch_tagged(df: DataFrame, text: Column | str, path: str, batch_size: int, order_by: str = "line_no") -> None:
    """``batch:{j}<TAB>{text}`` per row, ``j`` being the row's batch."""
    batch = F.floor(F.col(order_by) / batch_size).cast("string")
    tagged = F.concat(F.lit("batch:"), batch, F.lit("\t"), clean_output(text))
    write_lines(df.select(order_by, tagged.alias("value")), "value", path, order_by)
