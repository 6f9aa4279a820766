"""Metrics of evaluation steps, kept up to date while a trainer writes its prediction files.

Two tables below the state folder are all there is to know: the files that have arrived with their lines, and the summed
statistics of each step whose files hold as many lines as there are references. Both are written per
micro-batch, under its number, so a batch that is repeated after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from bitextry.operators.align import pair_in_blocks
from bitextry.operators.scoring import close_scores, row_statistics
from bitextry.session import checkpointed
from bitextry.sources.corpora import STEP_PATTERN, read_step_predictions

# The reader's own columns; without ``content`` no file is opened.
NAMES = "path string, modificationTime timestamp, length bigint, content binary"
FILES = "step int, path string, lines bigint, epoch bigint"


def line_counts(spark: SparkSession, paths: Sequence[str]) -> dict[str, int]:
    """The lines of each file; no text leaves the scan."""
    found = spark.read.text(list(paths)).groupBy(F.col("_metadata.file_path").alias("path")).count().collect()
    counts = {_plain(row["path"]): row["count"] for row in found}
    return {path: counts.get(_plain(path), 0) for path in paths}


def _plain(path: str) -> str:
    """A path as text, however many slashes follow its scheme."""
    scheme, colon, rest = unquote(path).partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if colon else path


def statistics_by_step(paired: DataFrame, metrics: Sequence) -> DataFrame:
    """``step, lines`` and the summed statistics of its rows."""
    stats = row_statistics(paired, metrics, by=["step"])
    sums = [F.sum(n).alias(n) for n in stats.columns if n != "step"]
    return stats.groupBy("step").agg(F.count(F.lit(1)).alias("lines"), *sums)


def watch_steps(
    folder: str,
    references: DataFrame,
    metrics: Sequence,
    state: str,
    checkpoint: str,
    available_now: bool = True,
    files_per_batch: int = 10_000,
    stored: bool = False,
) -> StreamingQuery:
    """Follow ``folder`` for ``dev.step_{N}.pred`` files (or folders of part files) and keep each step's statistics.

    ``references`` has ``line_no, ref``. A file must be moved into place whole. Only names are read to learn what has arrived;
    a new file's lines are counted once, and scored once, when its step has as many lines as there are
    references. Earlier files are never read again. A step with more lines than references is an error.
    With ``stored``, the references come from a table that stays as it is, and are not written again.
    """
    refs = references.select("line_no", "ref")
    refs = refs if stored else checkpointed(refs, "zstd")
    expected = refs.count()
    arrivals = (
        references.sparkSession.readStream.format("binaryFile")
        .schema(NAMES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path")
    )

    def take_in(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        step = F.regexp_extract("path", STEP_PATTERN.pattern, 1)
        # At most ``files_per_batch`` names.
        new = {row["path"]: int(row["step"]) for row in batch.select("path", step.alias("step")).filter(step != "").collect()}
        if not new:
            return
        counts = line_counts(session, list(new))
        rows = session.createDataFrame([(new[p], p, n) for p, n in counts.items()], "step int, path string, lines bigint")
        rows.write.mode("overwrite").parquet(f"{state}/files/epoch={epoch}")
        files = complete_steps(session, state, epoch, expected, set(new.values()))
        if not files:
            return
        paired = pair_in_blocks(read_step_predictions(session, files), refs, len(files))
        sums = statistics_by_step(paired, metrics)
        sums.filter(_exactly(expected)).write.mode("overwrite").parquet(f"{state}/sums/epoch={epoch}")

    writer = arrivals.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def complete_steps(
    spark: SparkSession, state: str, epoch: int, expected: int, steps: set[int]
) -> dict[int, list[str]]:
    """The files of those ``steps`` that this micro-batch has made complete, in the order of their names."""
    files = spark.read.schema(FILES).parquet(f"{state}/files").filter(F.col("epoch") <= epoch)
    earlier = F.sum(F.when(F.col("epoch") < epoch, F.col("lines")).otherwise(0))
    full = (
        files.filter(F.col("step").isin(*steps))
        .groupBy("step")
        .agg(F.sum("lines").alias("n"), earlier.alias("before"), F.sort_array(F.collect_set("path")).alias("paths"))
        .filter((F.col("n") >= expected) & (F.col("before") < expected))
        .collect()
    )
    for row in full:
        if row["n"] > expected:
            raise ValueError(f"there are {expected} references, but in step {row['step']} {row['n']} predictions")
    return {row["step"]: row["paths"] for row in full}


def _exactly(expected: int) -> Column:
    wrong = F.raise_error(F.concat(F.lit("lines without a reference in step "), F.col("step").cast("string")))
    return F.when(F.col("lines") == expected, F.lit(True)).otherwise(wrong.cast("boolean"))


def sums_schema(spark: SparkSession, metrics: Sequence) -> T.StructType:
    """The schema of the statistics table."""
    empty = spark.createDataFrame([], "step int, hyp string, ref string")
    return statistics_by_step(empty, metrics).schema


def step_scores(spark: SparkSession, state: str, metrics: Sequence) -> DataFrame:
    """``step`` and its scores from the state that :func:`watch_steps` keeps."""
    sums = spark.read.schema(sums_schema(spark, metrics)).option("recursiveFileLookup", "true").parquet(f"{state}/sums")
    return close_scores(sums, metrics, ["step"])


def step_score_stream(spark: SparkSession, state: str, metrics: Sequence) -> DataFrame:
    """The same as a stream: steps come as their statistics do."""
    schema = sums_schema(spark, metrics)
    sums = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{state}/sums")
    return close_scores(sums, metrics, ["step"])
