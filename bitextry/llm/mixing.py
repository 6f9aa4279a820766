"""Mixing sources to target weights along a curriculum.

Sources share a total by weight, none beyond a multiple of what it has. A source's documents stand in a seeded
random order, repeated as often as its target asks. Its weight changes over training time; the integral of
that schedule is its cumulative demand for words, and inverting it gives each document its training position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextry.llm.common import fresh_name, without
from bitextry.session import checkpointed

BLANKS = " \t\n\x0b\x0c\r"
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
OUTPUTS = ("size", "source_size", "target", "taken", "takes", "position")
INNER = ("_key", "_bucket", "_order", "_start", "_here", "_before", "_whole", "_rest", "_class", "_asked", "_take")


@dataclass(frozen=True)
class Curriculum:
    """Weights of the sources in code point order, repeating; how often a source may be used; and their schedules.

    ``paces`` has one schedule per weight: factors of the weight at the ``knots`` of training time, linear in
    between. By default the first sources come early, the last ones late.
    """

    weights: tuple[float, ...] = (1, 2, 3)
    most: int = 3
    knots: tuple[float, ...] = (0.0, 0.5, 1.0)
    paces: tuple[tuple[float, ...], ...] = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
    bucket_bits: int = 14
    seed: int = 5


def word_count(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def demand(knots: tuple[float, ...], factors: tuple[float, ...]) -> list[float]:
    """The schedule's integral up to each knot."""
    sums = [0.0]
    for k in range(1, len(knots)):
        sums.append(sums[-1] + (knots[k] - knots[k - 1]) * (factors[k] + factors[k - 1]) / 2)
    return sums


def position_at(share: Column, knots: tuple[float, ...], factors: tuple[float, ...]) -> Column:
    """The training time from 0 to 1 at which this share of a source's words has been asked for."""
    sums = demand(knots, factors)
    out = None
    for k in range(len(knots) - 1, 0, -1):
        slope = (factors[k] - factors[k - 1]) / (knots[k] - knots[k - 1])
        rest = share * sums[-1] - sums[k - 1]
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(factors[k - 1] ** 2) + 2 * slope * rest))
        # The root of the quadratic that stays exact when the slope is zero.
        bottom = F.lit(float(factors[k - 1])) + root
        time = F.lit(knots[k - 1]) + F.when(bottom > 0, 2 * rest / bottom).otherwise(0.0)
        out = time if out is None else F.when(share * sums[-1] <= sums[k], time).otherwise(out)
    return out


def source_targets(sizes: DataFrame, spec: Curriculum) -> DataFrame:
    """``_key, source_size, target, _class`` for each row of ``sizes`` (_key, source_size).

    The first level at which no further source is cut serves all: sources are taken in the order in which a
    growing level would meet their limits. One row per source goes through a single task.
    """
    kinds = len(spec.weights)
    ranked = sizes.withColumn("_class", ((F.row_number().over(Window.orderBy("_key")) - 1) % kinds).cast("int"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in spec.weights)), F.col("_class") + 1)
    limit = F.col("source_size") * F.lit(float(spec.most))
    met = Window.orderBy("_meets", "_key")
    everything = Window.partitionBy()
    return (
        ranked.withColumn("_weight", weight)
        .withColumn("_limit", limit)
        .withColumn("_meets", F.col("_limit") / F.col("_weight"))
        .withColumn(
            "_cut",
            F.coalesce(F.sum("_limit").over(met.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        )
        .withColumn("_open", F.sum("_weight").over(met.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_all") - F.col("_cut")) / F.col("_open"))
        .withColumn("_level", F.max(F.when(F.col("_meets") >= F.col("_level"), F.col("_level"))).over(everything))
        .withColumn("target", F.least(F.coalesce("_level", F.lit(0.0)) * F.col("_weight"), F.col("_limit")))
        .select("_key", "source_size", "target", "_class")
    )


def mix(docs: DataFrame, spec: Curriculum = Curriculum()) -> DataFrame:
    """Add to ``docs`` (doc_id, text, source) what the mix takes of each row, and where.

    ``size``: words of the text, 0 for null. ``source_size``, ``target``: words that its source has, and that the
    mix asks of it. ``taken``: words taken of this row, repeats counted, at most ``most`` times its size; rows
    of a source add up to its target, rounded. ``takes``: position and words of each repeat. ``position``: that
    of the first one, null if the row is not taken.

    Null is a source of its own, after all others. Rows without words are never taken. The order within a source
    comes from a hash of id and text, so reruns agree; repeated rows stand side by side. Columns of ``docs``
    with the names of outputs or inner columns are replaced.
    """
    docs = without(docs, *OUTPUTS, *INNER)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("z"))
    sized = (
        docs.withColumn("size", word_count(F.col("text")))
        .withColumn("_key", key)
        .withColumn("_order", F.xxhash64(F.lit(spec.seed), F.col("doc_id"), F.col("text")))
        .withColumn("_bucket", F.shiftrightunsigned("_order", 64 - spec.bucket_bits))
    )
    # A source of any size is ordered bucket by bucket; the buckets' totals carry over what came before.
    totals = sized.groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"))
    targets = source_targets(totals.groupBy("_key").agg(F.sum("_words").alias("source_size")), spec)
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_key", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start")
    ).join(targets, "_key")
    here = Window.partitionBy("_key", "_bucket").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    size, rest = F.col("size"), F.col("_rest")
    placed = (
        sized.join(starts, ["_key", "_bucket"])
        .withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(here), F.lit(0)))
        .withColumn("_asked", F.round("target").cast("long"))
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("_asked") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("_rest", F.col("_asked") - F.col("_whole") * F.col("source_size"))
        .withColumn("_here", F.greatest(F.lit(0), F.least(rest - F.col("_before"), size)))
        .withColumn("taken", F.col("_whole") * size + F.col("_here"))
    )

    def take(repeat: Column) -> Column:
        share = (repeat * F.col("source_size") + F.col("_before")) / F.col("_asked")
        time = F.lit(None).cast("double")
        for k, factors in enumerate(spec.paces):
            time = F.when(F.col("_class") % len(spec.paces) == k, position_at(share, spec.knots, factors)).otherwise(time)
        words = F.when(repeat < F.col("_whole"), size).otherwise(F.col("_here"))
        return F.struct(time.alias("position"), words.alias("words"))

    repeats = F.sequence(F.lit(0), F.col("_whole").cast("int"))
    takes = F.filter(F.transform(repeats, take), lambda t: t["words"] > 0)
    taken = placed.withColumn("takes", F.when(F.col("taken") > 0, takes).otherwise(F.array().cast("array<struct<position:double,words:bigint>>")))
    taken = taken.withColumn("position", F.try_element_at("takes", F.lit(1))["position"])
    return taken.drop(*INNER)


def in_order(mixed: DataFrame) -> DataFrame:
    """``mixed`` sorted by the position of the first take, in ranges; rows that are not taken come last."""
    keys = (F.col("position").asc_nulls_last(), F.col("source"), F.col("doc_id"))
    return mixed.repartitionByRange(*keys).sortWithinPartitions(*keys)


def training_rows(docs: DataFrame, spec: Curriculum = Curriculum()) -> DataFrame:
    """A row of ``docs`` (doc_id, text, source) for each take of the mix, sorted by ``position`` in ranges.

    A take of some of the words has only those, from the first. The mix is planned without the texts, which then join
    their takes and move to the range of their position. Rows are told apart by 128 bits of hash of all their
    columns; equal rows have the same text, so it need not be known which of them a take is of.
    """
    docs = without(docs, *OUTPUTS, *INNER)
    keys = [fresh_name(docs, "_mix_a"), fresh_name(docs, "_mix_b")]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # A hash skips nulls, so it is told where they are.
    parts = [*columns, *(c.isNull() for c in columns)]
    hashes = [F.xxhash64(F.lit(k), *parts).alias(name) for k, name in enumerate(keys)]
    kept = docs.select("*", *hashes)
    planned = mix(kept.select("doc_id", "text", "source", *keys), spec).drop("text")
    takes = checkpointed(planned.select(*keys, "size", F.explode("takes").alias("_take")))
    once = kept.dropDuplicates(keys)
    rows = once.join(takes.hint("shuffle_hash"), keys).withColumn("position", F.col("_take.position")).drop(*keys)

    @F.pandas_udf("string")
    def first_words(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, counts in batches:
            out = []
            for text, count in zip(texts, counts, strict=True):
                if text is not None and not pd.isna(count):
                    end = 0
                    for match in islice(WORD.finditer(text), int(count)):
                        end = match.end()
                    text = text[:end]
                out.append(text)
            yield pd.Series(out, dtype=object)

    part = F.when(F.col("_take.words") < F.col("size"), F.col("_take.words"))
    cut = rows.withColumn("text", first_words("text", part)).drop("_take", "size")
    # Demand is spread over all of training time, so ranges of equal length serve.
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.least(F.floor(F.col("position") * ranges), F.lit(ranges - 1)).cast("int")
    return cut.repartitionById(ranges, at).sortWithinPartitions("position", "source", "doc_id")
