"""Importance resampling towards a target: hashed n-gram weights, Gumbel noise, and ranks by radix sort.

Word n-grams fall into a fixed number of buckets. A bucket's gain is the log ratio of its smoothed share in the target
to that in the documents. A document's weight is the mean gain of its n-grams, looked up in an array of
gains; with Gumbel noise added, the highest scores are a draw without replacement by weight.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextry.llm import radix
from bitextry.llm.bytewords import utf8, word_lists
from bitextry.llm.common import fresh_name, frozen, short_batches


@dataclass(frozen=True)
class ResamplingSpec:
    """Lengths of the n-grams, number of buckets, share to draw, and which documents may be drawn."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


def bucket_lists(text: bytes | None, spec: ResamplingSpec) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a whole text, repeats included, in arrays of bounded size."""
    tail: list[bytes] = []
    for words in word_lists(text):
        joined = tail + words
        for n in range(spec.shortest, spec.longest + 1):
            # Of the words carried over, only those that a new word completes count again.
            part = joined[max(0, len(tail) - n + 1) :]
            grams = part if n == 1 else list(map(b" ".join, zip(*(part[i:] for i in range(n)))))
            yield np.fromiter(map(zlib.crc32, grams), np.int64, len(grams)) % spec.buckets
        tail = joined[max(0, len(joined) - spec.longest + 1) :]


def bucket_counts(docs: DataFrame, spec: ResamplingSpec) -> np.ndarray:
    """How many n-grams of all texts of ``docs`` (text) fall into each bucket."""
    short_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(spec.buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                for found in bucket_lists(text, spec):
                    sums += np.bincount(found, minlength=spec.buckets)
        used = np.flatnonzero(sums)
        yield pd.DataFrame({"bucket": used, "n": sums[used]})

    counted = docs.select(utf8().alias("text")).mapInPandas(count, "bucket bigint, n bigint")
    counts = np.zeros(spec.buckets, np.int64)
    # One number per bucket comes to the driver, whatever the number of documents.
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the documents."""
    size, s, t = float(len(raw)), raw.astype(float), target.astype(float)
    ratios = (t + 1) * (float(raw.sum()) + size) / ((s + 1) * (float(target.sum()) + size))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from a hash of seed and id; a null id hashes as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, spec: ResamplingSpec = ResamplingSpec()) -> DataFrame:
    """Add ``n_words``, ``n_features``, ``weight`` and ``score`` to every row of ``docs`` (doc_id, text).

    ``target`` (text) says what is looked for. The weight is the floored mean of the gains of all n-grams, 0 without any.
    Null and empty texts have no words, and an empty ``target`` or ``docs`` counts as no n-grams. Repeated rows count as
    often as they stand there. Columns of ``docs`` with the names of the outputs are replaced, others stay.
    """
    values = gains(bucket_counts(docs, spec), bucket_counts(target, spec))
    shared = docs.sparkSession.sparkContext.broadcast(values)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                words = sum(map(len, word_lists(text)))
                n = total = 0
                for found in bucket_lists(text, spec):
                    n, total = n + len(found), total + int(table[found].sum())
                rows.append((words, n, total // n if n else 0))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    found = fresh_name(docs, "_found")
    outputs = ("n_words", "n_features", "weight", "score")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in outputs]
    weighed = docs.withColumn(found, look_up(utf8()))
    return weighed.select(*others, f"{found}.*").withColumn("score", F.col("weight") + noise(F.col("doc_id"), spec.seed))


def draw(weighed: DataFrame, spec: ResamplingSpec = ResamplingSpec()) -> DataFrame:
    """Add ``rank`` to rows of :func:`weigh`: 1, 2, ... for the drawn ones by falling score, null for all others.

    Drawn are ``percent`` of the rows with at least ``least_words`` words, rounded down. Equal scores go by
    smaller doc_id, a null id last; rows that agree in both stay in the order in which they are read.
    """
    rows = frozen(weighed, row=fresh_name(weighed, "_frozen")).drop(fresh_name(weighed, "_frozen"))
    enough = F.col("n_words") >= spec.least_words
    n = rows.filter(enough).count()
    sorted_rows = radix.ranked(rows.filter(enough), [-F.col("score"), F.col("doc_id")])
    drawn = F.col("rank") <= n * spec.percent // 100
    sorted_rows = sorted_rows.withColumn("rank", F.when(drawn, F.col("rank")))
    others = without_rank(rows).filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return sorted_rows.unionByName(others)


def without_rank(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if c.lower() != "rank"))


def resample(docs: DataFrame, target: DataFrame, spec: ResamplingSpec = ResamplingSpec()) -> DataFrame:
    """The drawn rows of ``docs`` (doc_id, text) with all their columns, ``weight``, ``score`` and ``rank``.

    Texts stay out of the sort; the drawn rows find theirs again by a row number.
    """
    row = fresh_name(docs, "_resample_row")
    kept = frozen(docs, row=row)
    weighed = weigh(kept.select("doc_id", "text", row), target, spec).drop("text")
    places = draw(weighed, spec).filter(F.col("rank").isNotNull()).select(row, "weight", "score", "rank")
    names = [F.col(f"`{c}`") for c in kept.columns if c.lower() not in ("weight", "score", "rank")]
    return kept.select(*names).join(places, row).drop(row)
