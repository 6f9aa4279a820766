"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document is a set of words weighted by how often they occur. For each of ``samples`` independent draws, every word
has a gamma-distributed rate r and value c and a uniform shift b, which come from a hash of the word and the draw and
so are the same in all documents. The word with the smallest c * exp(-r (t + 1 - b)), where t = floor(log(weight) / r
+ b), is sampled together with t. Two documents draw the same pair with the probability of their
generalised Jaccard similarity, the sum of smaller weights over the sum of larger ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextry.session import checkpointed
from bitextry.operators.numbering import with_ordinal

# Bits of a hash that make one uniform number; four such numbers make the two gamma-distributed ones.
BITS = 13
# A sampled value is ordered by 31 bits of its logarithm and carries 31 bits of the pair's hash.
STEPS, SHIFT = 2.0**20, 1024.0
IDENTITY = 0x7FFFFFFF


@dataclass(frozen=True)
class FingerprintSpec:
    """Draws in a fingerprint; its likeness to another has a standard error of at most ``0.5 / sqrt(samples)``."""

    samples: int = 32
    seed: int = 13


def draws(word: str, log_weight: str, spec: FingerprintSpec) -> list[Column]:
    """For each draw a number that is smallest for the sampled word, and whose low bits name the word and its t.

    A gamma-distributed number with shape 2 is minus the logarithm of the product of two uniform ones.
    """
    size = 2**BITS
    offset = repr(float(np.log(size) * 2))
    out = []
    for k in range(spec.samples):
        bits = f"xxhash64({word}, {spec.seed * 1000 + k})"
        a, b, c, d = (f"((shiftrightunsigned({bits}, {low}) & {size - 1}) + 0.5D)" for low in (51, 38, 25, 12))
        rate = f"({offset}D - ln({a} * {b}))"
        shift = f"(({bits} & 4095) * {1 / 4096!r}D)"
        t = f"floor({log_weight} / {rate} + {shift})"
        log_least = f"(ln({offset}D - ln({c} * {d})) - {rate} * ({t} + 1.0D - {shift}))"
        rank = f"floor(({log_least} + {SHIFT}D) * {STEPS}D)"
        name = f"(({bits} ^ shiftleft({t}, 13)) & {IDENTITY}L)"
        out.append(F.expr(f"shiftleft({rank}, 32) | {name}"))
    return out


def signatures(texts: DataFrame, keys: Sequence[str], spec: FingerprintSpec = FingerprintSpec()) -> DataFrame:
    """``keys``, ``signature`` for the rows of ``texts`` (keys, text, copies) that have a word.

    Words are lower-cased runs between white space; a row that stands there ``copies`` times counts once. Rows that are
    already partitioned by some of the keys are not shuffled.
    """
    words = texts.select(*keys, "copies", F.explode(F.split(F.lower("text"), r"\s+")).alias("_word"))
    weights = (
        words.filter(F.col("_word") != "")
        .groupBy(*keys, "copies", F.xxhash64("_word").alias("_term"))
        .agg(F.count(F.lit(1)).alias("_count"))
        .select(*keys, "_term", F.log(F.col("_count") / F.col("copies")).alias("_log"))
    )
    names = [f"_d{k}" for k in range(spec.samples)]
    least = weights.groupBy(*keys).agg(
        *(F.min(c).alias(n) for c, n in zip(draws("_term", "_log", spec), names, strict=True))
    )
    pairs = F.array(*(F.col(n).bitwiseAND(F.lit(IDENTITY)).cast("int") for n in names))
    return least.select(*keys, pairs.alias("signature"))


def written(signature: Column) -> Column:
    """The fingerprint as text: eight hexadecimal digits per draw; empty for a text without words."""
    digits = F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal draws; 1 for two texts without words, 0 if only one has none."""
    equal = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    share = F.aggregate(equal, F.lit(0), lambda s, x: s + x) / F.size(a)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(share)


def with_next(docs: DataFrame) -> DataFrame:
    """Each different row of ``docs`` (_doc, _text_hash, doc_id, n_chars), its ``copies``, and ids of the next one.

    In ascending order of doc_id, nulls last, then of the text's hash; the first row comes after the last. Only
    ids and lengths are sorted.
    """
    rows = docs.groupBy("_doc", "_text_hash", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("_text_hash")]
    placed = checkpointed(with_ordinal(rows, order, "_place"))
    count = placed.count()
    following = placed.select(
        F.pmod(F.col("_place") - 1, F.lit(max(1, count))).alias("_place"),
        F.col("_doc").alias("_next_id"),
        F.col("_text_hash").alias("_next_hash"),
    )
    return placed.join(following, "_place").drop("_place")


def fingerprint(docs: DataFrame, spec: FingerprintSpec = FingerprintSpec()) -> DataFrame:
    """Fingerprints of the texts of ``docs`` (doc_id, text), of their edited texts, and how alike they are.

    The edited text has the last quarter of its code points, rounded down, replaced by the first as many (or all) of the
    next document: ascending doc_id, then, for equal ids, in the order of a hash of the text, nulls last; after the
    last comes the first. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next, a row for each row of ``docs``.

    Null counts as the empty text. Repeated rows are one document to their neighbours and get equal results. A
    table of one document is its own next.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # Ids and texts that are null need keys that joins accept.
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("_doc"),
        F.xxhash64(F.col("doc_id").isNull(), text).alias("_text_hash"),
        "doc_id",
        text.alias("text"),
    )
    slim = keyed.select("_doc", "_text_hash", "doc_id", F.length("text").cast("long").alias("n_chars"))
    order = checkpointed(with_next(slim))
    whole = keyed.select("_doc", "_text_hash", "text")
    taken = F.floor(F.col("n_chars") / 4).cast("int")
    # Both joins partition the whole texts by the same keys, so that they are shuffled once.
    heads = (
        whole.join(
            order.select(
                F.col("_next_id").alias("_doc"),
                F.col("_next_hash").alias("_text_hash"),
                F.col("_doc").alias("_for_id"),
                F.col("_text_hash").alias("_for_hash"),
                taken.alias("_taken"),
            ).hint("shuffle_hash"),
            ["_doc", "_text_hash"],
        )
        .select(
            F.col("_for_id").alias("_doc"),
            F.col("_for_hash").alias("_text_hash"),
            F.substring("text", F.lit(1), F.col("_taken")).alias("_head"),
        )
        .groupBy("_doc", "_text_hash")
        .agg(F.max("_head").alias("_head"))
    )
    edited = (
        whole.join(order.hint("shuffle_hash"), ["_doc", "_text_hash"])
        .join(heads.hint("shuffle_hash"), ["_doc", "_text_hash"])
        .withColumn(
            "edited",
            F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - taken).cast("int")), F.col("_head")),
        )
    )
    both = edited.select(
        "_doc",
        "_text_hash",
        "copies",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("_which"), F.col("text").alias("text")),
                F.struct(F.lit(1).alias("_which"), F.col("edited").alias("text")),
            )
        ).alias("_t"),
    ).select("_doc", "_text_hash", "copies", "_t.*")
    found = signatures(both, ["_doc", "_text_hash", "_which"], spec)
    drawn = found.groupBy("_doc", "_text_hash").agg(
        F.max(F.when(F.col("_which") == 0, F.col("signature"))).alias("_own"),
        F.max(F.when(F.col("_which") == 1, F.col("signature"))).alias("_edited"),
    )
    # One job, in which both branches read the same shuffled texts.
    kept = checkpointed(
        edited.select(
            "_doc", "_text_hash", "_next_id", "_next_hash", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256")
        ).join(drawn, ["_doc", "_text_hash"], "left")
    )
    following = (
        kept.select(F.col("_doc").alias("_next_id"), F.col("_text_hash").alias("_next_hash"), F.col("_own").alias("_next"))
        .groupBy("_next_id", "_next_hash")
        .agg(F.max("_next").alias("_next"))
    )
    return (
        kept.join(following, ["_next_id", "_next_hash"])
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            written(F.col("_own")).alias("fingerprint"),
            written(F.col("_edited")).alias("edited_fingerprint"),
            likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
            likeness(F.col("_own"), F.col("_next")).alias("near_next"),
        )
    )
