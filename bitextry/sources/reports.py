"""Score reports as tall ``(metric, value)`` tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tall(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One ``metric, value`` row per numeric column of a wide score table."""
    metrics = [c for c in scores.columns if c not in by]
    doubled = scores.select(*by, *(scores[c].cast("double").alias(c) for c in metrics))
    return doubled.unpivot(list(by), metrics, "metric", "value")


def formatted_record(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores as a validation record shows them: two digits, precisions with one digit in one array, lengths.

    ``scores`` has the columns of BLEU and, if they were asked for, chrF and mean generated length.
    """
    two = [c for c in ("bleu", "chrf", "bleu_bp", "sys_len_avg") if c in scores.columns]
    names = {"bleu_bp": "bp"}
    precisions = F.array(*(F.round(f"bleu_p{n}", 1) for n in range(1, 5)))
    return scores.select(
        *by, *(F.round(c, 2).alias(names.get(c, c)) for c in two), precisions.alias("precisions"), "ref_len", "sys_len"
    )


def write_report(scores: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    tall(scores, by).write.parquet(path)
