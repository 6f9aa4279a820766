"""Bootstrap intervals of mean row scores (Efron 1979; Poisson weights, Chamandy et al. 2012)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextry.functions.draws import counter_draws


def poisson_thresholds(terms: int = 12) -> list[int]:
    """Cumulative Poisson(1) probabilities on the scale of a 32-bit draw."""
    scale, total, out = 2**32, 0.0, []
    for k in range(terms):
        total += math.exp(-1) / math.factorial(k)
        out.append(min(int(total * scale), scale))
    return out


def poisson_weights(first: np.ndarray, second: np.ndarray, replicates: int) -> np.ndarray:
    """How often each row is drawn in each replicate (row, replicate): Poisson(1) counts fixed by the row's two words."""
    drawn = counter_draws(first, second, replicates)
    return np.searchsorted(np.array(poisson_thresholds(), np.int64), drawn.astype(np.int64), side="right")


def bootstrap_replicates(
    df: DataFrame, scores: Sequence[str], key: Column, replicates: int = 1000, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """``by..., replicate, <score>...``: the weighted mean of every score in every replicate.

    Rows are weighted and added up batch by batch, so that a batch sends one row per replicate and group. A null score
    adds nothing to its mean. The draws of a row follow from ``seed`` and its ``key``: one hash gives two words, which
    number its draws.
    """
    by, scores = list(by), list(scores)
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    words = {
        name: F.conv(F.substring(hashed, at, 8), 16, 10).cast("bigint") for name, at in (("_first", 1), ("_second", 9))
    }
    rows = df.select(*by, *(F.col(s).cast("double") for s in scores), *(w.alias(n) for n, w in words.items()))
    sums = [*(f"_sum_{s}" for s in scores), *(f"_mass_{s}" for s in scores)]
    fields = [rows.schema[c] for c in by]
    fields += [T.StructField("replicate", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in sums)]

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]
            for name, group in groups:
                total = np.zeros((replicates, len(sums)))
                for low in range(0, len(group), 1024):
                    part = group.iloc[low : low + 1024]
                    weights = poisson_weights(part["_first"].to_numpy(), part["_second"].to_numpy(), replicates)
                    values = part[scores].to_numpy(np.float64)
                    known = ~np.isnan(values)
                    total += weights.astype(np.float64).T @ np.hstack([np.where(known, values, 0.0), known])
                out = pd.DataFrame(total, columns=sums)
                out.insert(0, "replicate", np.arange(1, replicates + 1, dtype=np.int32))
                for place, (column, value) in enumerate(zip(by, name, strict=True)):
                    out.insert(place, column, pd.Series([value] * replicates, dtype=group[column].dtype))
                yield out

    added = rows.mapInPandas(add_up, T.StructType(fields))
    return added.groupBy(*by, "replicate").agg(
        *(F.try_divide(F.sum(f"_sum_{s}"), F.sum(f"_mass_{s}")).alias(s) for s in scores)
    )


def bootstrap_interval(
    replicates: DataFrame, scores: Sequence[str], confidence: float = 0.95, by: Sequence[str] = ()
) -> DataFrame:
    """``<score>_low, <score>_mid, <score>_high``: median and interval of the replicate means."""
    tail = (1 - confidence) / 2
    at = {"low": tail, "mid": 0.5, "high": 1 - tail}
    return replicates.groupBy(*by).agg(
        *(F.percentile(s, F.lit(p)).alias(f"{s}_{name}") for s in scores for name, p in at.items())
    )
