"""Distributed prediction with the caller's model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextry.functions.strings import as_column
from bitextry.worker import once

Predictor = Callable[[list], list]


def predict(
    df: DataFrame,
    factory: Callable[[], Predictor],
    inputs: Column | str,
    output: str,
    returns: str = "string",
    batch_size: int = 16,
) -> DataFrame:
    """Add ``output``, one prediction per row.

    ``factory`` runs once per Python worker, whatever the number of its tasks, and loads the model; the predictor it
    returns maps a list of at most ``batch_size`` inputs to as many outputs. Only the input column leaves the JVM, in
    Arrow batches, and no row moves between tasks.
    """

    key = uuid.uuid4().hex

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once("predict", key, factory)
        for batch in batches:
            values = batch.tolist()
            made: list = []
            for i in range(0, len(values), batch_size):
                part = list(model(values[i : i + batch_size]))
                if len(part) != len(values[i : i + batch_size]):
                    raise ValueError("a predictor must return one output per input")
                made += part
            yield pd.Series(made, dtype=object)

    return df.withColumn(output, run(as_column(inputs)))
