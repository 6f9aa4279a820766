"""Token counts of whole texts by a sentence-piece model, looked up word by word.

Two tiers answer for a word: a broadcast table with the token counts of frequent words, and a cache in each worker
for the others, which are encoded when they are first met. No word is ever shuffled with its text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextry.llm.common import held, short_batches, without
from bitextry.worker import content_key

SPACE = "▁"  # how the model writes a blank
RUNS = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
Word = str | tuple[str]
Measure = Callable[[list[str]], list[int]]


@dataclass(frozen=True)
class CountSpec:
    """Words in the broadcast table; a word's least share of a task's words to be proposed for it; words in a cache.

    The table and the caches only save time: the counts are the same without them.
    """

    table: int = 65_536
    share: float = 1 / 50_000
    cache: int = 300_000


def piece_measure(path: str) -> Measure:
    """Numbers of tokens by a sentence-piece file, without begin and end.

    The file must have no piece that goes on after a blank, or that has a line break: then stretches between them
    are encoded alike wherever they stand.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(SPACE in piece.lstrip(SPACE) or "\n" in piece for piece in pieces):
        raise ValueError(f"{path} has pieces across words")
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]


def words(text: str) -> list[Word]:
    """The stretches of ``text`` that are encoded on their own.

    A stretch stands for itself with the blank before it, which the model puts before any text; one
    that begins with a line break has none, see :func:`measured`. Texts with blanks at unusual places keep
    their line breaks inside stretches, and further blanks in front of them; there, a stretch that begins with
    a line break but has a blank before it is a tuple of one.
    """
    if not text:
        return []
    if "  " in text or SPACE in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
        first, *others = RUNS.findall(text)
        found = [first, *(run[1:] for run in others)]
        return [(word,) if word[:1] == "\n" else word for word in found]
    return text.replace("\n", " \n").split(" ")


def measured(measure: Measure, stretches: list[Word]) -> list[int]:
    """Tokens of each stretch where it stands in a text."""
    counts = measure([word[0] if isinstance(word, tuple) else word for word in stretches])
    # An empty stretch is a blank at the end of a text; before a line break, the model adds a blank of its own.
    return [
        1 if not word else count - 1 if isinstance(word, str) and word[0] == "\n" else count
        for word, count in zip(stretches, counts, strict=True)
    ]


class Lookup:
    """Counts of words: the broadcast table first, then what this worker has met."""

    def __init__(self, table: dict[Word, int], measure: Measure, limit: int) -> None:
        self.table, self.measure, self.limit = table, measure, limit
        self.known = dict(table)

    def totals(self, texts: list[str]) -> list[int]:
        parts = [words(text) for text in texts]
        if len(self.known) > len(self.table) + self.limit:
            self.known = dict(self.table)
        known = self.known
        new = list({word for part in parts for word in part if word not in known})
        known.update(zip(new, measured(self.measure, new), strict=True))
        return [sum(map(known.__getitem__, part)) for part in parts]


def frequent(docs: DataFrame, spec: CountSpec) -> list[str]:
    """The words of ``docs`` (text) that occur most, over all rows.

    Each task counts its own words, keeps those with their least share, and hands on no more than the inverse
    of that share; a word that has the share in the whole table has it in some task.
    """

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[Word] = Counter()
        total = seen = 0
        for batch in batches:
            for text in batch["text"]:
                part = words(text)
                total += len(part)
                counts.update(part)
            if len(counts) > spec.cache:
                # Lossy counting: what is this rare so far cannot have the share yet.
                seen += 1
                counts = Counter({w: n for w, n in counts.items() if n > seen})
        kept = [(w, n) for w, n in counts.items() if n >= total * spec.share and isinstance(w, str)]
        yield pd.DataFrame(kept, columns=["word", "n"])

    proposed = docs.filter(F.length("text") > 0).select("text").mapInPandas(summary, "word string, n bigint")
    top = proposed.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(spec.table)
    return [row.word for row in top.collect()]


def count_tokens(docs: DataFrame, measure: Callable[[], Measure], spec: CountSpec = CountSpec()) -> DataFrame:
    """Add ``n_tokens`` to every row of ``docs`` (text): tokens of the whole text; 0 for null and for the empty text.

    ``measure`` makes the counting function in a process. A column ``n_tokens`` of ``docs`` is replaced.
    """
    short_batches(docs.sparkSession)
    top = frequent(docs, spec)
    key = content_key(top, measure, spec)
    # At most spec.table short words.
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(top, measured(measure(), top), strict=True)))

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lookup = held("tokens", key, lambda: Lookup(table.value, measure(), spec.cache))
        for texts in batches:
            totals: list[int] = []
            for low in range(0, len(texts), 256):
                totals += lookup.totals([t or "" for t in texts[low : low + 256]])
            yield pd.Series(totals, dtype="int64")

    return without(docs, "n_tokens").withColumn("n_tokens", count("text"))
