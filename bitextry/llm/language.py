"""Language identification by compression with one zstandard dictionary per language.

The different words of a text are compressed with the raw-content dictionary of each learned language; the
language whose dictionary leaves the fewest bytes wins. A dictionary lists the words of a bounded sample of
labelled rows, the most frequent ones last, where they are cheapest to refer to.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextry.llm.common import fresh_name, given_back, held, short_batches
from bitextry.session import small
from bitextry.worker import content_key

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageSpec:
    """Bounds of the fitted sample, and how texts are compared.

    Every language with training rows is learned, each from ``samples`` different texts of at most
    ``sample_chars`` characters; ``dictionary_bytes`` of words are kept. The words of a text are
    compressed in pieces of ``piece_bytes``, all of them, so that its length does not drown the dictionaries'
    share. ``margin`` is the relative gain over the second language below which a prediction is rejected.
    """

    samples: int = 256
    sample_chars: int = 2048
    dictionary_bytes: int = 16 * 1024
    piece_bytes: int = 8192
    margin: float = 0.002


# ASCII marks and digits say nothing about a language.
SPACED = bytes(32 if chr(i) in string.punctuation + string.digits else i for i in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words of the whole text without ASCII marks and digits."""
    return text.lower().encode("utf-8", "replace").translate(SPACED).split()


def parameters():
    """Short matches and a small window, as syllables matter more than phrases."""
    import zstandard

    return zstandard.ZstdCompressionParameters(
        window_log=16,
        hash_log=13,
        chain_log=14,
        search_log=3,
        min_match=4,
        target_length=8,
        strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=False,
        write_dict_id=False,
    )


def fit(docs: DataFrame, trained: Column, spec: LanguageSpec = LanguageSpec()) -> dict[str, bytes]:
    """Dictionaries by language, from the rows of ``docs`` (text, lang) for which ``trained`` is true.

    Rows without text or language teach nothing. The sample takes different texts in hash order, so copies
    count once and the choice depends on neither partitioning nor row order. Languages come in the
    order of their rows, then by name; without training rows the result is empty.
    """
    rows = docs.filter(trained & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        "lang", "text", F.xxhash64("text").alias("h")
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    languages = [r.lang for r in sizes.collect()]
    if not languages:
        return {}
    rank = Window.partitionBy("lang").orderBy("h")
    chosen = (
        rows.select("lang", "h")
        .distinct()
        .withColumn("r", F.row_number().over(rank))
        .filter(F.col("r") <= spec.samples)
        .drop("r")
    )
    # At most so many rows of two short columns, then as many short texts.
    picked = (
        rows.join(small(chosen, len(languages) * spec.samples), ["lang", "h"])
        .groupBy("lang", "h")
        .agg(F.min(F.substring("text", 1, spec.sample_chars)).alias("text"))
    )

    def learn(texts: pd.DataFrame) -> pd.DataFrame:
        counts: Counter[bytes] = Counter()
        for text in texts["text"]:
            counts.update(words(text))
        content = dictionary(counts, spec.dictionary_bytes)
        return pd.DataFrame({"lang": [texts["lang"].iloc[0]], "content": [content]})

    learned = picked.groupBy("lang").applyInPandas(learn, "lang string, content binary").collect()
    contents = {row.lang: bytes(row.content) for row in learned}
    return {name: contents[name] for name in languages}


def dictionary(counts: Counter[bytes], size: int) -> bytes:
    """The most frequent words that fit in ``size`` bytes, the most frequent last; ties by word."""
    kept, used = [], 0
    for word in sorted(counts, key=lambda w: (-counts[w], w)):
        used += len(word) + 1
        if used > size:
            break
        kept.append(word)
    return b" ".join(reversed(kept)) + b" "


class Classifier:
    """The dictionaries, digested once per worker."""

    def __init__(self, dictionaries: dict[str, bytes], spec: LanguageSpec) -> None:
        import zstandard

        self.names = list(dictionaries)
        self.spec = spec
        self.compressors = []
        for content in dictionaries.values():
            digested = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            digested.precompute_compress(compression_params=parameters())
            self.compressors.append(zstandard.ZstdCompressor(compression_params=parameters(), dict_data=digested))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the words of the whole text, each word once, by language."""
        content, step = b" ".join([b"", *dict.fromkeys(words(text)), b""]), self.spec.piece_bytes
        pieces = [content[i : i + step] for i in range(0, len(content), step)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin over the second one from 0 to 1, and whether the prediction is rejected."""
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(text)
        # Equal sizes go to the language with more training rows.
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.names[0], 1.0, False
        best, second = sizes[order[0]], sizes[order[1]]
        score = 1.0 - best / second
        return self.names[order[0]], score, score < self.spec.margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], spec: LanguageSpec = LanguageSpec()) -> DataFrame:
    """Add ``lang_pred``, ``score`` (the margin, 0 to 1) and ``rejected`` to every row of ``docs`` (text).

    A null text and a text without a letter get ``und``, score 0, and are rejected, as does every text when nothing
    was learned. With one learned language it is always that one, with score 1. Ties go to the language
    with more training rows, are narrow, and so rejected. Columns of the same names are replaced.
    """
    key = content_key(dictionaries, spec)
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def classes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = held("language", key, lambda: Classifier(shared.value, spec))
        for texts in batches:
            found = [classifier.predict(t) for t in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "rejected"])

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from given_back(classes(batches))

    outcome = fresh_name(docs, "_language")
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    named = docs.withColumn(outcome, classify("text"))
    return named.select(*(F.col(f"`{c}`") for c in kept), f"{outcome}.*")
