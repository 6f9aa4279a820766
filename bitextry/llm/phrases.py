"""Phrase collocations: exact counts of word runs by HAT-tries and sorted runs, scored by their weakest cut.

A task counts phrases in a HAT-trie per language over numbers that it gives to words itself. When the tries are full, the largest
subtrees leave whole, as sorted runs: the words' 64-bit hashes take the place of the task's numbers, and
each phrase goes to the partition of its prefix, its first two words. There the runs of all tasks are merged and
phrases below the least count dropped, as no part of a candidate is rarer than the candidate. Scores, the
containment rule and the best phrases of a language are DataFrame operations on what remains.

Hashes of words are checked against the words in the merge: two words of a language with one hash start
the count again with another seed, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitextry.llm.common import short_batches
from bitextry.llm.hattrie import MOST_WORDS, HatTrie, packed, unpacked
from bitextry.session import checkpointed

NO_LANGUAGE = "und"
RUN = "lang string, part int, words binary, phrases binary, n int"
GRAMS = "lang string, ids array<bigint>, f bigint, word string, clash boolean"
SCALE = 1_000_000


@dataclass(frozen=True)
class PhraseSpec:
    """Which phrases are candidates, how many a language reports, and what a task holds.

    ``entries`` phrases at most stay in the tries of a task, over ``vocabulary`` different words; ``covered`` is the percentage of a
    phrase's count at which a longer phrase takes its place.
    """

    longest: int = MOST_WORDS
    least: int = 10
    covered: int = 50
    top: int = 2000
    entries: int = 1_200_000
    vocabulary: int = 300_000
    chunk: int = 1 << 20


def mapped(i: int) -> int:
    """A to Z become a to z, the marks and line ends that end a piece a line feed, a tab a blank."""
    if ord("A") <= i <= ord("Z"):
        return i + 32
    return 10 if i in b".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i


PIECES = bytes(map(mapped, range(256)))


class Vocabulary(dict):
    """Numbers of words from 2 in the order in which they come; an empty word has 0, the end of a piece 1."""

    def __init__(self) -> None:
        super().__init__({b"": 0, b"\n": 1})
        self.words: list[bytes] = [b"", b"\n"]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words)).view(np.int64)
    # 0 stands for no word.
    return np.where(hashes == 0, 1, hashes)


def part_of(first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    """The partition of the prefix: the first two words."""
    mixed = first.view(np.uint64) ^ (second.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(parts)


class Counting:
    """The tries of a task and their vocabularies, one of each per language."""

    def __init__(self, spec: PhraseSpec, parts: int, seed: int) -> None:
        self.spec, self.parts, self.seed = spec, parts, seed
        self.tries: dict[str, tuple[Vocabulary, HatTrie]] = {}

    def add(self, lang: str, texts: list[bytes]) -> None:
        """Count the phrases of these whole texts of a language."""
        if lang not in self.tries:
            self.tries[lang] = Vocabulary(), HatTrie()
        vocabulary, trie = self.tries[lang]
        data = b"\n".join(texts).translate(PIECES).replace(b"\n", b" \n ")
        numbers = []
        low = 0
        while low < len(data):
            high = data.find(b" ", low + self.spec.chunk)
            high = len(data) if high < 0 else high
            numbers.append(np.array(list(map(vocabulary.__getitem__, data[low:high].split(b" "))), np.int64))
            low = high
        ids = np.concatenate([np.zeros(0, np.int64), *numbers])
        ids = ids[ids != 0]
        inside = ids > 1
        columns, open_ = [], np.ones(len(ids), bool)
        for k in range(self.spec.longest):
            n = len(ids) - k
            if n <= 0:
                break
            open_ = open_[:n] & inside[k:]
            columns = [c[:n] for c in columns] + [ids[k:]]
            trie.add(packed([c[open_] for c in columns]))

    def spilled(self, everything: bool) -> Iterator[pd.DataFrame]:
        """Runs of whole subtrees when the tries or a vocabulary are full, or of all of them."""
        sizes = {lang: trie.sizes() for lang, (_, trie) in self.tries.items()}
        total = sum(int(s.sum()) for s in sizes.values())
        words = sum(len(v) for v, _ in self.tries.values())
        if everything or words > self.spec.vocabulary:
            for lang in list(self.tries):
                vocabulary, trie = self.tries.pop(lang)
                yield self.runs(lang, vocabulary, *trie.take(list(range(len(trie.root)))))
        elif total > self.spec.entries:
            largest = sorted(((int(n), lang, b) for lang, s in sizes.items() for b, n in enumerate(s)), reverse=True)
            going: dict[str, list[int]] = {}
            for n, lang, b in largest:
                if total <= self.spec.entries // 2:
                    break
                going.setdefault(lang, []).append(b)
                total -= n
            for lang, subtrees in going.items():
                vocabulary, trie = self.tries[lang]
                yield self.runs(lang, vocabulary, *trie.take(subtrees))

    def runs(self, lang: str, vocabulary: Vocabulary, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        """A row for each partition with its phrases in the order of their words' hashes."""
        numbers = unpacked(keys)
        hashes = word_hashes(vocabulary.words, self.seed)
        hashes[0] = 0
        columns = [hashes[n] for n in numbers]
        part = part_of(columns[0], columns[1], self.parts)
        order = np.lexsort((*reversed(columns), part))
        part, counts, first = part[order], counts[order], numbers[0][order]
        columns = [c[order] for c in columns]
        bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        press = zstandard.ZstdCompressor(level=1).compress
        rows = []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            single = columns[1][low:high] == 0
            words = b" ".join(vocabulary.words[i] for i in first[low:high][single].tolist())
            phrases = np.concatenate([*(c[low:high] for c in columns), counts[low:high]]).tobytes()
            rows.append((lang, int(part[low]), press(words), press(phrases), high - low))
        return pd.DataFrame(rows, columns=["lang", "part", "words", "phrases", "n"])


def merged(lang: str, runs: list[tuple[bytes, bytes]], spec: PhraseSpec) -> pd.DataFrame:
    """The phrases of a partition that occur often enough, and a row without ids: all words, and whether hashes clash."""
    open_ = zstandard.ZstdDecompressor().decompress
    tables = [np.frombuffer(open_(phrases), np.int64).reshape(MOST_WORDS + 1, -1) for _, phrases in runs]
    table = np.concatenate(tables, axis=1)
    single = table[1] == 0
    words = [w for text, _ in runs for w in open_(text).split(b" ") if w]
    total = int(table[-1][single].sum())
    names: dict[int, bytes] = {}
    clash = any(names.setdefault(h, w) != w for h, w in zip(table[0][single].tolist(), words, strict=True))
    columns = ["lang", "ids", "f", "word", "clash"]
    whole = pd.DataFrame([(lang, [], total, None, clash)], columns=columns)
    if clash:
        return whole
    # Sorted runs in a row are what a merge sort takes in one sweep each.
    order = np.lexsort(tuple(table[k] for k in reversed(range(MOST_WORDS))))
    table = table[:, order]
    changed = np.ones(table.shape[1], bool)
    changed[1:] = (table[:-1, 1:] != table[:-1, :-1]).any(axis=0)
    starts = np.flatnonzero(changed)
    counts = np.add.reduceat(table[-1], starts)
    often = counts >= spec.least
    ids, counts = table[:-1, starts[often]], counts[often]
    size = (ids != 0).sum(axis=0)
    rows = [[*column[:n]] for column, n in zip(ids.T.tolist(), size.tolist(), strict=True)]
    texts = [names[r[0]].decode("utf-8", "replace") if len(r) == 1 else None for r in rows]
    frame = pd.DataFrame({"lang": lang, "ids": rows, "f": counts, "word": texts, "clash": False}, columns=columns)
    return pd.concat([frame, whole])


def phrase_counts(docs: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """Written ``lang, ids, f, word``: phrases of ``docs`` (text, lang) that occur at least ``least`` times in their language.

    ``ids`` are numbers of the words, ``word`` the word of a phrase of one. A row without ids has in ``f`` the words of the
    language. Null texts are empty, a null language is ``und``; an empty table has no rows.
    """
    if not 1 <= spec.longest <= MOST_WORDS:
        raise ValueError(f"phrases have 1 to {MOST_WORDS} words")
    spark = docs.sparkSession
    short_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), text)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    for seed in range(8):
        counts = checkpointed(counted(rows, spec, parts, seed))
        if not counts.filter("clash").limit(1).count():
            words = counts.filter(F.size("ids") == 0).groupBy("lang").agg(F.sum("f").alias("f"))
            words = words.select("lang", F.array().cast("array<bigint>").alias("ids"), "f", F.lit(None).cast("string").alias("word"))
            return counts.filter(F.size("ids") > 0).drop("clash").unionByName(words)
    raise RuntimeError("two words have had the same hash under each of 8 seeds")


def counted(rows: DataFrame, spec: PhraseSpec, parts: int, seed: int) -> DataFrame:
    """Merged phrases with at least ``least`` occurrences, by one scan and one exchange of sorted runs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counting = Counting(spec, parts, seed)
        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=False)["text"]:
                waiting, size = [], 0
                for text in [*texts, None]:
                    if text is not None:
                        waiting.append(text)
                        size += len(text)
                    if waiting and (text is None or size > spec.chunk):
                        counting.add(lang, waiting)
                        waiting, size = [], 0
                        yield from counting.spilled(False)
        yield from counting.spilled(True)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[str, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for lang, words, phrases in zip(batch["lang"], batch["words"], batch["phrases"], strict=True):
                runs.setdefault(lang, []).append((words, phrases))
        while runs:
            yield merged(*runs.popitem(), spec)

    runs = rows.mapInPandas(count, RUN)
    return runs.repartitionById(parts, F.col("part")).mapInPandas(merge, GRAMS)


def cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, ids, a, l, r, score`` of each candidate by its cut with the lowest score, the first of equal ones."""
    at = F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    cut = candidates.select("lang", "ids", "a", at)
    k = F.col("k")
    cut = cut.withColumn("left", F.slice("ids", F.lit(1), k)).withColumn(
        "right", F.slice("ids", k + 1, F.size("ids") - k)
    )
    lefts = counts.select("lang", F.col("ids").alias("left"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("ids").alias("right"), F.col("f").alias("r"))
    both = cut.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    # Products of 38 digits; the quotient is at most SCALE, as no part is rarer than the whole.
    a, l, r = (f"cast({c} as decimal(15,0))" for c in "alr")
    both = both.withColumn("score", F.expr(f"(cast({SCALE} as decimal(7,0)) * ({a} * {a})) div ({l} * {r})"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = both.groupBy("lang", "ids").agg(F.max("a").alias("a"), lowest)
    return best.select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")


def uncovered(scored: DataFrame, covered: int) -> DataFrame:
    """Without the candidates that stand inside a longer one with at least ``covered`` percent of their count."""
    size = F.size("ids")
    # The parts of two words and more of a longer phrase, itself left out.
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda s: F.transform(F.sequence(F.lit(1), size - s + 1), lambda i: F.slice("ids", i, s)),
        )
    )
    inner = scored.filter(size > 2).select("lang", F.explode(parts).alias("ids"), F.col("a").alias("longer"))
    most = inner.groupBy("lang", "ids").agg(F.max("longer").alias("longer"))
    free = F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))
    return scored.join(most, ["lang", "ids"], "left").filter(free).drop("longer")


def near_top(scored: DataFrame, top: int) -> DataFrame:
    """The rows in the score classes that can hold a language's first ``top``, found from the classes' sizes."""
    classed = scored.withColumn("_class", F.col("score").bitwiseAND(F.lit(-1024)))
    sizes = classed.groupBy("lang", "_class").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("lang").orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = sizes.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))).filter(F.col("before") < top)
    return classed.join(wanted.select("lang", "_class"), ["lang", "_class"], "left_semi").drop("_class")


def spelled(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``phrase``: the words of ``ids`` joined by blanks."""
    words = counts.filter(F.size("ids") == 1).select("lang", F.get("ids", F.lit(0)).alias("id"), "word")
    spread = rows.select("*", F.posexplode("ids").alias("at", "id")).join(words, ["lang", "id"])
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    return spread.groupBy(*rows.columns).agg(F.array_join(in_order, " ").alias("phrase"))


def collocations(docs: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """The best phrases of each language of ``docs`` (text, lang): ``lang, rank, phrase, a, l, r, n, score``.

    Texts are cut into pieces at marks and line ends, pieces into words at blanks and tabs, A to Z in lower case. A
    candidate has 2 to ``longest`` words and occurs ``a >= least`` times. Cut in two, its parts occur ``l`` and ``r`` times; the
    score is ``a * a / (l * r)`` in millionths, rounded down, of the lowest cut (the first of equal ones). A
    candidate inside a longer one with ``covered`` percent of its count is left out. ``n`` are the words of the language.
    Equal scores go by higher ``a``, then by phrase. Columns other than text and lang play no part; repeated rows count
    as often as they stand there.
    """
    counts = phrase_counts(docs, spec)
    grams = counts.filter(F.size("ids") > 0)
    candidates = grams.filter(F.size("ids") > 1).select("lang", "ids", F.col("f").alias("a"))
    kept = checkpointed(uncovered(cuts(candidates, grams), spec.covered))
    best = spelled(near_top(kept, spec.top), counts)
    words = counts.filter(F.size("ids") == 0).select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= spec.top)
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
