"""Benchmark decontamination: which documents hold word windows of test items, and texts without them.

The windows of all items form a hash set that is broadcast. A scan of the documents turns words into numbers, hashes every
window of the text at once, and looks the hashes up in a bitmap; what passes is compared word for word. A set beyond
the limit is cut by hash into slices of bounded size, which are scanned for one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextry.llm.bytewords import WORD, utf8, word_lists
from bitextry.llm.common import fresh_name, frozen, held, short_batches
from bitextry.worker import content_key

FOUND = "n_words long, ranges array<struct<first:bigint,end:bigint>>, items array<string>"


@dataclass(frozen=True)
class WindowSpec:
    """Words of a window, and how many pairs of window and item a broadcast set may hold."""

    words: int = 10
    set_pairs: int = 200_000


def item_windows(items: DataFrame, spec: WindowSpec) -> DataFrame:
    """The different ``item, size, window`` of ``items`` (item_id, text): every run of so many words.

    An item of fewer words is one window; an item without words has none.
    """
    short_batches(items.sparkSession)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = [w for part in word_lists(text) for w in part]
                size = min(spec.words, len(words))
                if size:
                    found = {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}
                    yield pd.DataFrame({"item": item, "size": size, "window": sorted(found)})

    named = items.select(F.col("item_id").cast("string").alias("item"), utf8().alias("text"))
    return named.mapInPandas(windows, "item string, size int, window binary").distinct()


class WindowSet:
    """Windows as numbers of their words: a bitmap of hashes in front of an exact table with their items."""

    def __init__(self, pairs: pd.DataFrame) -> None:
        self.numbers: dict[bytes, int] = {}
        self.items: dict[int, dict[bytes, list[str]]] = {}
        for size, window, item in zip(pairs["size"], pairs["window"], pairs["item"], strict=True):
            words = bytes(window).split()
            codes = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int32)
            names = self.items.setdefault(int(size), {}).setdefault(codes.tobytes(), [])
            if item is not None:
                names.append(item)
        self.factors = np.random.default_rng(7).integers(1, 1 << 62, max(self.items, default=1), np.int64) * 2 + 1
        self.bits = max(10, (16 * len(pairs)).bit_length())
        self.maps = {}
        for size, known in self.items.items():
            codes = np.frombuffer(b"".join(known), np.int32).reshape(-1, size)
            marks = np.zeros(1 << self.bits, bool)
            marks[self.slots((codes.astype(np.int64) * self.factors[:size]).sum(axis=1))] = True
            self.maps[size] = marks

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return hashes.view(np.uint64) >> np.uint64(64 - self.bits)

    def codes(self, text: bytes | None) -> np.ndarray:
        """The number of each word of a text, 0 for a word that no window has."""
        get = self.numbers.get
        parts = [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)) for words in word_lists(text)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts])

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, list[str]]]]:
        """Which words lie inside a window of the set, and the first word and the items of each window."""
        hit, found = np.zeros(len(codes), bool), []
        for size, marks in self.maps.items():
            n = len(codes) - size + 1
            if n < 1:
                continue
            hashes = np.zeros(n, np.int64)
            for j in range(size):
                hashes += codes[j : j + n].astype(np.int64) * self.factors[j]
            known = self.items[size]
            for i in np.flatnonzero(marks[self.slots(hashes)]).tolist():
                names = known.get(codes[i : i + size].tobytes())
                if names is not None:
                    hit[i : i + size] = True
                    found.append((i, names))
        return hit, found


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def searcher(pairs: DataFrame):
    """A UDF from texts to ``n_words, ranges, items`` for the windows of ``pairs``, which are bounded."""
    table = pairs.toPandas()
    key = content_key(table)
    shared = pairs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = held("decontamination", key, lambda: WindowSet(shared.value))
        for texts in batches:
            coded = [windows.codes(t) for t in texts]
            # Texts are searched end to end; a 0 between them is in no window.
            together = np.concatenate([np.zeros(0, np.int32), *(a for c in coded for a in (c, np.zeros(1, np.int32)))])
            hit, found = windows.search(together)
            starts = np.cumsum([0, *(len(c) + 1 for c in coded)])
            names: list[set[str]] = [set() for _ in coded]
            if found:
                owners = np.searchsorted(starts, [i for i, _ in found], side="right") - 1
                for owner, (_, items) in zip(owners.tolist(), found, strict=True):
                    names[owner].update(items)
            first, end = runs(hit)
            owners = np.searchsorted(starts, first, side="right") - 1
            ranges: list[list[dict[str, int]]] = [[] for _ in coded]
            for owner, a, b in zip(owners.tolist(), first.tolist(), end.tolist(), strict=True):
                low = int(starts[owner])
                ranges[owner].append({"first": a - low, "end": b - low})
            yield pd.DataFrame(
                {"n_words": [len(c) for c in coded], "ranges": ranges, "items": [sorted(s) for s in names]}
            )

    return search


def united(ranges: list) -> list[dict[str, int]]:
    """Ranges that may overlap or touch, as the least number of ranges in order."""
    merged: list[dict[str, int]] = []
    for a, b in sorted((r["first"], r["end"]) for r in ranges):
        if merged and a <= merged[-1]["end"]:
            merged[-1]["end"] = max(b, merged[-1]["end"])
        else:
            merged.append({"first": a, "end": b})
    return merged


def contamination(docs: DataFrame, items: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``ranges`` and ``items`` to every row of ``docs`` (text).

    ``ranges`` are the word numbers from ``first`` to before ``end`` that lie inside an occurrence of a window of
    ``items`` (item_id, text), ``n_hit`` their words, ``items`` the ids of the items with occurring windows, in the order of strings.
    Null and empty texts have no words; an empty ``items`` hits nothing. Items that share an id count as one; the words of
    an item without id are hits, but it is not listed. Columns of ``docs`` with the names of the outputs are replaced.
    """
    short_batches(docs.sparkSession)
    windows = frozen(item_windows(items, spec), row="_w")
    slices = max(1, -(-windows.count() // spec.set_pairs))
    found = fresh_name(docs, "_windows")
    outputs = ("n_words", "n_hit", "ranges", "items")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in outputs]
    if slices == 1:
        rows = docs.withColumn(found, searcher(windows.drop("_w"))(utf8())).select(*others, f"{found}.*")
    else:
        rows = sliced(docs, windows, slices, found, others)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return rows.withColumn("n_hit", n_hit)


def sliced(docs: DataFrame, windows: DataFrame, slices: int, found: str, others: list[Column]) -> DataFrame:
    """The same by one scan for each slice of the windows; only rows with hits are shuffled."""
    row = fresh_name(docs, "_window_row")
    kept = frozen(docs, row=row)
    slot = F.pmod(F.xxhash64("window", "item"), F.lit(slices))
    scans = []
    for k in range(slices):
        scan = kept.select(row, searcher(windows.filter(slot == k).drop("_w"))(utf8()).alias(found))
        scans.append(scan.select(row, f"{found}.*").filter(F.size("ranges") > 0).drop("n_words"))
    hits = reduce(DataFrame.unionByName, scans).groupBy(row).agg(
        F.flatten(F.collect_list("ranges")).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    @F.pandas_udf("array<struct<first:bigint,end:bigint>>")
    def unite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(united)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sum(map(len, word_lists(t))) for t in texts], dtype="int64")

    empty = F.array().cast("array<struct<first:bigint,end:bigint>>")
    joined = kept.select(*others, row, count(utf8()).alias("n_words")).join(hits.withColumn("ranges", unite("ranges")), row, "left").drop(row)
    return joined.withColumn("ranges", F.coalesce("ranges", empty)).withColumn(
        "items", F.coalesce("items", F.array().cast("array<string>"))
    )


def without_spans(found: DataFrame) -> DataFrame:
    """Rows of :func:`contamination` with ``text`` cut: from the first to the last character of each range is removed."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, ranges in batches:
            yield pd.Series([clean(t, r) for t, r in zip(texts, ranges, strict=True)], dtype=object)

    return found.withColumn("text", F.when(F.size("ranges") > 0, cut("text", "ranges")).otherwise(F.col("text")))


def clean(text: str, ranges) -> str:
    """The text without the words of these ranges and what stands between them."""
    if not len(ranges):
        return text
    spans = [m.span() for m in WORD.finditer(text)]
    out, low = [], 0
    for r in ranges:
        out.append(text[low : spans[r["first"]][0]])
        low = spans[r["end"] - 1][1]
    return "".join([*out, text[low:]])


def without_documents(found: DataFrame, least: int = 1) -> DataFrame:
    """Rows of :func:`contamination` with fewer than ``least`` hit words."""
    return found.filter(F.col("n_hit") < least)
