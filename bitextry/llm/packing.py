"""Packing token pieces into sequences of fixed length as a cutting-stock problem.

Documents longer than a sequence are cut into whole sequences and a rest. Rests are counted by length class; a linear
program over patterns of classes, solved by column generation with a knapsack as the pricing problem, says how
often each pattern is cut. Rounded patterns become runs of sequences, and each piece finds its place from
its rank among the pieces of its class. The program depends on the histogram only, which never grows.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitextry.llm.common import frozen, given_back, held, short_batches, without
from bitextry.llm.pairmerge import PairMerges
from bitextry.worker import content_key


@dataclass(frozen=True)
class PackingSpec:
    """Tokens in a sequence, tokens in a length class, and the relative gap at which the program may stop.

    ``chunk`` characters are split at once, and of what they hold up to ``words`` different words are encoded at once.
    """

    length: int = 2048
    unit: int = 8
    gap: float = 3e-4
    rounds: int = 6000
    end_id: int = 1
    words: int = 250_000
    chunk: int = 1 << 21


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most value: how often each size is used, with repeats, within ``capacity``."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sorted_sizes, sorted_values = sizes[order], values[order]
    fitting = np.searchsorted(sorted_sizes, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        fits = fitting[room]
        best[room] = best[room - 1]
        if fits:
            reached = best[room - sorted_sizes[:fits]] + sorted_values[:fits]
            top = int(reached.argmax())
            if reached[top] > best[room] + 1e-12:
                best[room], choice[room] = reached[top], order[top]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), pattern


def cut_patterns(
    sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float, rounds: int
) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often each is used, which together hold exactly ``counts`` pieces of each size.

    Column generation: the simplex method over the patterns found so far, each round with the pattern that prices
    best. Solutions are rounded down; the few pieces that remain are put first-fit, longest first.
    """
    m = len(sizes)
    if not m:
        return []
    demand = counts.astype(float)
    often = np.maximum(1, capacity // sizes).astype(float)
    basis, inverse = np.diag(often), np.diag(1 / often)
    used = demand / often
    for step in range(rounds):
        prices = inverse.sum(axis=0)
        value, pattern = knapsack(prices, sizes, capacity)
        total = used.sum()
        # No solution is below total / value.
        if value <= 1 + 1e-9 or total - total / value <= max(0.5, gap * total):
            break
        held = np.flatnonzero(pattern)
        direction = (inverse[:, held] * pattern[held]).sum(axis=1)
        able = direction > 1e-9
        ratios = np.where(able, np.maximum(used, 0) / np.where(able, direction, 1), np.inf)
        leaving = int(ratios.argmin())
        basis[:, leaving] = pattern
        pivot = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, pivot)
        inverse[leaving] = pivot
        if step % 128 == 127:
            # A Newton step takes away what rounding has added; einsum stays in this thread.
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", basis, inverse))
        used = (inverse * demand).sum(axis=1)
    left = counts.astype(np.int64).copy()
    plan: list[tuple[int, np.ndarray]] = []
    for k in np.argsort(-used, kind="stable"):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        fits = min((int(left[i] // pattern[i]) for i in np.flatnonzero(pattern)), default=0)
        times = min(int(np.floor(used[k] + 1e-6)), fits)
        if times > 0:
            plan.append((times, pattern))
            left -= times * pattern
    return plan + first_fit(sizes, left, capacity)


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Sequences for what rounding leaves, at most a few for each pattern: the longest piece first."""
    plan: list[tuple[int, np.ndarray]] = []
    left = left.copy()
    order = np.argsort(-sizes, kind="stable")
    while left.any():
        room, pattern = capacity, np.zeros(len(sizes), np.int64)
        for i in order:
            n = min(int(left[i]), room // int(sizes[i]))
            pattern[i] += n
            room -= n * int(sizes[i])
        often = min(int(left[i] // pattern[i]) for i in np.flatnonzero(pattern))
        plan.append((often, pattern))
        left -= often * pattern
    return plan


class Encoder(Protocol):
    """Ids of pre-tokens (UTF-8) in lower case, as how many each has and all of them; and of any text, as bytes.

    Ids are little-endian unsigned 32-bit numbers.
    """

    def words(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]: ...

    def text(self, text: str) -> bytes: ...


# Classes of characters. Only those are plain whose lower case, composition and class are the same for every library:
# no blanks beyond ASCII, no marks that combine, no letter whose lower case is two characters.
ODD, BLANK, LETTER, DIGIT, OTHER = range(5)
SPANS = ((0x20, 0x7E), (0xA1, 0x12F), (0x131, 0x17F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC))
HIGHEST = SPANS[-1][1] + 1


def character_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case and bytes in UTF-8 of each character up to the last plain one; what lies beyond is odd."""
    kinds, lower = np.zeros(HIGHEST + 1, np.uint8), np.arange(HIGHEST + 1, dtype=np.uint32)
    for c in (9, 10, 13, *(c for low, high in SPANS for c in range(low, high + 1))):
        group = unicodedata.category(chr(c))[0]
        kinds[c] = BLANK if chr(c).isspace() else LETTER if group == "L" else DIGIT if group == "N" else OTHER
        lower[c] = ord(chr(c).lower())
    width = (1 + (lower > 0x7F) + (lower > 0x7FF)).astype(np.uint8)
    return kinds, lower, width


KINDS, LOWER, WIDTH = character_tables()


# Characters that are split at once; a longer text is taken in parts, which end before blanks.
LONG = 1 << 22
# Characters of short texts that are split together: what is made of them stays in a core's own cache.
NEAR = 1 << 17


def parted(text: str, size: int) -> Iterator[str]:
    """The text in parts of at most ``size`` characters that begin with a blank, where it has one."""
    low = 0
    while len(text) - low > size:
        high = text.rfind(" ", low + 1, low + size)
        if high < 0:
            high = text.find(" ", low + size)
        if high < 0:
            break
        yield text[low:high]
        low = high
    yield text[low:]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def is_plain(text: str) -> bool:
    """Whether all characters are plain, and no special token can stand in the text."""
    return "<|" not in text and (text.isprintable() and text.isascii() or bool(KINDS[np.minimum(code_points(text), HIGHEST)].all()))


def pre_tokens(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of plain texts in lower case, and where each text's begin: runs of letters, single digits, runs of all
    else but blanks, and the endings 's 't 're 've 'm 'll 'd where an apostrophe begins a run.
    """
    points = code_points("\n".join([*texts, ""]))
    kinds, points = KINDS[points], LOWER[points]
    starts = kinds == DIGIT
    starts[:1] = True
    starts[1:] |= kinds[1:] != kinds[:-1]
    for mark in np.flatnonzero((points[:-1] == ord("'")) & starts[:-1] & (kinds[1:] == LETTER)).tolist():
        first, second = chr(points[mark + 1]), chr(points[mark + 2])
        size = 2 if first in "stmd" else 3 if first + second in ("re", "ve", "ll") else 0
        if size:
            starts[mark + 1] = False
            starts[mark + size] = True
    inked = kinds != BLANK
    starts &= inked
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.searchsorted(np.flatnonzero(starts), np.concatenate([[0], np.cumsum(lengths)]))
    points, first = points[inked], np.flatnonzero(starts[inked])
    sizes = np.add.reduceat(WIDTH[points], first, dtype=np.int64) if len(first) else first
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = points.tobytes().decode("utf-32-le").encode()
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return words, bounds


class WordCodes:
    """Encodes texts by their different pre-tokens, up to ``limit`` at once.

    Nothing is kept from one call to the next: most different words of a large corpus are rare ones, and to look each of
    them up as an object of Python takes longer than to merge it again.
    """

    def __init__(self, encoder: Encoder, limit: int) -> None:
        self.encoder, self.limit = encoder, limit

    def known(self, words: pa.LargeBinaryArray) -> pa.LargeListArray:
        """The ids of these different pre-tokens."""
        found = [self.encoder.words(words[low : low + self.limit]) for low in range(0, len(words), self.limit)]
        ends = np.cumsum(np.concatenate([[0], *(counts for counts, _ in found)]), dtype=np.int64)
        return pa.LargeListArray.from_arrays(ends, np.concatenate([np.array([], np.uint32), *(ids for _, ids in found)]))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts. Plain ones are split and looked up together, without a step of Python for each word."""
        out = [b""] * len(texts)
        chosen = []
        for i, text in enumerate(texts):
            if not is_plain(text):
                out[i] = self.encoder.text(text)
            elif len(text) > LONG and " " in text[1:]:
                out[i] = b"".join(self.ids([part])[0] for part in parted(text, LONG))
            else:
                chosen.append(i)
        split = [pre_tokens(part) for part in in_chunks([texts[i] for i in chosen], NEAR)]
        words = pa.concat_arrays([words for words, _ in split]) if split else pa.array([], pa.large_binary())
        firsts = np.cumsum([0, *(len(words) for words, _ in split)])
        bounds = np.concatenate([[0], *(first + bounds[1:] for first, (_, bounds) in zip(firsts, split))]).astype(np.int64)
        different = words.dictionary_encode()
        found = self.known(different.dictionary).take(different.indices)
        places = (4 * found.offsets.to_numpy()[bounds]).tolist()
        flat = memoryview(found.values.to_numpy()).cast("B")
        for i, low, high in zip(chosen, places[:-1], places[1:], strict=True):
            out[i] = bytes(flat[low:high])
        return out


class WordEncoder:
    """A ``tokenizers`` file that lower-cases, drops white space, and splits letters, digits and all else apart."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = PairMerges(self.tokenizer.to_str())

    def words(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens in lower case: the file's merges alone."""
        counts, ids = self.merges.encode(words)
        long = np.flatnonzero(counts < 0)
        if len(long):
            texts = [np.frombuffer(self.text(words[i].as_py().decode()), np.uint32) for i in long.tolist()]
            counts[long] = 0
            ids = np.insert(ids, np.repeat(np.cumsum(counts)[long], list(map(len, texts))), np.concatenate(texts))
            counts[long] = list(map(len, texts))
        return counts, ids

    def text(self, text: str) -> bytes:
        """The ids of any text by the whole file."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def cut(codes: bytes, length: int) -> list[tuple[int, int, int]]:
    """Start, length and CRC-32 of the pieces of a document: whole sequences, then the rest."""
    step = 4 * length
    return [
        (low // 4, len(part) // 4, zlib.crc32(part))
        for low in range(0, len(codes), step)
        for part in (codes[low : low + step],)
    ]


def in_chunks(texts: Iterable[str | None], size: int) -> Iterator[list[str]]:
    """The texts in order, null as empty, in lists that end when they have ``size`` characters."""
    part, length = [], 0
    for text in texts:
        part.append(text or "")
        length += len(part[-1])
        if length >= size:
            yield part
            part, length = [], 0
    if part:
        yield part


def pieces(docs: DataFrame, encoder: Callable[[], Encoder], spec: PackingSpec, ids: bool = False) -> DataFrame:
    """Frozen pieces: doc_id, start, length, ids_crc32, doc_tokens, ``_class``, ``_row``, ``_part``, and ``ids`` if asked for."""
    key = content_key(encoder, spec)
    short_batches(docs.sparkSession)
    end = int(spec.end_id).to_bytes(4, "little")
    fields = "start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint" + (",ids:binary" if ids else "")

    def rows(code: bytes) -> list[dict]:
        whole = code + end
        return [
            {
                "start": a,
                "length": n,
                "ids_crc32": crc,
                "doc_tokens": len(whole) // 4,
                **({"ids": whole[4 * a : 4 * (a + n)]} if ids else {}),
            }
            for a, n, crc in cut(whole, spec.length)
        ]

    def split_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = held("packing", key, lambda: WordCodes(encoder(), spec.words))
        for texts in batches:
            yield pd.Series([rows(code) for part in in_chunks(texts, spec.chunk) for code in codes.ids(part)])

    @F.pandas_udf(f"array<struct<{fields}>>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from given_back(split_all(batches))

    # Tells rows with the same doc_id apart; frozen with the pieces.
    number = [F.monotonically_increasing_id().alias("take_id")] if ids else []
    cut_up = docs.select("doc_id", *number, split("text").alias("p"))
    cut_up = cut_up.select(*cut_up.columns[:-1], F.explode("p").alias("p")).select(*cut_up.columns[:-1], "p.*")
    return frozen(cut_up.withColumn("_class", F.ceil(F.col("length") / spec.unit).cast("int")), part="_part")


def places(plan: list[tuple[int, np.ndarray]], sizes: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Class, first and last rank, copies in a sequence, first sequence, first slot: where runs of ranks go."""
    rows, taken, sequence = [], np.zeros(len(sizes), np.int64), 0
    for often, pattern in plan:
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            copies = int(pattern[i])
            first = int(taken[i])
            taken[i] += often * copies
            rows.append((int(sizes[i]), first, int(taken[i]) - 1, copies, sequence, slot))
            slot += copies
        sequence += often
    return rows


def pack(
    docs: DataFrame, encoder: Callable[[], Encoder], spec: PackingSpec = PackingSpec(), ids: bool = False
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with ``sequence_id`` from 0, ``slot``, and ``offset`` in the sequence, gapless from 0.

    A document's ids are those of its text and the end id, so a null or empty text is a piece of one id. Every id is
    in one piece; ``ids_crc32`` is over little-endian unsigned 32-bit ids. Repeated rows are documents
    of their own. An empty table gives no rows. With ``ids``, pieces carry their ids, and ``take_id``, a number of the
    row of ``docs`` that they are cut from.
    """
    rows = pieces(without(docs.select("doc_id", "text"), "_row", "_part"), encoder, spec, ids)
    spark = docs.sparkSession
    in_part = rows.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("n"))
    histogram = in_part.groupBy("_class").agg(F.sum("n").alias("n")).orderBy("_class").collect()
    sizes = np.array([r["_class"] for r in histogram], np.int64)
    counts = np.array([r["n"] for r in histogram], np.int64)
    plan = cut_patterns(sizes, counts, spec.length // spec.unit, spec.gap, spec.rounds)
    runs = spark.createDataFrame(
        places(plan, sizes), "_class int, first bigint, last bigint, copies int, sequence bigint, slot0 int"
    )
    earlier = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = in_part.select("_class", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_shift"))
    here = Window.partitionBy("_class", "_part").orderBy("_row")
    # Places are found without the ids, which then move once.
    light = rows.drop("ids")
    ranked = light.join(shifts, ["_class", "_part"]).withColumn(
        "_rank", F.col("_shift") + F.row_number().over(here) - 1
    )
    # The runs are as many as patterns have classes, whatever the number of pieces.
    placed = ranked.join(F.broadcast(runs), "_class").filter(F.col("_rank").between(F.col("first"), F.col("last")))
    at = F.col("_rank") - F.col("first")
    sequenced = placed.withColumn("sequence_id", F.col("sequence") + F.floor(at / F.col("copies"))).withColumn(
        "slot", (F.col("slot0") + at % F.col("copies")).cast("int")
    )
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = sequenced.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "slot"]
    if not ids:
        return placed.select(*columns)
    moved = placed.select("_row", "sequence_id", "offset", "slot").hint("shuffle_hash")
    return rows.join(moved, "_row").select(*columns, "ids", "take_id")
