"""Cross-entropy difference: how much better a target model predicts a document than a background model.

Two bigram models share one vocabulary and one smoothing. Words and pairs are those of all documents, whatever their
number, and no table of them has to fit anywhere. The most frequent words have short codes, their counts are
broadcast, and the pairs of the few hundred most frequent ones are counted in a dense table: this is a shortcut of
fixed size for what would be hot keys, and changes no result. All other pairs travel to groups by the hash of their
second word, or of the pair where that word is frequent; so a group counts its words and pairs completely, and
returns the losses of its pairs, summed by document.

Other words are known by 64-bit hashes: two of 20 million words share one with probability 0.00001.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextry.llm.common import by_group, fresh_name, frozen, held, short_batches, whole_groups, without
from bitextry.llm.shingles import WORD_CACHE
from bitextry.session import checkpointed

UNKNOWN, START = 0, 1
CODES = 65_536
FAR_BEFORE, FAR_WORD, LAST, COUNTED, TARGET, SCORED = 1, 2, 4, 8, 16, 32
MEASURES = ("n_words", "target_loss", "background_loss", "score")


@dataclass(frozen=True)
class ModelSpec:
    """Entries of the shared vocabulary, unknown and start included; and how much the unigrams weigh in a bigram.

    Without a number, the vocabulary has all words. ``frequent`` words have codes, the pairs of ``dense`` ones are in
    a table; a task counts ``group`` other pairs at a time, and takes ``rows`` documents of ``chars`` in all. Results
    do not depend on these.
    """

    vocabulary: int | None = None
    prior: float = 16.0
    flush: int = 400_000
    frequent: int = CODES
    dense: int = 1_024
    group: int = 1_000_000
    rows: int = 512
    chars: int = 8_000_000


@dataclass(frozen=True)
class Shortcut:
    """Codes of the frequent words, the vocabulary's size, and counts (2, ...) of the background and the target.

    ``words`` and ``before`` count each code as a word and as the one before a word; ``dense`` the pairs of the first
    codes; ``total`` all words. ``scale`` is what a count of each model weighs.
    """

    numbers: dict[str, int]
    size: int
    closed: bool
    total: np.ndarray
    words: np.ndarray
    before: np.ndarray
    dense: np.ndarray
    scale: np.ndarray
    prior: float

    def unigram(self, model: int, counts: np.ndarray) -> np.ndarray:
        """Smoothed by one for each word."""
        weight = self.scale[model]
        return (weight * counts + 1) / (weight * self.total[model] + self.size)

    def pair_loss(self, model: int, pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The part of minus log probability that depends on the pair and its second word."""
        return -np.log(self.scale[model] * pairs + self.prior * self.unigram(model, words))

    def before_loss(self, model: int, counts: np.ndarray) -> np.ndarray:
        """The part that depends on the first word."""
        return np.log(self.scale[model] * counts + self.prior)


@dataclass(frozen=True)
class Model:
    """The frozen rows (text, target) that are counted, and what is known of their frequent words."""

    rows: DataFrame
    shortcut: Shortcut


class Codes(dict):
    """Codes of words: those of frequent ones, ``other`` or a hash beyond all codes for the rest."""

    def __init__(self, numbers: dict[str, int], other: int | None) -> None:
        super().__init__(numbers)
        self.numbers, self.other = numbers, other

    def __missing__(self, word: str) -> int:
        if self.other is not None:
            return self.other
        import xxhash

        if len(self) >= len(self.numbers) + WORD_CACHE:
            self.clear()
            self.update(self.numbers)
        number = self[word] = max(CODES, xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))
        return number


def words(text: str) -> list[str]:
    return text.lower().split()


def word_counts(docs: DataFrame, spec: ModelSpec) -> DataFrame:
    """``word, n_0, n_1, ends_0, ends_1``: how often it stands in, and ends, rows of the background and the target."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, ends = (Counter(), Counter()), (Counter(), Counter())

        def counted() -> Iterator[pd.DataFrame]:
            for k in (0, 1):
                found = list(counts[k])
                if found:
                    yield pd.DataFrame(
                        {"word": found, "k": k, "n": list(counts[k].values()), "ends": [ends[k][w] for w in found]}
                    )
                counts[k].clear()
                ends[k].clear()

        for batch in batches:
            for text, target in zip(batch["text"], batch["target"], strict=True):
                found = words(text)
                counts[int(target)].update(found)
                ends[int(target)].update(found[-1:])
            if len(counts[0]) + len(counts[1]) > spec.flush:
                yield from counted()
        yield from counted()

    rows = docs.select("text", "target").mapInPandas(count, "word string, k int, n bigint, ends bigint")

    def added(column: str, k: int) -> "F.Column":
        return F.sum(F.when(F.col("k") == k, F.col(column)).otherwise(0)).alias(f"{column}_{k}")

    return checkpointed(rows.groupBy("word").agg(*(added(c, k) for c in ("n", "ends") for k in (0, 1))))


def encoded(texts: pd.Series, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and of all texts in one piece the code of each word and of the one before it."""
    parts = [words(text) for text in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ids = np.fromiter(map(codes.__getitem__, chain.from_iterable(parts)), np.uint64, int(lengths.sum()))
    before = np.concatenate([ids[:1], ids[:-1]])
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
    return lengths, ids, before


def pieces(batch: pd.DataFrame, spec: ModelSpec) -> Iterator[pd.DataFrame]:
    """``batch`` cut by rows and characters; a longer text is alone."""
    low = chars = 0
    for high, size in enumerate(batch["text"].str.len()):
        if high > low and (high - low >= spec.rows or chars + size > spec.chars):
            yield batch.iloc[low:high]
            low, chars = high, 0
        chars += size
    yield batch.iloc[low:]


def dense_counts(docs: DataFrame, numbers: dict[str, int], other: int, size: int, spec: ModelSpec) -> np.ndarray:
    """Counts (2, size * size) of the pairs of the first ``size`` codes in the background and the target rows."""
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(numbers)  # spec.frequent words

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = held("likelihood", key, lambda: Codes(shared.value, other))
        sums = np.zeros(2 * size * size, np.int64)
        for batch in batches:
            for part in pieces(batch, spec):
                lengths, ids, before = encoded(part["text"], codes)
                first = np.repeat(part["target"].to_numpy(np.int64) * size * size, lengths)
                near = (ids < size) & (before < size)
                seen, n = np.unique(first[near] + (before[near] * np.uint64(size) + ids[near]).astype(np.int64), return_counts=True)
                sums[seen] += n
        seen = np.flatnonzero(sums)
        for low in range(0, len(seen), 100_000):
            some = seen[low : low + 100_000]
            yield pd.DataFrame({"pair": some, "n": sums[some]})

    rows = docs.select("text", "target").mapInPandas(count, "pair bigint, n bigint")
    added = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * size * size, np.int64)
    out[added["pair"].to_numpy()] = added["n"].to_numpy()
    return out.reshape(2, size * size)


def shortcut(docs: DataFrame, spec: ModelSpec) -> Shortcut:
    closed = spec.vocabulary is not None
    most = spec.vocabulary if closed else spec.frequent
    if not 2 <= most <= CODES:
        raise ValueError(f"frequent words and a limited vocabulary can have 2 to {CODES} entries")
    counted = word_counts(docs, spec)
    columns = ("n_0", "n_1", "ends_0", "ends_1")
    known, *sums = counted.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(c), F.lit(0)) for c in columns)).first()
    top = counted.orderBy(F.desc(F.col("n_0") + F.col("n_1")), "word").limit(most - 2).collect()
    numbers = {row.word: 2 + k for k, row in enumerate(top)}
    table = np.zeros((4, 2 + len(top)), np.int64)
    table[:, 2:] = np.array([[row[c] for c in columns] for row in top], np.int64).reshape(-1, 4).T
    if closed:
        table[:, UNKNOWN] = np.array(sums) - table.sum(axis=1)
    n, ends = table[:2], table[2:]
    before = n - ends
    before[:, START] = sums[2:]  # each row with words ends once, and starts once
    total = np.array(sums[:2])
    size = min(spec.dense, 2 + len(top))
    dense = dense_counts(docs, numbers, UNKNOWN if closed else CODES, size, spec)
    # Background counts weigh as many words as the target's.
    scale = np.array([total[1] / total[0] if total.all() else 1.0, 1.0])
    entries = spec.vocabulary if closed else known + 2
    return Shortcut(numbers, entries, closed, total, n, before, dense, scale, spec.prior)


def fit(docs: DataFrame, spec: ModelSpec = ModelSpec()) -> Model:
    """The background and the target model of ``docs`` (text, target).

    Background counts are scaled to the number of the target's words, so that both models are equally sure of what
    they have seen. Without rows of one kind, its model is the uniform one.
    """
    short_batches(docs.sparkSession)
    rows = checkpointed(docs.filter(F.length("text") > 0).select("text", "target"))
    return Model(rows, shortcut(rows, spec))


def packed(flags: np.ndarray, docs: np.ndarray, before: np.ndarray, ids: np.ndarray) -> bytes:
    """Pairs in few bytes: two for a code, eight for a hash. ``docs`` rises."""
    both = np.concatenate([before, ids])
    far = both >= CODES
    step = np.diff(docs, prepend=0).astype(np.uint16)
    head = np.uint32(len(flags)).tobytes()
    return b"".join([head, flags.tobytes(), step.tobytes(), both[~far].astype(np.uint16).tobytes(), both[far].tobytes()])


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    flags = np.frombuffer(body, np.uint8, n, 4)
    docs = np.cumsum(np.frombuffer(body, np.uint16, n, 4 + n), dtype=np.int64)
    far = np.concatenate([flags & FAR_BEFORE, flags & FAR_WORD]) > 0
    both, near = np.empty(2 * n, np.uint64), 2 * n - int(far.sum())
    both[~far] = np.frombuffer(body, np.uint16, near, 4 + 3 * n)
    both[far] = np.frombuffer(body, np.uint64, 2 * n - near, 4 + 3 * n + 2 * near)
    return flags, docs, both[:n], both[n:]


def mixed(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One number for a pair."""
    out = before * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out = (out + ids) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def dealt(part: pd.DataFrame, chunk: int, codes: Codes, known: Shortcut, tables: list, groups: int) -> pd.DataFrame:
    """Of some documents, the pairs for each group; and a row of what needs no group, for those that are scored."""
    lengths, ids, before = encoded(part["text"], codes)
    docs = np.repeat(np.arange(len(part)), lengths)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    scored, target = part["_row"].notna().to_numpy(), part["target"].to_numpy(object)
    bits = SCORED * scored + np.array([0 if t is None else COUNTED + TARGET * int(t) for t in target], np.int64)
    size = int(round(known.dense.shape[1] ** 0.5))
    near, dense = ids < CODES, (ids < size) & (before < size)
    rows = []
    if scored.any():
        inner, pairs = near & ~last, (before[dense] * np.uint64(size) + ids[dense]).astype(np.int64)
        sums = [
            np.bincount(docs[inner], after[ids[inner].astype(np.int64)], len(part))
            + np.bincount(docs[dense], table[pairs], len(part))
            + after[START] * (lengths > 0)
            for table, after in tables
        ]
        numbers = part["_row"].to_numpy()[scored].astype(np.int64)
        body = [x.tobytes() for x in (numbers, np.flatnonzero(scored), lengths[scored], *(s[scored] for s in sums))]
        rows.append((chunk % groups, chunk, True, b"".join(body)))
    rest = ~dense & (bits[docs] > 0)
    docs, before, ids, last = docs[rest], before[rest], ids[rest], last[rest]
    near = ids < CODES
    flags = (FAR_BEFORE * (before >= CODES) + FAR_WORD * ~near + LAST * last + bits[docs]).astype(np.uint8)
    group = (mixed(np.where(near, before, np.uint64(0)), ids) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group.astype(np.uint16) if groups <= CODES else group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1)) if groups <= len(order) else None
    if bounds is None:
        found, first = np.unique(group[order], return_index=True)
        spans = zip(found, first, [*first[1:], len(order)])
    else:
        spans = zip(range(groups), bounds[:-1], bounds[1:])
    for k, low, high in spans:
        if low < high:
            at = order[low:high]
            rows.append((int(k), chunk, False, packed(flags[at], docs[at], before[at], ids[at])))
    return pd.DataFrame(rows, columns=["part", "chunk", "head", "body"])


def group_losses(chunks: np.ndarray, bodies: list[bytes], known: Shortcut) -> pd.DataFrame:
    """For each chunk its documents' sums over the pairs of one group."""
    found = [unpacked(body) for body in bodies]
    flags, docs, before, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    docs += np.repeat(np.arange(len(found)) * CODES, [len(x[0]) for x in found])
    _, one, pair = np.unique(mixed(before, ids), return_index=True, return_inverse=True)
    distinct, word = np.unique(ids, return_inverse=True)
    near = distinct < CODES
    codes, inner = distinct[near].astype(np.int64), (flags & FAR_WORD > 0) & (flags & LAST == 0)
    which, scored = flags & (COUNTED | TARGET), flags & SCORED > 0
    places, doc = np.unique(docs[scored], return_inverse=True)
    sums = []
    for k, kind in enumerate((COUNTED, COUNTED | TARGET)):
        mine = which == kind
        counts = np.bincount(word[mine], minlength=len(distinct))
        counts[near] = known.words[k][codes]
        loss = known.pair_loss(k, np.bincount(pair[mine], minlength=len(one)), counts[word[one]])[pair]
        after = np.bincount(word[mine & inner], minlength=len(distinct))
        loss = loss + np.where(inner, known.before_loss(k, after)[word], 0.0)
        sums.append(np.bincount(doc, loss[scored], len(places)).astype(np.float32))
    bounds = np.searchsorted(places, np.arange(len(found) + 1) * CODES)
    rows = [
        (chunk, False, b"".join([(places[low:high] % CODES).astype(np.uint16).tobytes(), *(s[low:high].tobytes() for s in sums)]))
        for chunk, low, high in zip(chunks, bounds[:-1], bounds[1:], strict=True)
        if low < high
    ]
    return pd.DataFrame(rows, columns=["chunk", "head", "body"])


def document_losses(heads: list[bool], bodies: list[bytes]) -> pd.DataFrame:
    """Row, words and summed losses of the documents of one chunk."""
    head = np.frombuffer(bodies[heads.index(True)], np.int64).reshape(5, -1)
    rows, places, lengths = head[:3]
    sums = np.zeros((2, int(places.max()) + 1))
    sums[:, places] = head[3:].view(np.float64)
    for is_head, body in zip(heads, bodies, strict=True):
        if not is_head:
            n = len(body) // 10
            sums[:, np.frombuffer(body, np.uint16, n)] += np.frombuffer(body, np.float32, 2 * n, 2 * n).reshape(2, n)
    return pd.DataFrame({"_row": rows, "n": lengths, "b": sums[0][places], "a": sums[1][places]})


def losses(rows: DataFrame, known: Shortcut, groups: int, spec: ModelSpec) -> DataFrame:
    """``_row, n, a, b``: words and summed losses of the target and the background for ``rows`` (_row, target, text).

    Rows with a target are counted, rows with a number are scored.
    """
    key, shared = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(known)  # spec.frequent words, dense tables

    def tables() -> tuple[Codes, list]:
        known = shared.value
        size = int(round(known.dense.shape[1] ** 0.5))
        pairs = [known.pair_loss(k, known.dense[k].reshape(size, size), known.words[k][:size]).ravel() for k in (0, 1)]
        after = [known.before_loss(k, known.before[k]) for k in (0, 1)]
        return Codes(known.numbers, UNKNOWN if known.closed else None), list(zip(pairs, after, strict=True))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, found = held("likelihood", key, tables)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, spec):
                yield dealt(part, chunk, codes, shared.value, found, groups)
                chunk += 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_groups(batches, ["part"]):
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                some = frame.iloc[low:high]
                heads = some["head"].to_numpy(bool)
                if heads.any():
                    yield some.loc[heads, ["chunk", "head", "body"]]
                if not heads.all():
                    rest = some[~heads]
                    yield group_losses(rest["chunk"].to_numpy(), list(rest["body"]), shared.value)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_groups(batches, ["chunk"]):
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                yield document_losses(frame["head"].iloc[low:high].tolist(), frame["body"].iloc[low:high].tolist())

    parts = rows.mapInPandas(deal, "part int, chunk bigint, head boolean, body binary")
    sums = by_group(parts, ["part"]).mapInPandas(count, "chunk bigint, head boolean, body binary")
    return by_group(sums, ["chunk"]).mapInPandas(add, "_row bigint, n bigint, b double, a double")


def group_number(known: Shortcut, times: int, spec: ModelSpec) -> int:
    """Groups of even size; also few pairs are spread over some tasks."""
    pairs = int(times * (known.total.sum() - known.dense.sum()))
    return max(1, -(-pairs // spec.group), min(64, 10 * pairs // spec.group))


def measured(kept: DataFrame, row: str, found: DataFrame) -> DataFrame:
    """``kept`` with the means of its summed losses in ``found``."""
    means = found.withColumns({c: F.col(c) / F.greatest("n", F.lit(1)) for c in ("a", "b")}).select(
        F.col("_row").alias(row), F.struct("n", "a", "b", (F.col("a") - F.col("b")).alias("s")).alias(f"{row}_found")
    )
    values = [
        F.coalesce(F.col(f"{row}_found.{c}"), F.lit(0).cast(kind)).alias(name)
        for c, kind, name in zip("nabs", ("bigint", "double", "double", "double"), MEASURES, strict=True)
    ]
    columns = [F.col(f"`{c}`") for c in kept.columns if c != row]
    return kept.join(means, row, "left").select(*columns, *values)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    kept = without(docs, *MEASURES)
    row = fresh_name(kept, "_row")
    return frozen(kept, row), row


def score(docs: DataFrame, model: Model, spec: ModelSpec = ModelSpec()) -> DataFrame:
    """Add ``n_words``, ``target_loss``, ``background_loss`` and ``score`` to every row of ``docs`` (text).

    Losses are means per word; the score is the target's minus the background's, lower for texts that are more like the
    target. A text without words, or null, has 0 in all. Columns of these names are replaced.
    """
    short_batches(docs.sparkSession)
    kept, row = numbered(docs)
    scored = kept.filter(F.length("text") > 0).select(
        F.col(row).alias("_row"), F.lit(None).cast("boolean").alias("target"), "text"
    )
    counted = model.rows.select(F.lit(None).cast("bigint").alias("_row"), "target", "text")
    groups = group_number(model.shortcut, 2, spec)
    return measured(kept, row, losses(counted.unionByName(scored), model.shortcut, groups, spec))


def fit_score(docs: DataFrame, spec: ModelSpec = ModelSpec()) -> DataFrame:
    """``score(docs, fit(docs))`` for ``docs`` (text, target): pairs travel once to be counted and scored."""
    short_batches(docs.sparkSession)
    kept, row = numbered(docs)
    rows = kept.filter(F.length("text") > 0).select(F.col(row).alias("_row"), "target", "text")
    known = shortcut(rows, spec)
    return measured(kept, row, losses(rows, known, group_number(known, 1, spec), spec))
