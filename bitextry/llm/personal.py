"""Personal data: fixed rules for four kinds of spans, and a character-level BiLSTM-CRF that adds what they miss.

The network is trained in numpy on the driver, from a bounded sample of text windows with labelled spans. In the
tasks it scores overlapping windows; the scores of a stretch of text are merged and decoded as one sequence.
A span holds a digit or an ``@``, so stretches far from any such character need no scoring.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextry.llm import recurrent
from bitextry.llm.common import fresh_name, given_back, held, short_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end in code points

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match cannot start inside a run of digits: if it fails at the run's start, so it does further on.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in text.split("."))


def is_card(text: str) -> bool:
    digits = "".join(DIGITS.findall(text)) if len(text) < 64 else ""
    return 13 <= len(digits) <= 19 and passes_luhn(digits)


def is_phone(text: str, least: int = 9) -> bool:
    return least <= len(DIGITS.findall(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their ``@`` so that long runs of letters cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL_CHARACTERS:
            first -= 1
        domain = DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            done = domain.end()
            yield first, done
        at = text.find("@", max(at + 1, done))
        # The characters before a failed ``@`` cannot belong to a later address, which would have to contain it.


def base_spans(text: str) -> list[Span]:
    """Spans by the fixed rules, leftmost and non-overlapping per kind; matches that fail a check are dropped."""
    if not TRIGGER.search(text):
        return []
    spans = [(0, a, b) for a, b in emails(text)]
    spans += [(1, m.start(), m.end()) for m in IP.finditer(text) if is_ip(m.group())]
    spans += [(2, m.start(), m.end()) for m in CARD.finditer(text) if is_card(m.group())]
    spans += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if is_phone(m.group())]
    return spans


@dataclass(frozen=True)
class PersonalSpec:
    """``samples`` windows of the corpus are collected for training; the rest is the network's shape and training.

    Windows of ``window`` characters overlap by ``overlap``; ``reach`` characters around a digit or ``@`` are scored.
    """

    samples: int = 2000
    examples: int = 2400
    window: int = 64
    overlap: int = 24
    reach: int = 24
    embedding: int = 12
    hidden: int = 20
    steps: int = 200
    batch: int = 40
    rate: float = 0.02
    seed: int = 11
    at_once: int = 4096


# Symbols: 0 padding, ASCII characters, one for the others.
SYMBOLS = 130
TAGS = 1 + 2 * len(KINDS)  # outside; beginning and inside of each kind


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, points + 1, 129).astype(np.int64)


def stretches(text: str, spans: list[Span], reach: int) -> list[tuple[int, int]]:
    """Parts of ``text`` within ``reach`` of a digit or ``@`` that no span covers."""
    found: list[tuple[int, int]] = []
    covered = sorted((a, b) for _, a, b in spans)
    k = 0
    for match in TRIGGER.finditer(text):
        p = match.start()
        while k < len(covered) and covered[k][1] <= p:
            k += 1
        if k < len(covered) and covered[k][0] <= p:
            continue
        low, high = max(0, p - reach), min(len(text), p + reach + 1)
        if found and low <= found[-1][1]:
            found[-1] = (found[-1][0], high)
        else:
            found.append((low, high))
    return found


def sample_windows(docs: DataFrame, spec: PersonalSpec) -> list[str]:
    """Different windows around digits and ``@``, at most ``samples`` of them, in hash order."""
    width, reach = spec.window, spec.reach

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            parts = stretches(text or "", [], reach) if text and TRIGGER.search(text) else []
            out.append([text[a : a + width] for a, _ in parts])
        return pd.Series(out)

    windows = (
        docs.filter(F.col("text").rlike("[0-9@]"))
        .select(F.explode(cut("text")).alias("window"))
        .select("window", F.xxhash64("window").alias("h"))
        .distinct()
        .orderBy("h", "window")
        .limit(spec.samples)
    )
    return [row.window for row in windows.collect()]


def written(rng: np.random.Generator, kind: int) -> str:
    """A made-up span of ``kind``, in one of the ways people write it."""

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def letters(n: int) -> str:
        return "".join(map(chr, rng.integers(97, 123, n)))

    if kind == 0:
        host = letters(int(rng.integers(3, 8))) + (digits(1) if rng.random() < 0.5 else "")
        ending = ("example.com", "example.org", "co.uk", "de", "fr", "net")[rng.integers(6)]
        name = letters(int(rng.integers(2, 9))) + ("." + digits(2) if rng.random() < 0.6 else "")
        return f"{name}@{host}.{ending}"
    if kind == 1:
        return ".".join(map(str, rng.integers(0, 256, 4)))
    if kind == 2:
        body = "4" + digits(14)
        check = next(str(c) for c in range(10) if passes_luhn(body + str(c)))
        number = body + check
        join = ("", "", " ", "-")[rng.integers(4)]
        return join.join(number[i : i + 4] for i in range(0, 16, 4))
    area, middle, end = digits(3), digits(3), digits(4)
    form = (
        f"+1 ({area}) {middle}-{end}",
        f"({area}) {middle}-{end}",
        f"+1-{area}-{middle}-{end}",
        f"{area}-{middle}-{end}",
        f"+{digits(2)} {digits(3)} {digits(7)}",
    )
    return form[rng.integers(len(form))]


def labelled(windows: list[str], spec: PersonalSpec) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of the training examples.

    A third are corpus windows with the spans of the fixed rules. The others are corpus windows without digits
    in them, or made-up contexts where the corpus has none, with one to three written spans put in.
    """
    rng = np.random.default_rng(spec.seed)
    symbols = np.zeros((spec.examples, spec.window), np.int64)
    tags = np.zeros((spec.examples, spec.window), np.int64)
    words = [w for text in windows for w in text.split() if not TRIGGER.search(w)] or ["of", "the", "la", "und"]
    for row in range(spec.examples):
        if windows and row % 3 == 0:
            text = windows[rng.integers(len(windows))]
            spans = base_spans(text)
        else:
            parts, spans, used = [], [], 0
            for _ in range(rng.integers(1, 4)):
                for _ in range(rng.integers(0, 4)):
                    parts.append(words[rng.integers(len(words))])
                    used += len(parts[-1]) + 1
                kind = int(rng.integers(len(KINDS)))
                parts.append(written(rng, kind))
                spans.append((kind, used, used + len(parts[-1])))
                used += len(parts[-1]) + 1
            parts.append(words[rng.integers(len(words))])
            text = (" ".join(parts) + (".", "", "\n")[rng.integers(3)])[: spec.window]
        code = symbols_of(text[: spec.window])
        symbols[row, : len(code)] = code
        for kind, a, b in spans:
            tags[row, a:b] = 2 + 2 * kind
            if a < spec.window:
                tags[row, a] = 1 + 2 * kind
    return symbols, tags


def fit(docs: DataFrame, spec: PersonalSpec = PersonalSpec()) -> dict[str, np.ndarray]:
    """Weights of the network, from at most ``spec.samples`` windows of ``docs`` (text) and written spans."""
    symbols, tags = labelled(sample_windows(docs, spec), spec)
    shape = recurrent.Shape(SYMBOLS, spec.embedding, spec.hidden, TAGS)
    return recurrent.train(shape, symbols, tags, spec.steps, spec.batch, spec.rate, spec.seed)


def merged_scores(
    weights: dict[str, np.ndarray], texts: list[str], spec: PersonalSpec
) -> Iterator[np.ndarray]:
    """Tag scores of each text; where windows overlap, the one whose edge is farther counts more."""
    step = spec.window - spec.overlap
    places = [(k, a) for k, text in enumerate(texts) for a in range(0, max(1, len(text) - spec.overlap), step)]
    codes = [symbols_of(text) for text in texts]
    weight = np.minimum(np.arange(1, spec.window + 1), np.arange(spec.window, 0, -1)).astype(np.float32)[:, None]
    sums = [np.zeros((len(text), TAGS), np.float32) for text in texts]
    mass = [np.zeros((len(text), 1), np.float32) for text in texts]
    for first in range(0, len(places), spec.at_once):
        part = places[first : first + spec.at_once]
        symbols = np.zeros((len(part), spec.window), np.int64)
        for row, (k, a) in enumerate(part):
            code = codes[k][a : a + spec.window]
            symbols[row, : len(code)] = code
        scores = recurrent.emissions(weights, symbols)
        for row, (k, a) in enumerate(part):
            n = min(spec.window, len(texts[k]) - a)
            sums[k][a : a + n] += (scores[row] * weight)[:n]
            mass[k][a : a + n] += weight[:n]
    for total, parts in zip(sums, mass, strict=True):
        yield total / parts


def tagged_spans(tags: np.ndarray) -> list[Span]:
    """Runs of one kind; a beginning starts a new one."""
    spans, start, kind = [], 0, -1
    for p, tag in enumerate([*tags.tolist(), 0]):
        now = (tag - 1) // 2 if tag else -1
        if kind >= 0 and (now != kind or tag % 2 == 1):
            spans.append((kind, start, p))
            kind = -1
        if now >= 0 and kind < 0:
            start, kind = p, now
    return spans


def acceptable(kind: int, text: str, start: int, end: int) -> bool:
    """Whether a decoded span has the make-up of its kind and stands alone."""
    span = text[start:end]
    if (start and text[start - 1].isalnum()) or text[end : end + 1].isalnum():
        return False
    if kind == 0:
        return bool(next(emails(span), (0, 0)) == (0, len(span)))
    if kind == 1:
        return bool(IP.fullmatch(span)) and is_ip(span)
    if kind == 2:
        return bool(CARD.fullmatch(span)) and is_card(span)
    return bool(re.fullmatch(r"[+(]?[0-9][\x20().0-9-]+[0-9]", span)) and is_phone(span)


def all_spans(
    weights: dict[str, np.ndarray], texts: list[str], spec: PersonalSpec
) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the fixed rules, and those that the network adds beside them."""
    found = [(base_spans(text), []) for text in texts]
    parts = [
        (k, a, b)
        for k, text in enumerate(texts)
        for a, b in (stretches(text, found[k][0], spec.reach) if TRIGGER.search(text) else [])
    ]
    scores = merged_scores(weights, [texts[k][a:b] for k, a, b in parts], spec)
    for (k, a, _), score in zip(parts, scores, strict=True):
        base, added = found[k]
        for kind, low, high in tagged_spans(recurrent.viterbi(score, weights["transitions"])):
            low, high = low + a, high + a
            taken = any(x < high and low < y for _, x, y in base) or any(x < high and low < y for _, x, y in added)
            if not taken and acceptable(kind, texts[k], low, high):
                added.append((kind, low, high))
    return found


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, weights: dict[str, np.ndarray], spec: PersonalSpec = PersonalSpec()) -> DataFrame:
    """Add ``spans`` to every row of ``docs`` (text): kind, start, end and whether a fixed rule found it.

    Offsets are code points, ends exclusive; spans come by kind as in ``KINDS``, then by start. A null or empty
    text has none. Spans of the network overlap no others. A column ``spans`` of ``docs`` is replaced.
    """
    key = uuid.uuid4().hex
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # some ten thousand numbers

    def searched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = held("personal", key, lambda: shared.value)
        for texts in batches:
            rows = all_spans(own, [t or "" for t in texts], spec)
            yield pd.Series(
                [
                    [
                        {"kind": KINDS[kind], "start": a, "end": b, "base": base}
                        for kind, a, b, base in sorted(
                            [(*s, True) for s in base_found] + [(*s, False) for s in added]
                        )
                    ]
                    for base_found, added in rows
                ]
            )

    @F.pandas_udf(SPANS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from given_back(searched(batches))

    name = fresh_name(docs, "_spans")
    found = docs.withColumn(name, search("text"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "spans"]
    return found.select(*kept, F.col(name).alias("spans"))


def blanked(content: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each (start, end, kind) replaced by its kind in brackets.

    Of spans that overlap, the one that starts first is replaced, and what remains of the others with it.
    """
    parts, done = [], 0
    for start, end, kind in sorted(found):
        if start >= done:
            parts += [content[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, content[done:]])


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans`` cut out of ``text``, each replaced by its kind in brackets; see :func:`blanked`."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for content, found in zip(texts, spans, strict=True):
            whole = content is None or found is None or not len(found)
            out.append(content if whole else blanked(content, [(s["start"], s["end"], s["kind"]) for s in found]))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, mask(text, "spans"))


def redacted(docs: DataFrame, weights: dict[str, np.ndarray], spec: PersonalSpec = PersonalSpec()) -> DataFrame:
    """``docs`` with what :func:`find` finds in ``text`` masked, in one step, so that a task has one worker. Null stays null."""
    key = uuid.uuid4().hex
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = held("personal", key, lambda: shared.value)
        for texts in batches:
            rows = all_spans(own, [t or "" for t in texts], spec)
            out = [
                text if text is None else blanked(text, [(a, b, KINDS[kind]) for kind, a, b in [*base, *added]])
                for text, (base, added) in zip(texts, rows, strict=True)
            ]
            yield pd.Series(out, dtype=object)

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from given_back(cleaned(batches))

    return docs.withColumn("text", redact("text"))
