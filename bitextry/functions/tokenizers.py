"""Tokenizers: each maps a text column to ``ARRAY<STRING>``."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitextry.functions.strings import WHITESPACE, as_column
from bitextry.worker import once

Tokenizer = Callable[[Column], Column]

# The ordered rewrite rules of the mteval-v13a tokenizer (NIST), as (pattern, replacement).
MTEVAL_13A_RULES = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
# A mark that those rules set apart: any but ``.``, ``,`` and ``-``; one of the first two not between digits; a dash after a digit.
MTEVAL_13A_APART = (
    r"[\{-\~\[-\`!-\&\(-\/\:-\@](?:(?<=[^.,\-])|(?<=[^0-9][.,])|(?<=[.,])(?![0-9])|(?<=[0-9]-))"
)
# What mteval-v13a replaces before the rules, as (literal, replacement).
MTEVAL_13A_LITERALS = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)

# The rules of the international tokenizer of mteval-v14 (NIST), as (pattern, replacement).
INTERNATIONAL_RULES = (
    (r"(\P{N})(\p{P})", "$1 $2 "),
    (r"(\p{P})(\P{N})", " $1 $2"),
    (r"(\p{S})", " $1 "),
)
# Code points that the Chinese tokenizer takes as tokens of their own, first and last.
CHINESE_RANGES = (
    (0x3400, 0x4DB5),
    (0x4E00, 0x9FA5),
    (0x9FA6, 0x9FBB),
    (0xF900, 0xFA2D),
    (0xFA30, 0xFA6A),
    (0xFA70, 0xFAD9),
    (0x20000, 0x2A6D6),
    (0x2F800, 0x2FA1D),
    (0xFF00, 0xFFEF),
    (0x2E80, 0x2EFF),
    (0x3000, 0x303F),
    (0x31C0, 0x31EF),
    (0x2F00, 0x2FDF),
    (0x2FF0, 0x2FFF),
    (0x3100, 0x312F),
    (0x31A0, 0x31BF),
    (0xFE10, 0xFE1F),
    (0xFE30, 0xFE4F),
    (0x2600, 0x26FF),
    (0x2700, 0x27BF),
    (0x3200, 0x32FF),
    (0x3300, 0x33FF),
)
CHINESE = "([" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in CHINESE_RANGES) + "])"


def whitespace_tokens(text: Column | str) -> Column:
    """Split on runs of Unicode white space; no empty tokens."""
    return F.array_remove(F.split(as_column(text), f"(?U){WHITESPACE}+"), "")


def _rewrite(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def mteval_13a_tokens(text: Column | str) -> Column:
    """The 13a tokenization used by default in machine-translation scoring.

    Outside a run of marks before a digit, the rules set each mark apart by what is beside it, so one
    pass gives the same tokens; in such a run the pairing matters, and these lines take the rules as
    written. The first rule also puts spaces around every space, which changes no token.
    """
    out = as_column(text)
    for literal, replacement in MTEVAL_13A_LITERALS:
        out = F.replace(out, F.lit(literal), F.lit(replacement))
    out = F.concat(F.lit(" "), out, F.lit(" "))

    def ruled(line: Column) -> Column:
        once = F.regexp_replace(line, MTEVAL_13A_APART, " $0 ")
        return whitespace_tokens(F.when(line.rlike(r"[.,]{2}[0-9]"), _rewrite(line, MTEVAL_13A_RULES)).otherwise(once))

    # A lambda binds the line, which would else be made again at each use.
    return F.transform(F.array(out), ruled)[0]


def international_tokens(text: Column | str) -> Column:
    """Words, with punctuation apart unless a digit is beside it, and with symbols apart, in any script."""
    return whitespace_tokens(_rewrite(as_column(text), INTERNATIONAL_RULES))


def chinese_tokens(text: Column | str) -> Column:
    """Chinese characters one by one, the rest by the 13a rules; entities and line ends are left alone."""
    apart = F.regexp_replace(as_column(text), CHINESE, " $1 ")
    return whitespace_tokens(_rewrite(apart, MTEVAL_13A_RULES))


def character_tokens(text: Column | str) -> Column:
    """Every code point that is not white space."""
    return F.array_remove(F.split(F.regexp_replace(as_column(text), f"(?U){WHITESPACE}+", ""), ""), "")


def alphanumeric_tokens(text: Column | str) -> Column:
    """Lowercased runs of ASCII letters and digits, as ROUGE counts them."""
    return F.array_remove(F.split(F.lower(as_column(text)), "[^a-z0-9]+"), "")


def pluggable(
    factory: Callable[[], Callable], returns: str = "array<string>", batched: bool = False
) -> Tokenizer:
    """A tokenizer from ``factory``, which runs once per Python worker and returns ``text -> list``.

    With ``batched`` it returns ``list of texts -> list of lists`` and is called once per Arrow batch, without the
    null texts. Use ``returns="array<int>"`` for a tokenizer that yields ids.
    """
    key = uuid.uuid4().hex

    @F.pandas_udf(returns)
    def tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = once("tokenizer", key, factory)
        for texts in batches:
            known = texts.dropna().tolist()
            made = list(encode(known)) if batched else list(map(encode, known))
            if len(made) != len(known):
                raise ValueError("a tokenizer must return one list per text")
            found = iter(made)
            yield pd.Series([None if missing else next(found) for missing in texts.isna()], dtype=object)

    return lambda text: tokenize(as_column(text))


TOKENIZERS: dict[str, Tokenizer] = {
    "none": whitespace_tokens,
    "13a": mteval_13a_tokens,
    "char": character_tokens,
    "intl": international_tokens,
    "zh": chinese_tokens,
}


def tokenizer(choice: str | Tokenizer) -> Tokenizer:
    """Look a tokenizer up by name, or take the caller's own."""
    if callable(choice):
        return choice
    if choice not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {choice!r}; known: {', '.join(TOKENIZERS)}")
    return TOKENIZERS[choice]
