"""Scalar text functions. All of them are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as white space.
# (?U) makes \s the Unicode property; Python adds the separators U+001C to U+001F.
WHITESPACE = r"[\s\x1c-\x1f]"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Remove Unicode white space from both ends."""
    return F.regexp_replace(as_column(text), f"(?U)^{WHITESPACE}+|{WHITESPACE}+$", "")


def normalize_line(text: Column | str, lowercase: bool = False) -> Column:
    """Strip, then optionally lowercase: what a scorer does to each line it reads."""
    stripped = strip(text)
    return F.lower(stripped) if lowercase else stripped


def clean_output(text: Column | str) -> Column:
    """Strip generated text and put it on one line."""
    return F.replace(strip(text), F.lit("\n"), F.lit(" "))


def instruction_prefix(text: Column | str, prefix: str = "") -> Column:
    """``prefix + " " + text``; an empty prefix still leaves the leading space."""
    return F.concat(F.lit(prefix + " "), as_column(text))


def char_limit(text: Column | str, limit: int = 10_000) -> Column:
    """The first ``limit`` code points."""
    return F.substring(as_column(text), 1, limit)


def run_slug(path: Column | str, drop_once: str | None = None) -> Column:
    """An output folder as a run id: separators become ``_``, ``models_`` goes, and one task prefix may go."""
    slug = F.replace(F.replace(as_column(path), F.lit("/"), F.lit("_")), F.lit("models_"), F.lit(""))
    if drop_once:
        at = F.locate(drop_once, slug)
        cut = F.concat(F.substring(slug, F.lit(1), at - 1), F.substring(slug, at + len(drop_once), F.length(slug)))
        slug = F.when(at > 0, cut).otherwise(slug)
    return slug


def percent(share: Column) -> Column:
    """A share as a whole percentage, for example ``42%``."""
    return F.format_string("%.0f%%", share * 100)
