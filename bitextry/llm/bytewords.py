"""Words as bytes: runs of ASCII letters and digits and of all characters beyond ASCII, with A to Z in lower case."""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# The same words in a string, for their places in code points.
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CHUNK = 1 << 20


def kept(i: int) -> int:
    """The byte that stands for byte ``i``: itself in a word, in lower case, and a blank elsewhere."""
    c = chr(i)
    return i if i >= 128 or c.isdigit() or "a" <= c <= "z" else ord(c.lower()) if "A" <= c <= "Z" else 32


SPACED = bytes(map(kept, range(256)))


def utf8(column: str = "text") -> Column:
    """The bytes of a text column, which Python splits faster than strings; null stays null."""
    return F.col(column).cast("string").cast("binary")


def word_lists(text: bytes | None, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a whole text in order, in lists from about ``chunk`` bytes each; no list for null."""
    if not text:
        return
    spaced, low = text.translate(SPACED), 0
    while low < len(spaced):
        high = spaced.find(b" ", low + chunk)
        if high < 0:
            high = len(spaced)
        yield spaced[low:high].split()
        low = high
