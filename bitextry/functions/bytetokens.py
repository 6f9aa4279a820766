"""Words of whole Arrow arrays of texts, found in their UTF-8 bytes.

White space and the marks that the 13a rules set apart are told by their bytes: a mark is one ASCII byte, and no byte
of a longer character looks like one. The few texts whose replacements depend on each other are left to the rules of
:mod:`bitextry.functions.tokenizers`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes that are looked at together.
BYTES_PER_SLICE = 1_000_000

# The white space of ``strings.WHITESPACE`` in one byte, and in two or three bytes of UTF-8.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(9, 14), *range(0x1C, 0x21)]] = True
_LONG_SPACES = tuple(
    chr(point).encode() for point in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
_LEADS = {lead: [whole for whole in _LONG_SPACES if whole[0] == lead] for lead in {whole[0] for whole in _LONG_SPACES}}
# The marks of ``tokenizers.MTEVAL_13A_APART``.
_MARK = np.zeros(256, dtype=bool)
for first, last in ("{~", "[`", "!&", "(/", ":@"):
    _MARK[ord(first) : ord(last) + 1] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
# Texts with one of these need the 13a rules in order.
ORDERED_13A = ("&", "<skipped>", "\n", "..", ",,", ".,", ",.")


def needs_order(text: Column) -> Column:
    """Whether the 13a rules may not be applied all at once."""
    found = F.lit(False)
    for part in ORDERED_13A:
        found |= F.contains(text, F.lit(part))
    return found


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, and the last ends."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    starts = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.empty(0, dtype=np.uint8)
    return held[starts[0] : starts[-1]], starts - starts[0]


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space."""
    space = _SPACE[data]
    if not len(data) or data.max() < 0x80:
        return space
    for lead, wholes in _LEADS.items():
        at = np.flatnonzero(data == lead)
        if not len(at):
            continue
        size = len(wholes[0])
        at = at[at + size <= len(data)]
        number = data[at + 1].astype(np.int64)
        for k in range(2, size):
            number = number << 8 | data[at + k]
        at = at[np.isin(number, [int.from_bytes(whole[1:], "big") for whole in wholes])]
        for k in range(size):
            space[at + k] = True
    return space


def _apart(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which bytes are marks that the 13a rules set apart. Texts begin and end as if beside white space."""
    mark, digit = _MARK[data], _DIGIT[data]
    before, after = np.zeros_like(digit), np.zeros_like(digit)
    before[1:], after[:-1] = digit[:-1], digit[1:]
    edges = starts[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    stop, dash = (data == ord(".")) | (data == ord(",")), data == ord("-")
    return mark & ~(stop & before & after) & ~(dash & ~before)


def _slices(starts: np.ndarray):
    """Consecutive ranges of texts of about ``BYTES_PER_SLICE`` each (a longer text stands alone)."""
    cuts = np.flatnonzero(np.diff(starts[1:] // BYTES_PER_SLICE)) + 1
    edges = [0, *cuts.tolist(), len(starts) - 1]
    return [(begin, end) for begin, end in zip(edges[:-1], edges[1:]) if end > begin]


def squeezed(texts: pa.Array) -> pa.Array:
    """Texts without white space."""
    data, starts = text_bytes(texts)
    kept, ends = [np.empty(0, dtype=np.uint8)], [np.zeros(1, dtype=np.int64)]
    for begin, end in _slices(starts):
        part = data[starts[begin] : starts[end]]
        keep = ~_spaces(part)
        passed = np.append(0, np.cumsum(keep))
        ends.append(ends[-1][-1] + passed[starts[begin + 1 : end + 1] - starts[begin]])
        kept.append(part[keep])
    return _strings(np.concatenate(ends), np.concatenate(kept))


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def words(texts: pa.Array, marks: bool = False) -> pa.ListArray:
    """The words of each text, and with ``marks`` the marks of the 13a rules as words of their own."""
    data, starts = text_bytes(texts)
    kept, places, counts = [np.empty(0, dtype=np.uint8)], [], [np.zeros(1, dtype=np.int64)]
    size = 0
    for begin, end in _slices(starts):
        part, edges = data[starts[begin] : starts[end]], starts[begin : end + 1] - starts[begin]
        keep = ~_spaces(part)
        fresh = np.ones(len(part), dtype=bool)
        np.invert(keep[:-1], out=fresh[1:])
        if marks:
            apart = _apart(part, edges)
            fresh |= apart
            fresh[1:] |= apart[:-1]
        fresh[edges[edges < len(part)]] = True
        fresh &= keep
        begins = np.flatnonzero(fresh)
        counts.append(counts[-1][-1] + np.searchsorted(begins, edges[1:]))
        places.append(size + np.flatnonzero(fresh[keep]))
        kept.append(part[keep])
        size += len(kept[-1])
    tokens = _strings(np.concatenate([*places, [size]]).astype(np.int64), np.concatenate(kept))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(counts).astype(np.int32)), tokens)


def ordered_words(texts: pa.Array, given: pa.Array) -> pa.ListArray:
    """13a words: those that are given for a text, or else found in it."""
    found = words(texts, marks=True)
    if given.null_count == len(given):
        return found
    rows = np.arange(len(texts))
    has = given.is_valid().to_numpy(zero_copy_only=False)
    both = pa.concat_arrays([found, given.cast(found.type)])
    return both.take(pa.array(np.where(has, rows + len(texts), rows)))


def for_each_reference(refs: pa.Array, make: Callable[..., pa.Array], *more: pa.Array) -> pa.ListArray:
    """What ``make`` gives for the references of all rows at once, put back in lists."""
    lengths = pc.fill_null(pc.list_value_length(refs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), make(refs.flatten(), *(m.flatten() for m in more)))
