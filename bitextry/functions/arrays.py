"""Token-id arrays: truncation, padding, masks, labels and repair. Built-in expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitextry.functions.strings import as_column

# Fixed value: the label that a cross-entropy loss skips.
IGNORE_LABEL = -100


def truncate(ids: Column | str, max_length: int, side: str = "right") -> Column:
    """Cut to ``max_length`` ids, dropping the tail (``right``) or the head (``left``)."""
    ids = as_column(ids)
    if side == "right":
        return F.slice(ids, 1, max_length)
    if side == "left":
        return F.slice(ids, F.greatest(F.size(ids) - max_length, F.lit(0)) + 1, max_length)
    raise ValueError(f"side must be 'left' or 'right', not {side!r}")


def _beside(ids: Column, fill: Column, side: str) -> Column:
    if side == "left":
        return F.concat(fill, ids)
    if side == "right":
        return F.concat(ids, fill)
    raise ValueError(f"side must be 'left' or 'right', not {side!r}")


def pad(ids: Column | str, width: Column | int, pad_id: int = 0, side: str = "right") -> Column:
    """Pad to ``width`` ids; longer rows stay as they are."""
    ids = as_column(ids)
    width = F.lit(width) if isinstance(width, int) else width
    return _beside(ids, F.array_repeat(F.lit(pad_id), F.greatest(width - F.size(ids), F.lit(0))), side)


def attention_mask(ids: Column | str, width: Column | int, side: str = "right") -> Column:
    """1 for each real id and 0 for each pad that :func:`pad` adds."""
    ids = as_column(ids)
    width = F.lit(width) if isinstance(width, int) else width
    return _beside(
        F.array_repeat(F.lit(1), F.size(ids)),
        F.array_repeat(F.lit(0), F.greatest(width - F.size(ids), F.lit(0))),
        side,
    )


def completion_labels(prompt_ids: Column | str, completion_ids: Column | str) -> Column:
    """Labels for prompt + completion in which only the completion counts."""
    masked = F.array_repeat(F.lit(IGNORE_LABEL), F.size(as_column(prompt_ids)))
    return F.concat(masked, as_column(completion_ids))


def mask_pads(ids: Column | str, pad_id: int) -> Column:
    """Labels in which pad positions do not count."""
    return F.transform(as_column(ids), lambda x: F.when(x == pad_id, F.lit(IGNORE_LABEL)).otherwise(x))


def unmask_labels(labels: Column | str, pad_id: int) -> Column:
    """The ignore label back to the pad id, so that labels can be decoded."""
    return F.transform(as_column(labels), lambda x: F.when(x == IGNORE_LABEL, F.lit(pad_id)).otherwise(x))


def resolve_pad_id(pad_id: int | None, eos_id: int | None) -> int:
    """The pad id, else the end id, else 0."""
    return pad_id if pad_id is not None else eos_id if eos_id is not None else 0


def repair_ids(ids: Column | str, vocab_size: int, pad_id: int) -> Column:
    """Replace ids outside ``[0, vocab_size)`` by the pad id."""
    return F.transform(as_column(ids), lambda x: F.when((x < 0) | (x >= vocab_size), F.lit(pad_id)).otherwise(x))


def cut_prompt(ids: Column | str, boundary: Column) -> Column:
    """Drop the first ``boundary`` ids of a generated sequence."""
    ids = as_column(ids)
    return F.slice(ids, boundary + 1, F.size(ids))


def count_non_pad(ids: Column | str, pad_id: int) -> Column:
    return F.size(F.array_remove(as_column(ids), pad_id))


def argmax(scores: Column | str) -> Column:
    """Position of the largest score, the first one on ties (0-based)."""
    scores = as_column(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_ids(logits: Column | str) -> Column:
    """Token ids from per-position scores (``ARRAY<ARRAY<FLOAT>>``)."""
    return F.transform(as_column(logits), argmax)


def round_ids(values: Column | str) -> Column:
    """Float ids to integers, halves to even."""
    return F.transform(as_column(values), lambda x: F.rint(x).cast("bigint"))
