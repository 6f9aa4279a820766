"""Histogram sort: shards of even size from exact counts below candidate boundaries, and one exchange.

Rows are ordered by a few non-negative 63-bit keys. A splitter starts as a cell of the first key's leading bits; each
round counts the exact bytes in the sub-cells of the splitters that are not settled, and a splitter is settled
when an edge of its sub-cell is near enough to its share. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextry.llm.common import frozen, without

KEY_BITS = 63
# Bits of a key that are known after each round.
ROUNDS = (12, 20, 28, 36, 44, 52, 60, 63)


def hash_key(*columns: Column) -> Column:
    """A 63-bit key from the values of ``columns``."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


@dataclass
class Splitter:
    """Where a share of all bytes ends: the cell that holds it, as full values of the keys before and leading bits of one."""

    share: float
    fixed: tuple[int, ...] = ()
    lead: int | None = None  # None: the whole range of the key after ``fixed``
    below: int = 0
    settled: bool = False
    # Rows whose leading bits (shifted right) are greater lie above the splitter.
    cut: tuple[tuple[int, ...], int, int] | None = field(default=None)

    def place(self, fixed: tuple[int, ...], shift: int, lead: int) -> None:
        self.cut, self.settled = (fixed, shift, lead), True


def cells(rows: DataFrame, keys: Sequence[str], size: str, level: int, bits: int, known: int, open_: list[Splitter]):
    """Exact bytes and rows of the sub-cells of all unsettled splitters, by their ``(fixed, lead)``, in order."""
    key, shift = F.col(keys[level]), KEY_BITS - bits
    wanted = None
    for fixed, group in groupby(sorted({(s.fixed, s.lead) for s in open_}, key=str), key=lambda c: c[0]):
        leads = [lead for _, lead in group]
        here = F.lit(True)
        for name, value in zip(keys, fixed, strict=False):
            here &= F.col(name) == value
        if leads != [None]:
            here &= F.shiftrightunsigned(key, KEY_BITS - known).isin(leads)
        wanted = here if wanted is None else wanted | here
    found = (
        rows.filter(wanted)
        .groupBy(*keys[:level], F.shiftrightunsigned(key, shift).alias("_cell"))
        .agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        .collect()
    )
    out: dict[tuple, list[tuple[int, int, int]]] = {}
    for row in sorted(found, key=lambda r: r["_cell"]):
        fixed = tuple(row[k] for k in keys[:level])
        lead = None if known == 0 else row["_cell"] >> (bits - known)
        out.setdefault((fixed, lead), []).append((row["_cell"], row["_bytes"], row["_rows"]))
    return out


def splitters(rows: DataFrame, keys: Sequence[str], size: str, shards: int, tolerance: float) -> list[Splitter]:
    """The ``shards - 1`` splitters of ``rows``, each within ``tolerance`` of a mean shard, or as near as rows allow.

    A round costs one aggregation, whose result has at most 4096 rows at first, then 256 for each splitter.
    """
    found: list[Splitter] = []
    total = 0
    for level in range(len(keys)):
        known = 0
        for bits in ROUNDS:
            if not found:
                first = cells(rows, keys, size, level, bits, 0, [Splitter(0)])
                total = sum(n for _, n, _ in first.get(((), None), []))
                found = [Splitter(total * k / shards) for k in range(1, shards)]
                counted = first
            else:
                open_ = [s for s in found if not s.settled]
                if not open_:
                    return found
                counted = cells(rows, keys, size, level, bits, known, open_)
            last = level == len(keys) - 1 and bits == KEY_BITS
            for s in found:
                if not s.settled:
                    refine(s, counted.get((s.fixed, s.lead), []), KEY_BITS - bits, tolerance * total / shards, last)
            known = bits
        for s in found:
            if not s.settled:
                s.fixed, s.lead = (*s.fixed, s.lead), None
    return found


def refine(s: Splitter, counted: list[tuple[int, int, int]], shift: int, near: float, last: bool) -> None:
    """Move ``s`` into the sub-cell that holds its share, or settle it at one of that sub-cell's edges."""
    if not counted:
        s.place(s.fixed, shift, -1)
        return
    ends = [s.below + n for n in accumulate(n for _, n, _ in counted)]
    at = next((i for i, end in enumerate(ends) if end > s.share), len(ends) - 1)
    lead, rows, (low, high) = counted[at][0], counted[at][2], (ends[at] - counted[at][1], ends[at])
    # A single row cannot be cut.
    if min(s.share - low, abs(high - s.share)) <= near or rows == 1 or last:
        # At the lower edge every row of the sub-cell is above.
        s.place(s.fixed, shift, lead - 1 if s.share - low <= abs(high - s.share) else lead)
    s.lead, s.below = lead, low


def above(s: Splitter, keys: Sequence[str]) -> Column:
    fixed, shift, lead = s.cut
    out = F.shiftrightunsigned(F.col(keys[len(fixed)]), shift) > lead
    for name, value in reversed(list(zip(keys, fixed, strict=False))):
        out = (F.col(name) > value) | ((F.col(name) == value) & out)
    return out


def shard_by_size(
    rows: DataFrame, keys: Sequence[Column], size: str, shards: int, tolerance: float = 0.001
) -> DataFrame:
    """Add ``shard`` from 0 and ``slot``, the row's gapless place in its shard, to ``rows``.

    Shards have even sums of the column ``size``: each boundary is within ``tolerance`` of a mean shard, unless single
    rows are larger. Rows are ordered by ``keys``, non-negative 63-bit numbers, then by the order of a frozen
    copy of ``rows``. Rows that agree in the first key stay together where the tolerance allows; a larger
    group is cut. Null keys count as 0. An empty table gives an empty result. Columns of ``rows`` with the
    names of outputs or inner columns are replaced.
    """
    names = [f"_key{k}" for k in range(len(keys))]
    inner = (*names, "_row", "_part", "_shift")
    keyed = without(rows, "shard", "slot", *inner)
    keyed = keyed.select("*", *(F.coalesce(k, F.lit(0)).cast("bigint").alias(n) for k, n in zip(keys, names, strict=True)))
    kept = frozen(keyed, part="_part")
    found = splitters(kept, [*names, "_row"], size, shards, tolerance)
    number = F.lit(0)
    for s in found:
        number = number + above(s, [*names, "_row"]).cast("int")
    placed = kept.withColumn("shard", number.cast("int"))
    parts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    here = Window.partitionBy("shard", "_part").orderBy("_row")
    return (
        placed.join(shifts, ["shard", "_part"])
        .withColumn("slot", (F.col("_shift") + F.row_number().over(here) - 1).cast("bigint"))
        .drop(*inner)
    )
