"""Arrow kernels: additive per-row statistics of the corpus metrics.

Each kernel works on a whole Arrow batch with numpy. The statistics add up over rows, so the corpus
score needs one partial aggregation of a handful of numbers and never a shuffle of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitextry.functions.bytetokens import for_each_reference, needs_order, ordered_words, squeezed, text_bytes, words

BLEU_ORDER = 4
CHRF_ORDER = 6
# Tokens that a kernel expands at once: hash tables stay in the processor cache, and memory does not
# follow the batch size.
TOKENS_PER_SLICE = 50_000


def _slices(weights: np.ndarray) -> Iterator[slice]:
    """Consecutive row ranges of about ``TOKENS_PER_SLICE`` each (a longer row stands alone)."""
    cuts = np.flatnonzero(np.diff(np.cumsum(weights) // TOKENS_PER_SLICE)) + 1
    edges = [0, *cuts.tolist(), len(weights)]
    for begin, end in zip(edges[:-1], edges[1:]):
        if end > begin:
            yield slice(begin, end)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _codes(*texts: pa.Array) -> list[np.ndarray]:
    """One shared integer code per distinct token, split back per input array."""
    flat = pa.concat_arrays([t.cast(pa.string()) for t in texts])
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(t) for t in texts])[:-1])


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in a row, and the length of each row."""
    data, _ = text_bytes(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return points, pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def clipped_matches(
    hyp: tuple[np.ndarray, np.ndarray], refs: list[tuple[np.ndarray, np.ndarray]], max_order: int
) -> np.ndarray:
    """Clipped n-gram matches, shape ``(rows, max_order)``.

    ``hyp`` and every entry of ``refs`` are (token codes of all rows, tokens per row). A hypothesis
    n-gram matches at most as often as in the reference that has it most often.
    """
    sides = [hyp, *refs]
    rows = len(hyp[1])
    lengths = np.concatenate([n for _, n in sides])
    codes, different = _dense(np.concatenate([c for c, _ in sides]))
    bits, side_bits = different.bit_length(), len(refs).bit_length()
    pair_bits = (different + 1).bit_length()
    if len(refs) == 1 and max(rows - 1, 0).bit_length() + max_order * pair_bits + 1 < 64:
        return _matches_of_pairs(codes, lengths, rows, pair_bits, different, max_order)
    if max(rows - 1, 0).bit_length() + max_order * bits + side_bits < 64:
        return _matches_by_sort(codes, lengths, rows, bits, side_bits, max_order)
    if rows == 1:
        return _matches_by_hash(hyp, refs, max_order)
    # Fewer rows have fewer different tokens.
    half = rows // 2
    ends = [int(n[:half].sum()) for _, n in sides]
    first, *firsts = [(c[:end], n[:half]) for (c, n), end in zip(sides, ends)]
    second, *seconds = [(c[end:], n[half:]) for (c, n), end in zip(sides, ends)]
    return np.concatenate([clipped_matches(first, firsts, max_order), clipped_matches(second, seconds, max_order)])


def _dense(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Codes renumbered from 1 without gaps, and how many different ones there are."""
    if len(codes) and codes.max() < 1 << 21:
        seen = np.zeros(int(codes.max()) + 1, dtype=bool)
        seen[codes] = True
        numbers = np.cumsum(seen)
        return numbers[codes], int(numbers[-1])
    values, codes = np.unique(codes, return_inverse=True)
    return codes + 1, len(values)


def _matches_of_pairs(
    codes: np.ndarray, lengths: np.ndarray, rows: int, bits: int, different: int, max_order: int
) -> np.ndarray:
    """Matches with one reference, from how often each n-gram is on one side and not on the other.

    What is on both sides cancels out of a sum of +1 for the hypothesis and -1 for the reference over each run of the sorted
    n-grams. The ends of both sides are filled up with different tokens, so n-grams beyond an end meet no other.
    """
    out = np.zeros((rows, max_order), dtype=np.int64)
    if not len(codes):
        return out
    gap = max_order - 1
    texts = np.arange(2 * rows)
    at = np.arange(len(codes)) + np.repeat(texts * gap, lengths)
    apart = np.zeros(len(codes) + 2 * rows * gap + max_order, dtype=np.int64)
    apart[int(lengths[:rows].sum()) + rows * gap :] = different + 1
    apart[at] = codes
    size = len(apart) - max_order
    gram = apart[:size] << bits
    gram |= apart[1 : 1 + size]
    for k in range(2, max_order):
        gram <<= bits
        gram |= apart[k : k + size]
    gram = gram[at] if max_order > 1 else codes.copy()
    gram |= np.repeat(texts % rows << max_order * bits, lengths)
    gram <<= 1
    gram[int(lengths[:rows].sum()) :] |= 1
    gram.sort()
    # A text has fewer than 2 ** 31 tokens.
    sums = np.cumsum(1 - 2 * (gram & 1).astype(np.int8), dtype=np.int32)
    gram >>= 1
    both = lengths[:rows] + lengths[rows:]
    for order in range(max_order, 0, -1):
        ends = np.ones(len(gram), dtype=bool)
        np.not_equal(gram[1:], gram[:-1], out=ends[:-1])
        lasts = np.flatnonzero(ends)
        sums, gram = sums[lasts], gram[lasts]
        more = sums.copy()
        np.subtract(sums[1:], sums[:-1], out=more[1:])
        # An n-gram that both sides have equally often adds nothing to the shorter ones either.
        left = np.flatnonzero(more)
        more, gram = more[left], gram[left]
        alone = np.bincount(gram >> order * bits, weights=np.abs(more), minlength=rows)
        out[:, order - 1] = (both - alone.astype(np.int64)) // 2
        if not len(left):
            out[:, : order - 1] = (both // 2)[:, None]
            break
        gram >>= bits
        sums = np.cumsum(more, dtype=np.int32)
    return out


def _matches_by_sort(
    codes: np.ndarray, lengths: np.ndarray, rows: int, bits: int, side_bits: int, max_order: int
) -> np.ndarray:
    """Matches of all orders from one sort of the longest n-grams as numbers: row, tokens, side.

    N-grams of every order are runs of the sorted numbers. Tokens past the end of a text are 0.
    """
    out = np.zeros((rows, max_order), dtype=np.int64)
    if not len(codes):
        return out
    gap = max_order - 1
    texts = np.arange(len(lengths))
    at = np.arange(len(codes)) + np.repeat(texts * gap, lengths)
    apart = np.zeros(len(codes) + len(lengths) * gap + max_order, dtype=np.int64)
    apart[at] = codes
    size = len(apart) - max_order
    gram = apart[:size].copy()
    for k in range(1, max_order):
        gram <<= bits
        gram |= apart[k : k + size]
    gram = gram[at]
    gram <<= side_bits
    gram |= np.repeat((texts % rows << max_order * bits + side_bits) | texts // rows, lengths)
    gram.sort()
    # How many n-grams of each reference come before each place; the others are the hypothesis'.
    side = gram & (1 << side_bits) - 1
    sides = len(lengths) // rows
    before = [np.append(0, np.cumsum(side == k)) for k in range(1, sides)]
    gram >>= side_bits
    starts = np.arange(len(gram))
    for order in range(max_order, 0, -1):
        first = np.append(0, np.flatnonzero(gram[1:] != gram[:-1]) + 1)
        gram, starts = gram.take(first), starts.take(first)
        edges = np.append(starts, len(side))
        allowed = [np.diff(n.take(edges)) for n in before]
        found = np.diff(edges) - sum(allowed)
        matches = np.minimum(found, np.maximum.reduce(allowed) if sides > 2 else allowed[0])
        matches *= (gram & (1 << bits) - 1) != 0
        rises = np.searchsorted(gram, np.arange(rows + 1) << order * bits)
        some = np.flatnonzero(rises[1:] > rises[:-1])
        out[some, order - 1] = np.add.reduceat(matches, rises[some])
        gram >>= bits
    return out


def _matches_by_hash(
    hyp: tuple[np.ndarray, np.ndarray], refs: list[tuple[np.ndarray, np.ndarray]], max_order: int
) -> np.ndarray:
    """:func:`clipped_matches` order by order, for tokens of any number."""
    sides = [hyp, *refs]
    rows = len(hyp[1])
    codes = np.concatenate([c for c, _ in sides])
    lengths = np.concatenate([n for _, n in sides])
    row = np.tile(np.arange(rows), len(sides))
    token_row = np.repeat(row, lengths)
    token_side = np.repeat(np.repeat(np.arange(len(sides)), rows), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    out = np.zeros((rows, max_order), dtype=np.int64)
    width = int(codes.max()) + 1 if len(codes) else 1
    start = np.arange(len(codes))
    gram = token_row
    for order in range(1, max_order + 1):
        keep = room[start] >= order
        start, gram = start[keep], gram[keep]
        if not len(start):
            break
        # An n-gram is its (n-1)-gram prefix, which is already specific to the row, plus one token.
        gram, distinct = pd.factorize(gram * width + codes[start + order - 1])
        side = token_side[start]
        found = np.bincount(gram[side == 0], minlength=len(distinct))
        allowed = np.zeros_like(found)
        for k in range(1, len(sides)):
            np.maximum(allowed, np.bincount(gram[side == k], minlength=len(distinct)), out=allowed)
        matches = np.minimum(found, allowed)
        owner = np.empty(len(distinct), dtype=np.int64)
        owner[gram] = token_row[start]
        out[:, order - 1] = np.bincount(owner, weights=matches, minlength=rows)
        # A longer n-gram can only match where this one does.
        matched = matches[gram] > 0
        start, gram = start[matched], gram[matched]
    return out


def _totals(lengths: np.ndarray, max_order: int) -> np.ndarray:
    return np.maximum(lengths[:, None] - np.arange(max_order)[None, :], 0)


def _structs(columns: dict[str, np.ndarray]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _reference(refs: pa.Array, k: int) -> pa.Array:
    """The k-th reference of every row, null where a row has fewer."""
    offsets = np.concatenate([[0], np.cumsum(_lengths(refs))])
    picked = offsets[:-1] + k
    return refs.flatten().take(pa.array(picked, mask=picked >= offsets[1:]))


BLEU_FIELDS = (
    [f"match_{n}" for n in range(1, BLEU_ORDER + 1)]
    + [f"total_{n}" for n in range(1, BLEU_ORDER + 1)]
    + ["sys_len", "ref_len"]
)


def bleu_batch(hyp: pa.Array, refs: pa.Array) -> pa.StructArray:
    """BLEU statistics of tokenized hypotheses against one or more tokenized references."""
    hyp_lengths, per_row = _lengths(hyp), _lengths(refs)
    references = [_reference(refs, k) for k in range(max(int(per_row.max(initial=1)), 1))]
    ref_lengths = np.stack([_lengths(r) for r in references])
    matches = np.zeros((len(hyp), BLEU_ORDER), dtype=np.int64)
    for part in _slices(hyp_lengths + ref_lengths.sum(axis=0)):
        size = part.stop - part.start
        tokens = [hyp.slice(part.start, size), *(r.slice(part.start, size) for r in references)]
        codes = _codes(*(t.flatten() for t in tokens))
        pairs = [(c, _lengths(t)) for c, t in zip(codes, tokens)]
        matches[part] = clipped_matches(pairs[0], pairs[1:], BLEU_ORDER)
    # The closest reference length counts, the shorter one on ties; absent references are out of reach.
    present = np.arange(len(references))[:, None] < np.maximum(per_row, 1)[None, :]
    distance = np.where(present, np.abs(ref_lengths - hyp_lengths) * 2.0, np.inf)
    distance = distance + (ref_lengths > hyp_lengths)
    closest = np.take_along_axis(ref_lengths, distance.argmin(axis=0)[None, :], axis=0)[0]
    totals = _totals(hyp_lengths, BLEU_ORDER)
    values = [*matches.T, *totals.T, hyp_lengths, closest]
    return _structs(dict(zip(BLEU_FIELDS, values)))


CHRF_FIELDS = [f"{kind}_{n}" for kind in ("match", "hyp", "ref") for n in range(1, CHRF_ORDER + 1)]


def f_score(match: np.ndarray, hyp: np.ndarray, ref: np.ndarray, beta: float = 2.0) -> np.ndarray:
    """chrF of each row from ``(rows, orders)`` counts, used to choose between references."""
    both = (hyp > 0) & (ref > 0)
    orders = np.maximum(both.sum(axis=1), 1)
    precision = np.where(both, match / np.maximum(hyp, 1), 0).sum(axis=1) / orders
    recall = np.where(both, match / np.maximum(ref, 1), 0).sum(axis=1) / orders
    low = beta**2 * precision + recall
    return np.where(low > 0, (1 + beta**2) * precision * recall / np.where(low > 0, low, 1), 0.0)


def chrf_batch(hyp: pa.Array, refs: pa.Array) -> pa.StructArray:
    """Character n-gram statistics; white space must be gone. Each row keeps its best reference."""
    rows = len(hyp)
    best = np.zeros((3, rows, CHRF_ORDER), dtype=np.int64)
    best_score = np.full(rows, -1.0)
    per_row = _lengths(refs)
    hyp_lengths = pc.fill_null(pc.utf8_length(hyp), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for k in range(max(int(per_row.max(initial=1)), 1)):
        reference = _reference(refs, k)
        ref_lengths = pc.fill_null(pc.utf8_length(reference), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for part in _slices(hyp_lengths + ref_lengths):
            size = part.stop - part.start
            hyp_part, ref_part = (_code_points(t.slice(part.start, size)) for t in (hyp, reference))
            match = clipped_matches(hyp_part, [ref_part], CHRF_ORDER)
            ref_total = _totals(ref_part[1], CHRF_ORDER)
            # Hypothesis n-grams of an order that the reference is too short for do not count.
            hyp_total = np.where(ref_total > 0, _totals(hyp_part[1], CHRF_ORDER), 0)
            score = f_score(match, hyp_total, ref_total)
            better = (score > best_score[part]) & (k < np.maximum(per_row[part], 1))
            best_score[part] = np.where(better, score, best_score[part])
            for slot, counts in enumerate((match, hyp_total, ref_total)):
                best[slot, part] = np.where(better[:, None], counts, best[slot, part])
    return _structs(dict(zip(CHRF_FIELDS, [*best[0].T, *best[1].T, *best[2].T])))


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence by bit-parallel rows (Hyyro 2004)."""
    where: dict[int, int] = {}
    for i, token in enumerate(b):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        hits = row & where.get(token, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(b) - row.bit_count()


def word_edits(a: list[int], b: list[int]) -> int:
    """Insertions, deletions and substitutions between two token lists (Myers 1999, Hyyro 2003)."""
    if not b:
        return len(a)
    where: dict[int, int] = {}
    for i, token in enumerate(b):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(b)) - 1
    up, down, last, edits = full, 0, 1 << (len(b) - 1), len(b)
    for token in a:
        equal = where.get(token, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right_up = down | ~(diagonal | up) & full
        right_down = up & diagonal
        if right_up & last:
            edits += 1
        elif right_down & last:
            edits -= 1
        right_up = (right_up << 1 | 1) & full
        right_down = right_down << 1 & full
        up = right_down | ~(diagonal | right_up) & full
        down = right_up & diagonal
    return edits


# Rows whose references take the same number of 64-bit words are measured together if there are this many for each of
# those words; for fewer ones Python's long integers are faster.
ROWS_PER_WORD = 12
# So that more rows meet, long references count as a little longer.
SIZES = np.array([0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32])

Texts = tuple[np.ndarray, np.ndarray]


def _rows(texts: Texts, rows: np.ndarray) -> Iterator[list[int]]:
    codes, lengths = texts
    ends = np.cumsum(lengths)
    for i in rows.tolist():
        yield codes[ends[i] - lengths[i] : ends[i]].tolist()


def word_edits_by_row(hyp: Texts, ref: Texts, long_edits=word_edits) -> np.ndarray:
    """:func:`word_edits` of every row, from (token codes of all rows, tokens per row) of both sides.

    ``long_edits`` is asked for the rows that are too few to be measured together.
    """
    edits = np.maximum(hyp[1], ref[1])
    sizes = np.where(hyp[1] > 0, (ref[1] + 63) // 64, 0)
    sizes = np.where(sizes <= SIZES[-1], SIZES[np.searchsorted(SIZES, sizes).clip(0, len(SIZES) - 1)], sizes)
    for size, count in zip(*np.unique(sizes, return_counts=True)):
        rows = np.flatnonzero(sizes == size)
        if not size:
            continue
        found = _edits_together(hyp, ref, rows, int(size)) if count >= ROWS_PER_WORD * size else None
        if found is None:
            pairs = zip(_rows(hyp, rows), _rows(ref, rows))
            found = np.fromiter((long_edits(h, r) for h, r in pairs), dtype=np.int64, count=len(rows))
        edits[rows] = found
    return edits


def _of_rows(texts: Texts, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of some rows, with the position of their row among those, and their own position in it."""
    codes, lengths = texts
    starts, lengths = (np.cumsum(lengths) - lengths)[rows], lengths[rows]
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return codes[np.repeat(starts, lengths) + inside], np.repeat(np.arange(len(rows)), lengths), inside


def _edits_together(hyp: Texts, ref: Texts, rows: np.ndarray, size: int) -> np.ndarray | None:
    """Word edits of rows whose references fit into ``size`` 64-bit words: block by block (Myers 1999), all rows at once.

    None if a token's row, code and position do not fit into 63 bits.
    """
    back = np.argsort(-hyp[1][rows], kind="stable")
    rows = rows[back]
    steps = hyp[1][rows]
    hyp_codes, hyp_row, hyp_at = _of_rows(hyp, rows)
    ref_codes, ref_row, ref_at = _of_rows(ref, rows)
    codes, different = _dense(np.concatenate([ref_codes, hyp_codes]))
    bits, places = different.bit_length(), int(max(steps[0], 64 * size)).bit_length()
    if (len(rows) - 1).bit_length() + bits + 1 + places > 63:
        return None
    # One sort brings each word of a row together: where the reference has it, then where the hypothesis has it.
    packed = np.concatenate([ref_row, hyp_row]) << bits
    packed |= codes
    packed <<= 1 + places
    packed[len(ref_codes) :] |= 1 << places
    packed |= np.concatenate([ref_at, hyp_at])
    packed.sort()
    at, of_hyp = packed & (1 << places) - 1, (packed >> places & 1).astype(bool)
    word = packed >> 1 + places
    new = np.append(True, word[1:] != word[:-1])
    number = np.cumsum(new) - 1
    masks = np.zeros((size, int(number[-1]) + 1), dtype=np.uint64)
    ref_number, ref_place = number[~of_hyp], at[~of_hyp]
    cell = (ref_place >> 6) + ref_number * size
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    marks = np.uint64(1) << (ref_place & 63).astype(np.uint64)
    masks[cell[first] % size, cell[first] // size] = np.bitwise_or.reduceat(marks, first)
    # Step by step the rows that have a word there: the longest hypotheses come first.
    active = len(rows) - np.searchsorted(steps[::-1], np.arange(steps[0]), side="right")
    offsets = np.append(0, np.cumsum(active))
    words = np.empty(len(hyp_codes), dtype=np.int64)
    words[offsets[at[of_hyp]] + (word[of_hyp] >> bits)] = number[of_hyp]
    one, top = np.uint64(1), np.uint64(63)
    edits, room = steps.copy(), ref[1][rows]
    grown = shrunk = None
    for block in range(size):
        up, down = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), dtype=np.uint64)
        grows = shrinks = None
        if block < size - 1:
            grows, shrinks = np.empty(len(words), dtype=np.uint64), np.empty(len(words), dtype=np.uint64)
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            up_now, down_now = up[: end - begin], down[: end - begin]
            equal = masks[block].take(words[begin:end])
            free = equal | down_now
            if block:
                equal |= shrunk[begin:end]
            diagonal = equal & up_now
            diagonal += up_now
            diagonal ^= up_now
            diagonal |= equal
            increase = diagonal | up_now
            np.invert(increase, out=increase)
            increase |= down_now
            decrease = np.bitwise_and(up_now, diagonal, out=diagonal)
            if grows is not None:
                np.right_shift(increase, top, out=grows[begin:end])
                np.right_shift(decrease, top, out=shrinks[begin:end])
            increase <<= one
            increase |= grown[begin:end] if block else one
            decrease <<= one
            if block:
                decrease |= shrunk[begin:end]
            np.bitwise_or(free, increase, out=up_now)
            np.invert(up_now, out=up_now)
            up_now |= decrease
            np.bitwise_and(increase, free, out=down_now)
        grown, shrunk = grows, shrinks
        # The last block may be longer than its reference.
        left = np.clip(room - 64 * block, 0, 64).astype(np.uint64)
        inside = np.where(left == 64, ~np.uint64(0), (one << (left & top)) - one)
        edits += np.bitwise_count(up & inside).astype(np.int64) - np.bitwise_count(down & inside)
    out = np.empty(len(rows), dtype=np.int64)
    out[back] = edits
    return out


def _token_rows(*lists: pa.Array) -> Iterator[tuple[list[int], ...]]:
    codes = _codes(*(t.flatten() for t in lists))
    ends = [np.cumsum(_lengths(t)) for t in lists]
    for i in range(len(lists[0])):
        yield tuple(c[e[i - 1] if i else 0 : e[i]].tolist() for c, e in zip(codes, ends))


ROUGE_FIELDS = ["match_1", "match_2", "hyp_1", "hyp_2", "ref_1", "ref_2", "lcs"]


def rouge_batch(hyp: pa.Array, ref: pa.Array) -> pa.StructArray:
    """Unigram and bigram overlap and the longest common subsequence."""
    hyp_lengths, ref_lengths = _lengths(hyp), _lengths(ref)
    matches = np.zeros((len(hyp), 2), dtype=np.int64)
    for part in _slices(hyp_lengths + ref_lengths):
        size = part.stop - part.start
        hyp_part, ref_part = hyp.slice(part.start, size), ref.slice(part.start, size)
        hyp_codes, ref_codes = _codes(hyp_part.flatten(), ref_part.flatten())
        matches[part] = clipped_matches((hyp_codes, hyp_lengths[part]), [(ref_codes, ref_lengths[part])], 2)
    lcs = np.fromiter((lcs_length(h, r) for h, r in _token_rows(hyp, ref)), dtype=np.int64, count=len(hyp))
    totals = [*_totals(hyp_lengths, 2).T, *_totals(ref_lengths, 2).T]
    return _structs(dict(zip(ROUGE_FIELDS, [*matches.T, *totals, lcs])))


def _edit_statistics(hyp: pa.Array, refs: pa.Array, edits_of) -> pa.StructArray:
    """Fewest edits over the references, and the mean reference length, of every row.

    ``edits_of`` takes the token codes and lengths of both sides and gives the edits of all rows.
    """
    per_row = _lengths(refs)
    edits = np.full(len(hyp), np.iinfo(np.int64).max)
    ref_words = np.zeros(len(hyp), dtype=np.float64)
    hyp_lengths = _lengths(hyp)
    for k in range(max(int(per_row.max(initial=1)), 1)):
        reference = _reference(refs, k)
        ref_lengths = _lengths(reference)
        hyp_codes, ref_codes = _codes(hyp.flatten(), reference.flatten())
        found = edits_of((hyp_codes, hyp_lengths), (ref_codes, ref_lengths))
        present = k < np.maximum(per_row, 1)
        edits = np.where(present, np.minimum(edits, found), edits)
        ref_words += np.where(present, ref_lengths, 0)
    return _structs({"edits": edits, "ref_words": ref_words / np.maximum(per_row, 1)})


def _struct_type(fields: list[str]) -> str:
    return "struct<" + ",".join(f"{name}:bigint" for name in fields) + ">"


def bleu_statistics(hyp_tokens: Column, refs_tokens: Column) -> Column:
    @F.arrow_udf(_struct_type(BLEU_FIELDS))
    def bleu(hyp: pa.Array, refs: pa.Array) -> pa.Array:
        return bleu_batch(hyp, refs)

    return bleu(hyp_tokens, refs_tokens)


def bleu_text_statistics(hyp: Column, refs: Column, ruled) -> Column:
    """:func:`bleu_statistics` of 13a words; ``ruled`` gives those of texts that need the rules in order."""

    @F.arrow_udf(_struct_type(BLEU_FIELDS))
    def bleu(hyp: pa.Array, refs: pa.Array, hyp_given: pa.Array, refs_given: pa.Array) -> pa.Array:
        return bleu_batch(ordered_words(hyp, hyp_given), for_each_reference(refs, ordered_words, refs_given))

    def given(text: Column) -> Column:
        return F.when(needs_order(text), ruled(text))

    return bleu(F.make_valid_utf8(hyp), F.transform(refs, F.make_valid_utf8), given(hyp), F.transform(refs, given))


def chrf_statistics(hyp: Column, refs: Column) -> Column:
    """Of texts with white space, which does not count."""

    @F.arrow_udf(_struct_type(CHRF_FIELDS))
    def chrf(hyp: pa.Array, refs: pa.Array) -> pa.Array:
        return chrf_batch(squeezed(hyp), for_each_reference(refs, squeezed))

    return chrf(F.make_valid_utf8(hyp), F.transform(refs, F.make_valid_utf8))


def rouge_statistics(hyp_tokens: Column, ref_tokens: Column) -> Column:
    @F.arrow_udf(_struct_type(ROUGE_FIELDS))
    def rouge(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        return rouge_batch(hyp, ref)

    return rouge(hyp_tokens, ref_tokens)


def _edits_of_texts(hyp: Column, refs: Column, edits_of) -> Column:
    @F.arrow_udf("struct<edits:bigint,ref_words:double>")
    def edit(hyp: pa.Array, refs: pa.Array) -> pa.Array:
        return _edit_statistics(words(hyp), for_each_reference(refs, words), edits_of)

    return edit(F.make_valid_utf8(hyp), F.transform(refs, F.make_valid_utf8))


def word_edit_statistics(hyp: Column, refs: Column) -> Column:
    from bitextry.functions.shifts import plain_edits

    return _edits_of_texts(hyp, refs, plain_edits)


def ter_statistics(hyp: Column, refs: Column, limits=None) -> Column:
    from bitextry.functions.shifts import ShiftLimits, translation_edits_by_row

    limits = limits or ShiftLimits()
    return _edits_of_texts(hyp, refs, lambda h, r: translation_edits_by_row(h, r, limits))
