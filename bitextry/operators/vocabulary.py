"""Token counts, vocabularies, and the comparison of reference and hypothesis vocabularies."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextry.operators.numbering import with_ordinal
from bitextry.session import checkpointed
from bitextry.worker import once

# Ids of the special tokens, then the first id of an ordinary one.
PAD_ID, END_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2, 3
SPECIAL_IDS = (PAD_ID, END_ID, UNKNOWN_ID)
# Of a vocabulary that takes more, the first ids are broadcast and the others are joined.
BROADCAST_BYTES = 64 * 1024 * 1024
# Elements of neighbouring rows that are looked up together, each different one once.
BLOCK_ELEMENTS = 1 << 22
# Copies of a vocabulary that does not fit a broadcast, so that frequent tokens spread over tasks.
LOOKUP_SALTS = 16


def side_tokens(df: DataFrame, ref_tokens: Column, hyp_tokens: Column, by: Sequence[str] = ()) -> DataFrame:
    """``by..., side, token``: every token of both sides, from one pass over the input."""
    tagged = F.array(
        F.struct(F.lit("ref").alias("side"), ref_tokens.alias("tokens")),
        F.struct(F.lit("hyp").alias("side"), hyp_tokens.alias("tokens")),
    )
    sides = df.select(*by, F.explode(tagged).alias("s"))
    return sides.select(*by, "s.side", F.explode("s.tokens").alias("token"))


def token_counts(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., side, token, n``. Partial counts absorb frequent tokens before the shuffle."""
    return tokens.groupBy(*by, "side", "token").agg(F.count(F.lit(1)).alias("n"))


def type_table(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., token, ref_n, hyp_n``: one row per distinct token; 0 where a side lacks it."""

    def total(side: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))

    return counts.groupBy(*by, "token").agg(total("ref").alias("ref_n"), total("hyp").alias("hyp_n"))


def pair_types(df: DataFrame, ref_tokens: Column, hyp_tokens: Column, by: Sequence[str] = ()) -> DataFrame:
    """The type table straight from tokenized pairs, with a single shuffle."""
    tokens = side_tokens(df, ref_tokens, hyp_tokens, by)
    one = {side: F.sum(F.when(F.col("side") == side, 1).otherwise(0)) for side in ("ref", "hyp")}
    return tokens.groupBy(*by, "token").agg(one["ref"].alias("ref_n"), one["hyp"].alias("hyp_n"))


def overlap_report(types: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct tokens of each side, of both and of one only, with their shares (null on an empty side)."""
    ref, hyp = F.col("ref_n") > 0, F.col("hyp_n") > 0
    counted = types.groupBy(*by).agg(
        F.count_if(ref).alias("ref_types"),
        F.count_if(hyp).alias("hyp_types"),
        F.count_if(ref & hyp).alias("both_types"),
        F.count_if(ref & ~hyp).alias("ref_only_types"),
        F.count_if(hyp & ~ref).alias("hyp_only_types"),
    )
    return counted.withColumns(
        {
            "both_share": F.try_divide("both_types", "ref_types"),
            "ref_only_share": F.try_divide("ref_only_types", "ref_types"),
            "hyp_only_share": F.try_divide("hyp_only_types", "hyp_types"),
        }
    )


def top_tokens(types: DataFrame, k: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """``by..., side, rank, token, n``: the ``k`` most frequent tokens per side, token order on ties.

    The rank filter reaches the map side (a window group limit), so each task sends at most ``k`` rows.
    """
    sides = types.select(
        *by,
        "token",
        F.explode(
            F.array(
                F.struct(F.lit("ref").alias("side"), F.col("ref_n").alias("n")),
                F.struct(F.lit("hyp").alias("side"), F.col("hyp_n").alias("n")),
            )
        ).alias("s"),
    ).select(*by, "s.side", "token", "s.n")
    order = Window.partitionBy(*by, "side").orderBy(F.col("n").desc(), "token")
    ranked = sides.filter(F.col("n") > 0).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def exclusive_types(types: DataFrame) -> DataFrame:
    """The types that only one side has, with the column ``side``."""
    one_sided = types.filter((F.col("ref_n") == 0) | (F.col("hyp_n") == 0))
    return one_sided.withColumn("side", F.when(F.col("hyp_n") == 0, "ref").otherwise("hyp"))


def exclusive_examples(types: DataFrame, k: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Up to ``k`` types per side that the other side lacks, in token order."""
    order = Window.partitionBy(*by, "side").orderBy("token")
    ranked = exclusive_types(types).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select(*by, "side", "rank", "token")


def shared_types(ref_types: DataFrame, hyp_types: DataFrame) -> DataFrame:
    """Types of both sides, as a semi-join of two one-column tables of distinct tokens."""
    return ref_types.join(hyp_types, "token", "left_semi")


def types_only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Types of the left side that the right side lacks, as an anti-join."""
    return left.join(right, "token", "left_anti")


def build_vocabulary(tokens: DataFrame, max_size: int | None = None) -> DataFrame:
    """``token, id`` by falling frequency, token order on ties; ids follow the special tokens."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("token")]
    if max_size is None:
        return with_ordinal(counts, order, "id", FIRST_ID).select("token", F.col("id").cast("int"))
    # At most max_size rows are left, whatever the corpus.
    top = counts.orderBy(*order).limit(max_size)
    rank = F.row_number().over(Window.orderBy(*order))
    return top.select("token", (rank + FIRST_ID - 1).cast("int").alias("id"))


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary ready for lookups: on every executor when it is small, else as a table to join.

    ``tokens`` are the first ids on every executor; all of them if the vocabulary is ``whole``.
    """

    frame: DataFrame
    tokens: Broadcast | None
    key: str = ""
    whole: bool = True

    @property
    def known(self) -> int:
        """The first id that is not on every executor."""
        return FIRST_ID + (0 if self.tokens is None else len(self.tokens.value))


class TokenIndex:
    """Places of tokens by hash, 16 bytes each. Built once per worker, so that a batch pays for its own tokens only."""

    def __init__(self, tokens: pa.Array) -> None:
        self.tokens = tokens
        hashes = self._hashes(tokens)
        self.places = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.places]
        # Different tokens with one hash are looked up by name.
        twins = np.flatnonzero(self.hashes[1:] == self.hashes[:-1])
        shared = self.places[np.union1d(twins, twins + 1)] if len(twins) else twins
        self.named = {tokens[i].as_py(): i for i in shared.tolist()}

    def _hashes(self, tokens: pa.Array) -> np.ndarray:
        return np.fromiter(map(hash, tokens.to_numpy(zero_copy_only=False)), np.int64, len(tokens))

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word among the tokens, -1 for an unknown one."""
        if not len(self.tokens) or not len(words):
            return np.full(len(words), -1)
        hashes = self._hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == hashes, self.places[at], -1)
        same = pc.equal(self.tokens.take(pa.array(np.maximum(found, 0))), words)
        found[~same.to_numpy(zero_copy_only=False)] = -1
        if self.named:
            for i, word in enumerate(words.to_pylist()):
                found[i] = self.named.get(word, found[i])
        return found

    def ids(self, words: pa.Array) -> pa.Array:
        """The id of each of many words, nulls and repeats among them."""
        different = words.dictionary_encode()
        places = self.find(different.dictionary)
        ids = np.append(np.where(places < 0, UNKNOWN_ID, places + FIRST_ID), UNKNOWN_ID).astype(np.int32)
        return pa.array(ids).take(pc.fill_null(different.indices, len(ids) - 1))


def prepare(vocabulary: DataFrame | Vocabulary, limit: int = BROADCAST_BYTES) -> Vocabulary:
    """Compute a ``token, id`` vocabulary once; broadcast what fits into ``limit`` bytes, smallest ids first.

    Those are the frequent tokens of a vocabulary from :func:`build_vocabulary`. Ids must run from the first ordinary id
    without gaps to be looked up by position.
    """
    if isinstance(vocabulary, Vocabulary):
        return vocabulary
    frame = checkpointed(vocabulary.select("token", "id"))

    def measured(part: DataFrame) -> tuple[int, int]:
        # A token takes its bytes, an offset and an id.
        return part.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("token") + 8), F.lit(0))).first()

    first, (rows, size) = frame, measured(frame)
    whole = size <= limit
    while size > limit:
        rows = rows * limit // size
        first = frame.filter(F.col("id") < FIRST_ID + rows)
        rows, size = measured(first)
    if not whole and not rows:
        return Vocabulary(frame, None, whole=False)
    table = first.toArrow().sort_by("id")
    ids = table.column("id").to_numpy()
    if not (ids == np.arange(FIRST_ID, FIRST_ID + len(ids))).all():
        return Vocabulary(frame, None, whole=False)
    tokens = table.column("token").combine_chunks().cast(pa.string())
    return Vocabulary(frame, vocabulary.sparkSession.sparkContext.broadcast(tokens), uuid.uuid4().hex, whole)


def encode(
    df: DataFrame, tokens: str, vocabulary: DataFrame | Vocabulary, keys: Sequence[str], ids: str = "ids"
) -> DataFrame:
    """Replace a token array by ids; unknown tokens get the unknown id.

    A small vocabulary is looked up in place, without a shuffle. Of a large one, the tokens that are not broadcast are
    joined, each once per block of rows. If nothing is broadcast, ``keys`` must identify a row.
    """
    vocabulary = prepare(vocabulary)
    if not vocabulary.whole:
        return _encode_in_blocks(df, tokens, vocabulary, keys, ids)
    known, key = vocabulary.tokens, vocabulary.key

    @F.arrow_udf("array<int>")
    def look_up(rows: pa.Array) -> pa.Array:
        index = once("vocabulary", key, lambda: TokenIndex(known.value))
        return _nested(rows, index.ids(rows.flatten().cast(pa.string())))

    return df.withColumn(ids, look_up(tokens)).drop(*({tokens} - {ids}))


def _nested(rows: pa.Array, values: pa.Array) -> pa.Array:
    """Flat values in the list shape of ``rows``."""
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(rows), 0))
    offsets = pa.concat_arrays([pa.array([0], ends.type), ends]).cast(pa.int32())
    return pa.ListArray.from_arrays(offsets, values)


def packed(numbers: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Lists of small whole numbers as bytes, seven bits in each, the low ones first."""
    sizes = 1 + sum((numbers >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    ends = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        more = sizes > k
        out[(ends - sizes)[more] + k] = (numbers[more] >> 7 * k) & 127 | (sizes[more] > k + 1) * 128
    offsets = np.append(0, ends)[np.append(0, np.cumsum(lengths))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of :func:`packed` lists, and where each list begins and the last one ends."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    _, offsets, data = rows.buffers()
    at = np.frombuffer(offsets, np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    last = held < 128
    edges = np.append(0, np.cumsum(last))
    begins = np.append(0, np.flatnonzero(last) + 1)[:-1]
    if not len(begins):
        return np.zeros(0, np.int64), edges[at - at[0]]
    shift = 7 * (np.arange(len(held)) - np.repeat(begins, np.diff(np.append(begins, len(held)))))
    return np.add.reduceat((held & 127).astype(np.int64) << shift, begins), edges[at - at[0]]


def _in_blocks(
    df: DataFrame, column: str, kind: T.DataType, numbered: Callable[[pa.Array], tuple[np.ndarray, pa.Array]]
) -> DataFrame:
    """The rows with ``_block``, ``_codes`` in place of ``column``, and ``_values`` in the first row of a block.

    ``numbered`` turns elements into codes: an id that is known on the spot, or the first number that is none plus ``k`` for
    the ``k``-th of the values that it returns, each of which is different. The table is written, so that blocks stay what
    they are; frequent elements have small codes, which take a byte or two.
    """
    kept = [c for c in df.columns if c != column]
    schema = (
        T.StructType([df.schema[c] for c in kept])
        .add("_block", T.LongType())
        .add("_codes", T.BinaryType())
        .add("_values", T.ArrayType(kind))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks, held, elements = TaskContext.get().partitionId(), 0, [], 0

        def block() -> Iterator[pa.RecordBatch]:
            lists = [batch.column(column) for batch in held]
            codes, values = numbered(pa.concat_arrays([each.flatten() for each in lists]))
            begin = 0
            for batch, each in zip(held, lists):
                lengths = pc.fill_null(pc.list_value_length(each), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                end = begin + int(lengths.sum())
                carried = pa.nulls(len(batch), pa.list_(values.type))
                if batch is held[0]:
                    carried = pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), carried[1:]])
                number = pa.array(np.full(len(batch), (task << 32) + blocks))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), number, packed(codes[begin:end], lengths), carried],
                    [*kept, "_block", "_codes", "_values"],
                )
                begin = end

        for batch in batches:
            if len(batch):
                held.append(batch)
                elements += len(batch.column(column).flatten())
            if elements >= BLOCK_ELEMENTS:
                yield from block()
                blocks, held, elements = blocks + 1, [], 0
        if held:
            yield from block()

    # The codes are bytes already, so only an entropy coder makes them smaller.
    return checkpointed(df.select(*kept, column).mapInArrow(cut, schema), "zstd")


def _filled(
    df: DataFrame,
    blocks: DataFrame,
    vocabulary: Vocabulary,
    on: str,
    column: str,
    name: str,
    kind: T.DataType,
    value: Callable[[np.ndarray, pa.Table], pa.Array],
) -> DataFrame:
    """Look the values of all blocks up by a join on ``on``, and take them back to the rows of their block.

    ``value`` gives the elements for codes and the block's ``_code, _value`` rows. A block has a value once, so a frequent
    one comes at most once per block.
    """
    rest = vocabulary.frame
    if vocabulary.tokens is not None:
        rest = rest.filter(F.col("id") >= vocabulary.known)
    asked = blocks.filter(F.col("_values").isNotNull()).select("_block", F.posexplode("_values").alias("_code", on))
    other = "token" if on == "id" else "id"
    found = asked.join(rest, on).select(F.col("_block").alias("_of"), "_code", F.col(other).alias("_value"))
    rows = blocks.drop("_values")
    # The same columns in the same order as a lookup in place gives.
    order = [c for c in df.columns if c != column or column == name]
    order += [] if name in order else [name]
    known = {f.name: f for f in blocks.schema}
    schema = T.StructType([T.StructField(c, T.ArrayType(kind)) if c == name else known[c] for c in order])

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, offsets = unpacked(left.column("_codes").combine_chunks())
        made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), value(codes, right))
        return pa.table({c: made if c == name else left.column(c) for c in order})

    return rows.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(fill, schema)


def _encode_in_blocks(df: DataFrame, tokens: str, vocabulary: Vocabulary, keys: Sequence[str], ids: str) -> DataFrame:
    first, key, known = vocabulary.tokens, vocabulary.key, vocabulary.known

    def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        different = words.cast(pa.string()).dictionary_encode()
        values = different.dictionary
        codes = np.full(len(values), -1)
        if first is not None:
            codes = once("vocabulary", key, lambda: TokenIndex(first.value)).find(values)
        absent = codes < 0
        codes = np.append(np.where(absent, known - 1 + np.cumsum(absent), codes + FIRST_ID), UNKNOWN_ID)
        places = pc.fill_null(different.indices, len(values)).to_numpy(zero_copy_only=False)
        return codes[places], values.filter(pa.array(absent))

    def value(codes: np.ndarray, found: pa.Table) -> pa.Array:
        rest = np.full(max(int(codes.max(initial=0)) - known + 1, 1), UNKNOWN_ID)
        rest[found.column("_code").to_numpy()] = found.column("_value").to_numpy()
        return pa.array(np.where(codes < known, codes, rest[np.maximum(codes - known, 0)]).astype(np.int32))

    blocks = _in_blocks(df, tokens, T.StringType(), numbered)
    if first is None and _repeated(blocks, keys):
        return _encode_by_join(df, tokens, vocabulary.frame, keys, ids)
    made = _filled(df, blocks, vocabulary, "token", tokens, ids, T.IntegerType(), value)
    return made if first is not None else _without_null_keys(made, keys, ids)


def _decode_in_blocks(df: DataFrame, ids: str, vocabulary: Vocabulary, keys: Sequence[str], text: str) -> DataFrame:
    first, known = vocabulary.tokens, vocabulary.known

    def numbered(numbers: pa.Array) -> tuple[np.ndarray, pa.Array]:
        values, places = np.unique(numbers.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
        absent = (values < FIRST_ID) | (values >= known)
        codes = np.where(absent, known - 1 + np.cumsum(absent), values)
        return codes[places], pa.array(values[absent])

    def value(codes: np.ndarray, found: pa.Table) -> pa.Array:
        different, places = np.unique(codes, return_inverse=True)
        inside, looked = np.split(different, [np.searchsorted(different, known)])
        rest = np.full(max(int(codes.max(initial=0)) - known + 1, 1), -1)
        rest[found.column("_code").to_numpy()] = np.arange(len(found))
        at = rest[looked - known]
        words = [found.column("_value").combine_chunks().cast(pa.string()).take(pa.array(at, mask=at < 0))]
        if len(inside):
            words.insert(0, first.value.take(pa.array(inside - FIRST_ID)))
        return pa.concat_arrays(words).take(pa.array(places))

    blocks = _in_blocks(df, ids, T.LongType(), numbered)
    if first is None and _repeated(blocks, keys):
        return _decode_by_join(df, ids, vocabulary.frame, keys, text)
    made = _filled(df, blocks, vocabulary, "id", ids, text, T.StringType(), value)
    return made if first is not None else _without_null_keys(made, keys, text)


def _repeated(rows: DataFrame, keys: Sequence[str]) -> bool:
    """Whether any two rows have the same keys, none of them null."""
    groups = rows.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not groups.filter(F.col("_n") > 1).isEmpty()


def _without_null_keys(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """No elements where a key is null, as a join by keys finds none there."""
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    return rows.withColumn(name, F.when(known, F.col(name)).otherwise(F.array().cast(rows.schema[name].dataType)))


def _joined(elements: DataFrame, vocabulary: DataFrame, on: str) -> DataFrame:
    """Left join of exploded elements with the vocabulary, salted against frequent elements."""
    salt = F.pmod(F.xxhash64(*(c for c in elements.columns)), F.lit(LOOKUP_SALTS)).cast("int")
    copies = vocabulary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_SALTS - 1))))
    return elements.withColumn("_salt", salt).join(copies, [on, "_salt"], "left").drop("_salt")


def _gathered(df: DataFrame, elements: DataFrame, value: Column, keys: Sequence[str], drop: str, name: str) -> DataFrame:
    """Exploded elements back to one ordered array per row; rows without elements get an empty array."""
    in_order = F.array_sort(F.collect_list(F.struct("_i", value.alias("_v"))))
    arrays = elements.groupBy(*keys).agg(F.transform(in_order, lambda x: x["_v"]).alias(name))
    kind = arrays.schema[name].dataType
    joined = df.drop(drop).join(arrays, list(keys), "left")
    # The same columns in the same order as a lookup in place gives.
    order = [c for c in df.columns if c != drop or drop == name]
    order += [] if name in order else [name]
    return joined.withColumn(name, F.coalesce(name, F.array().cast(kind))).select(*order)


def _encode_by_join(df: DataFrame, tokens: str, vocabulary: DataFrame, keys: Sequence[str], ids: str) -> DataFrame:
    exploded = df.select(*keys, F.posexplode(tokens).alias("_i", "token"))
    coded = _joined(exploded, vocabulary, "token")
    return _gathered(df, coded, F.coalesce("id", F.lit(UNKNOWN_ID)), keys, tokens, ids)


def decode(
    df: DataFrame, ids: str, vocabulary: DataFrame | Vocabulary, keys: Sequence[str], text: str = "text"
) -> DataFrame:
    """Replace an id array by its text: special ids are skipped, tokens are joined by spaces.

    Ids that are neither special nor in the vocabulary are skipped too. Large vocabularies are joined
    as in :func:`encode`.
    """
    vocabulary = prepare(vocabulary)
    wanted = df.withColumn(ids, F.filter(ids, lambda x: ~x.isin(*SPECIAL_IDS)))
    if not vocabulary.whole:
        words = _decode_in_blocks(wanted, ids, vocabulary, keys, text)
        return words.withColumn(text, F.array_join(text, " "))
    known = vocabulary.tokens

    @F.arrow_udf("array<string>")
    def look_up(rows: pa.Array) -> pa.Array:
        at = pc.subtract(rows.flatten().cast(pa.int64()), FIRST_ID)
        inside = pc.and_(pc.greater_equal(at, 0), pc.less(at, len(known.value)))
        return _nested(rows, known.value.take(pc.if_else(inside, at, None)))

    # array_join leaves nulls out.
    return wanted.withColumn(text, F.array_join(look_up(ids), " ")).drop(*({ids} - {text}))


def _decode_by_join(df: DataFrame, ids: str, vocabulary: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    exploded = df.select(*keys, F.posexplode(ids).alias("_i", "id"))
    found = _joined(exploded, vocabulary, "id").filter(F.col("token").isNotNull())
    return _gathered(df, found, F.col("token"), keys, ids, text)
