"""N-gram Jaccard self join with MinHash banding and exact verification.

Each of the ``trees`` is a band: documents that share a prefix of its MinHash values are candidates. The prefix has a
fixed length, the longest at which pairs at the threshold meet with the target probability; no tries are built. Sketches connect the candidates within a trie node, and every pair of a
connected group is then compared on its exact shingle sets.

Nothing here makes a row per pair. Equal texts are one node with a count; trie nodes and groups return one
row per member; large ones are cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextry.llm.common import by_group, frozen, given_back, short_batches, whole_groups, without
from bitextry.llm.components import components
from bitextry.llm.shingles import WordNumbers, minhash, multipliers, shingle_set
from bitextry.session import checkpointed


@dataclass(frozen=True)
class ForestSpec:
    """``shingle`` words; similarity of ``numerator / denominator`` or more; shape of the forest.

    A pair at the threshold becomes a candidate with probability ``recall`` or more. ``slack`` is how far below the
    threshold a pair of sketches may be and still connect: with 128 values, about five standard deviations.
    ``node_block`` sketches, and ``words_block`` words or ``text_block`` texts, are held by a task at once.
    """

    shingle: int = 5
    numerator: int = 4
    denominator: int = 5
    trees: int = 16
    depth: int = 8
    recall: float = 0.999
    slack: float = 0.2
    node_block: int = 8192
    text_block: int = 256
    words_block: int = 1_000_000
    seed: int = 7

    @property
    def threshold(self) -> float:
        return self.numerator / self.denominator

    def prefix(self) -> int:
        """The longest prefix at which pairs at the threshold meet often enough in some tree."""
        for length in range(self.depth, 1, -1):
            if 1 - (1 - self.threshold**length) ** self.trees >= self.recall:
                return length
        return 1


def sketched(docs: DataFrame, spec: ForestSpec) -> DataFrame:
    """Frozen ``docs`` with ``_row``, a 128-bit text hash ``_a, _b``, ``_words``, ``_sketch`` and one key per tree."""
    prefix = spec.prefix()
    short_batches(docs.sparkSession)
    docs = without(docs, "_row", "_a", "_b", "_s", "_words", "_sketch", "_keys")

    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        numbers = WordNumbers()
        factors = multipliers(spec.trees * spec.depth, spec.seed)
        for texts in batches:
            rows = []
            for text in texts:
                found = shingle_set(text, spec.shingle, numbers)
                if not len(found):
                    rows.append((0, None, None))
                    continue
                values = minhash(found, factors)
                tries = values.reshape(spec.trees, spec.depth)[:, :prefix].astype(np.int64)
                keys = np.zeros(spec.trees, np.int64)
                for i in range(prefix):
                    keys = keys * np.int64(65_536) + tries[:, i]
                rows.append((len(found), values.tobytes(), keys))
            yield pd.DataFrame(rows, columns=["_words", "_sketch", "_keys"])

    @F.pandas_udf("_words int, _sketch binary, _keys array<bigint>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from given_back(sketches(batches))

    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn("_a", F.xxhash64(text)).withColumn("_b", F.xxhash64(F.lit("b"), text))
    return frozen(marked.withColumn("_s", sketch(text)).select("*", "_s.*").drop("_s"))


def blocks(members: DataFrame, node: Column, count: Column) -> DataFrame:
    """One row per member and pair of blocks ``_i <= _j`` that it is part of; ``count`` blocks of even size."""
    mine = F.pmod(F.xxhash64(node), count).cast("int")
    return (
        members.withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
        .withColumn("_i", F.least("_mine", "_other"))
        .withColumn("_j", F.greatest("_mine", "_other"))
    )


def connected_candidates(nodes: DataFrame, spec: ForestSpec) -> DataFrame:
    """Edges ``u, v`` that connect all candidates whose sketches are near, within each trie node."""
    entries = nodes.select("node", F.posexplode("keys").alias("tree", "key"))
    shared = entries.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    count = F.ceil(F.col("members") / spec.node_block)
    members = blocks(entries.join(shared, ["tree", "key"]), F.col("node"), count)
    with_sketch = members.select("tree", "key", "_i", "_j", "node").join(nodes.select("node", "sketch"), "node")
    near = int(np.floor((spec.threshold - spec.slack) * spec.trees * spec.depth))

    keys = ["tree", "key", "_i", "_j"]

    def connect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_groups(batches, keys):
            ids = frame["node"].to_numpy()
            values = np.frombuffer(b"".join(frame["sketch"]), "<u2").reshape(len(ids), -1)
            edges = [
                edge
                for low, high in zip(bounds[:-1], bounds[1:], strict=True)
                for edge in near_roots(ids[low:high], values[low:high], near)
            ]
            yield pd.DataFrame(edges, columns=["u", "v"])

    return by_group(with_sketch, keys).mapInPandas(connect, "u bigint, v bigint")


def near_roots(ids: np.ndarray, values: np.ndarray, near: int) -> Iterator[tuple[int, int]]:
    """Edges that connect all rows of ``values`` with ``near`` equal entries, directly or by way of others.

    From each root outward: a row near a reached one joins, and need not be compared with the rest.
    """
    left = np.arange(len(ids))
    while len(left) > 1:
        root, reached, left = left[0], [left[0]], left[1:]
        while reached and len(left):
            equal = (values[left] == values[reached.pop()]).sum(axis=1) >= near
            found, left = left[equal], left[~equal]
            reached.extend(found)
            for x in found:
                yield ids[x], ids[root]


def verified(texts: DataFrame, spec: ForestSpec) -> DataFrame:
    """``node, root, links, copies``: exact links of the members of each group, counted in each pair of blocks.

    ``texts`` has node, copies, root (its group), words and text. ``links`` counts the different texts that are
    similar, ``copies`` the documents that have them; ``root`` is a node that it is connected to.
    """
    sizes = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("all"))
    count = F.greatest(F.ceil(F.col("n") / spec.text_block), F.ceil(F.col("all") / spec.words_block))
    members = blocks(texts.join(sizes, "root"), F.col("node"), count).drop("n", "all", "words", "_other")

    keys = ["group", "_i", "_j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = WordNumbers()
        for frame, bounds in whole_groups(batches, keys):
            ids, copies, block, texts = (frame[c].to_numpy() for c in ("node", "copies", "_mine", "text"))
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                at = slice(low, high)
                sets = [shingle_set(t, spec.shingle, numbers) for t in texts[at]]
                crossing = frame["_i"].iloc[low] != frame["_j"].iloc[low]
                yield links(ids[at], copies[at], block[at], sets, crossing, spec.numerator, spec.denominator)

    placed = members.withColumnRenamed("root", "group").select(*keys, "_mine", "node", "copies", "text")
    found = by_group(placed, keys).mapInPandas(lambda batches: given_back(compare(batches)), "node bigint, root bigint, links bigint, copies bigint")
    return checkpointed(found)


def links(
    ids: np.ndarray,
    copies: np.ndarray,
    block: np.ndarray,
    sets: list[np.ndarray],
    crossing: bool,
    numerator: int,
    denominator: int,
) -> pd.DataFrame:
    """For each document its links in this pair of blocks and the root of those it is connected to.

    ``crossing`` pairs are of two blocks, one of which may be empty; links inside a block are not theirs.
    """
    n = len(ids)
    if n < 2 or crossing and block.min() == block.max():
        return pd.DataFrame(columns=["node", "root", "links", "copies"])
    lengths = np.array([len(s) for s in sets])
    owners = np.repeat(np.arange(n), lengths)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles that one document has alone are in no intersection.
    shared = seen[column] > 1
    owners, column = owners[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owners, column = owners[order], column[order]
    common = np.zeros((n, n), np.float32)
    edges = np.flatnonzero(np.diff(column, prepend=-1, append=-1))
    step = 2048  # shingles at a time
    for first in range(0, len(edges) - 1, step):
        low, high = edges[first], edges[min(first + step, len(edges) - 1)]
        _, local = np.unique(column[low:high], return_inverse=True)
        held = np.zeros((n, local.max() + 1), np.float32)
        held[owners[low:high], local] = 1
        common += held @ held.T
    common = common.astype(np.int64)
    joint = lengths[:, None] + lengths[None, :] - common
    similar = (common > 0) & (denominator * common >= numerator * joint)
    np.fill_diagonal(similar, False)
    if crossing:
        similar &= block[:, None] != block[None, :]
    root = np.arange(n)
    left = np.arange(n)
    while len(left):
        start, reached, left = left[0], [left[0]], left[1:]
        while reached and len(left):
            near = similar[reached.pop(), left]
            found, left = left[near], left[~near]
            root[found] = start
            reached.extend(found)
    out = pd.DataFrame(
        {"node": ids, "root": ids[root], "links": similar.sum(axis=1), "copies": similar.astype(np.int64) @ copies}
    )
    return out[out["links"] > 0]


def similar_documents(docs: DataFrame, spec: ForestSpec = ForestSpec()) -> tuple[DataFrame, DataFrame]:
    """The frozen rows of ``docs`` (doc_id, text), and ``_row, rep_id, class_id, n_texts, n_links, kept`` for each of them.

    Two documents are linked when their texts are equal or the Jaccard similarity of their word shingles is at least
    the threshold; a class is a connected group of links. ``rep_id`` is the smallest doc_id with the same text,
    ``class_id`` the smallest one in the class, ``n_texts`` the number of other texts that the text is linked to,
    ``n_links`` the number of other rows, copies included. ``kept`` marks one row of each class, that with the
    smallest doc_id, then the first one.

    Null text counts as empty. Texts without words are linked to their copies only. Rows without doc_id take
    part; they sort last, and a class of such rows has null as its id. Repeated rows are copies.
    """
    rows = sketched(docs, spec)
    slim = rows.select("_row", "doc_id", "_a", "_b")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    texts = checkpointed(
        slim.groupBy("_a", "_b").agg(
            F.min_by("_row", order).alias("node"), F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("same")
        )
    )
    nodes = texts.select("node", "same").join(
        rows.filter("_words > 0").select(
            F.col("_row").alias("node"),
            F.col("_sketch").alias("sketch"),
            F.col("_keys").alias("keys"),
            F.col("_words").alias("words"),
        ),
        "node",
    )
    groups = components(connected_candidates(nodes, spec))
    grouped = checkpointed(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()))
    candidates = grouped.join(
        rows.select(
            F.col("_row").alias("node"), F.coalesce("text", F.lit("")).alias("text"), F.col("_words").alias("words")
        ),
        "node",
    ).join(texts.select("node", F.col("same").alias("copies")), "node")
    found = verified(candidates, spec)
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))
    named = (
        texts.join(classes, "node", "left")
        .join(counts, "node", "left")
        .select(
            "_a",
            "_b",
            "node",
            "rep_id",
            F.coalesce("root", "node").alias("root"),
            F.coalesce("links", F.lit(0)).alias("n_texts"),
            (F.coalesce("copies", F.lit(0)) + F.col("same") - 1).alias("n_links"),
        )
    )
    first = F.struct(F.col("rep_id").isNull(), F.col("rep_id"), F.col("node"))
    heads = named.groupBy("root").agg(F.min("rep_id").alias("class_id"), F.min_by("node", first).alias("head"))
    decided = named.join(heads, "root").drop("root", "node")
    outcome = slim.join(decided, ["_a", "_b"]).select(
        "_row", "rep_id", "class_id", "n_texts", "n_links", (F.col("_row") == F.col("head")).alias("kept")
    )
    return rows, outcome
