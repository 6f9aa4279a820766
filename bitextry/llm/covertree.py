"""Exact top-k by inner product with two cover trees, which are searched together.

The trees keep the invariants of simplified cover trees (Izbicki and Shelton 2015): a node of level ``i`` covers its
rows within ``base ** i``, and its children are more than ``base ** (i - 1)`` apart. A pair of nodes is skipped, inner
nodes of queries included, when even the best inner product that centres and covering radii allow is below the worst
k-th score among the queries below the query node. Leaves of queries that share a parent are answered together, so that
vectors which trees cannot tell apart, where nothing is out of reach, cost little more than one matrix product.

Large tables are cut by the top of a cover tree over a bounded sample: every row goes to its nearest cell, and a query
goes only to cells that can still hold one of its k best. Cells beyond a block are cut into blocks.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitextry.session import checkpointed

EXACT = 2.0**53
LEAST = np.iinfo(np.int64).min
# Fewer pairs of nodes than this take less time than the calls that would tell them apart.
PAIRS = 1 << 15


@dataclass(frozen=True)
class SearchSpec:
    """Neighbours per query, vectors in a data and a query block, vectors of a leaf, and the ratio of tree levels.

    ``cells`` bounds the cells that a table is cut into, ``sample`` the rows that their centres are chosen from; both
    change the work only, never the result. ``batch`` vectors are compared with a group of up to ``group`` leaves of
    queries at once.
    """

    k: int = 5
    data_block: int = 8_192
    query_block: int = 2_048
    leaf: int = 16
    base: float = 1.3
    cells: int = 1024
    sample: int = 8192
    batch: int = 1024
    group: int = 256


def whole(vectors: np.ndarray) -> bool:
    """Whether products and squared distances of the vectors are exact as doubles."""
    reach = 4 * vectors.shape[1] * np.abs(vectors).max(initial=0.0) ** 2
    return bool(reach < EXACT and (vectors == np.rint(vectors)).all())


def distances(vectors: np.ndarray, center: np.ndarray, exact: bool) -> np.ndarray:
    """Euclidean distances; by one matrix product where that is ``exact``."""
    if not exact:
        return np.sqrt(((vectors - center) ** 2).sum(axis=1))
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors) + center @ center - 2 * (vectors @ center))


class CoverTree:
    """Nodes as arrays: ``center`` (a row), ``radius``, ``norm``, ``level``, ``children``, and rows ``order[low:high]``.

    Node 0 is the root, and a node's first child has its centre. A node of up to ``leaf`` rows, or of equal ones, is a
    leaf. Levels at which a node would have itself as its only child are left out, so the depth is bounded by the ratio
    of the largest and the smallest distance.
    """

    def __init__(self, vectors: np.ndarray, spec: SearchSpec) -> None:
        self.vectors, self.order, self.exact = vectors, np.arange(len(vectors)), whole(vectors)
        self.center: list[int] = []
        self.radius: list[float] = []
        self.level: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.children: list[np.ndarray] = []
        apart = distances(vectors, vectors[0], self.exact)
        waiting = [(self.add(0, apart, 0, len(vectors), spec), apart)]
        while waiting:
            node, apart = waiting.pop()
            if self.high[node] - self.low[node] <= spec.leaf or self.radius[node] == 0:
                continue
            made = self.split(node, apart, spec)
            self.children[node] = np.array([child for child, _ in made])
            waiting.extend(made)
        self.center, self.radius = np.array(self.center), np.array(self.radius)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors[self.center], vectors[self.center]))
        self.inner = np.array([len(c) > 0 for c in self.children])

    def add(self, center: int, apart: np.ndarray, low: int, high: int, spec: SearchSpec) -> int:
        radius = float(apart.max(initial=0.0))
        self.center.append(center)
        self.radius.append(radius)
        self.level.append(math.ceil(math.log(radius, spec.base)) if radius else 0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(np.array([], np.int64))
        return len(self.center) - 1

    def split(self, node: int, apart: np.ndarray, spec: SearchSpec) -> list[tuple[int, np.ndarray]]:
        """The children: a net of the node's rows, each row with the first centre that covers it on the next level."""
        low, high = self.low[node], self.high[node]
        left, held = self.order[low:high].copy(), spec.base ** (self.level[node] - 1)
        # Rounding must not leave all rows with the node's own centre.
        held = min(held, np.nextafter(self.radius[node], 0))
        made, center, at = [], self.center[node], low
        while len(left):
            near = apart <= held
            mine = left[near]
            self.order[at : at + len(mine)] = mine
            made.append((self.add(center, apart[near], at, at + len(mine), spec), apart[near]))
            at += len(mine)
            left = left[~near]
            if len(left):
                center = left[0]
                apart = distances(self.vectors[left], self.vectors[center], self.exact)
        return made

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.low[node] : self.high[node]]

    def rows_of(self, nodes: np.ndarray) -> np.ndarray:
        """The rows of several nodes, one node after the other."""
        sizes = self.high[nodes] - self.low[nodes]
        return self.order[np.repeat(self.low[nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def best_products(dots: np.ndarray, norm: float | np.ndarray, radius: float | np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No inner product of two vectors within the radii of the centres is larger; with room for rounding."""
    top = dots + norm * radii + radius * norms + radius * radii
    # Scores end at the least 64-bit number, so a bound below it must not tell them apart.
    return np.maximum(top + 1e-9 * (norm + radius) * (norms + radii) + 1e-6, LEAST)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond 64 bits are the nearest 64-bit number."""
    reach = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if reach < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    ends = np.iinfo(np.int64)
    return np.clip(whole, ends.min, ends.max).astype(np.int64)


class Search:
    """The k best data vectors of each query, found over pairs of nodes.

    ``floor`` is a score per query that its k best reach at the least, or minus infinity.
    """

    def __init__(self, queries, query_ids, data, data_ids, spec: SearchSpec, floor=None) -> None:
        self.queries, self.query_ids, self.data, self.data_ids, self.spec = queries, query_ids, data, data_ids, spec
        # The best found so far, in order: score and id in the first ``filled`` places of each query.
        self.scores = np.zeros((len(query_ids), spec.k), np.int64)
        self.ids = np.zeros((len(query_ids), spec.k), np.int64)
        self.filled = np.zeros(len(query_ids), np.int64)
        self.worst = np.full(len(query_ids), -np.inf) if floor is None else np.asarray(floor, np.float64).copy()
        reach = np.abs(queries).max(initial=0.0) * np.abs(data).max(initial=0.0) * data.shape[1]
        self.exact = bool(reach < EXACT)
        self.compared = 0

    @property
    def best(self) -> list[list[tuple[int, int]]]:
        """Score and negative id of what each query has found."""
        return [[(int(s), -int(i)) for s, i in zip(self.scores[q, :n], self.ids[q, :n])] for q, n in enumerate(self.filled)]

    def run(self) -> None:
        self.asked, self.held = CoverTree(self.queries, self.spec), CoverTree(self.data, self.spec)
        self.asked_centers, self.held_centers = self.queries[self.asked.center], self.data[self.held.center]
        leaves = np.flatnonzero(~self.asked.inner)
        unknown = leaves[[bool(np.isneginf(self.worst[self.asked.rows(q)]).any()) for q in leaves]]
        for part in self.groups(unknown):
            self.prime(part, 0)
        self.visit(0, np.array([0]))

    def groups(self, leaves: np.ndarray) -> list[np.ndarray]:
        return [leaves[low : low + self.spec.group] for low in range(0, len(leaves), self.spec.group)]

    def prime(self, leaves: np.ndarray, node: int) -> None:
        """A first k-th score for leaves of queries, from the part of the data below ``node`` that promises most.

        It is a bound only: what reaches it is found again by :meth:`visit`.
        """
        if self.held.inner[node] and self.held.high[node] - self.held.low[node] > self.spec.batch:
            children = self.held.children[node]
            large = self.held.high[children] - self.held.low[children] > self.spec.k
            children = children[large] if large.any() else children
            chosen = children[self.bounds(leaves, children).argmax(axis=1)]
            for child in np.unique(chosen):
                self.prime(leaves[chosen == child], child)
            return
        rows, own = self.asked.rows_of(leaves), self.held.rows(node)[: self.spec.batch]
        if len(own) < self.spec.k:
            return
        # Queries of a leaf may be many, as equal ones are.
        for low in range(0, len(rows), self.spec.query_block):
            some = rows[low : low + self.spec.query_block]
            scores = products(self.queries[some], self.data[own]).astype(np.float64)
            scores[self.data_ids[own] == self.query_ids[some][:, None]] = -np.inf
            self.compared += scores.size
            self.raise_floor(some, np.partition(scores, -self.spec.k, axis=1)[:, -self.spec.k])

    def raise_floor(self, rows: np.ndarray, scores: np.ndarray) -> None:
        # A score as a double may be rounded up, and a floor must not be.
        big = np.abs(scores) >= EXACT
        self.worst[rows] = np.maximum(self.worst[rows], np.where(big, np.nextafter(scores, -np.inf), scores))

    def bounds(self, asking: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """For each query node of ``asking`` and each data node, what no inner product below them exceeds."""
        dots = self.asked_centers[asking] @ self.held_centers[nodes].T
        norm, radius = self.asked.norm[asking][:, None], self.asked.radius[asking][:, None]
        return best_products(dots, norm, radius, self.held.norm[nodes], self.held.radius[nodes])

    def visit(self, q: int, nodes: np.ndarray) -> None:
        """Answers the queries below ``q`` from the data below ``nodes``, of which those out of reach are skipped."""
        asked, held = self.asked, self.held
        if not asked.inner[q]:
            return self.finish(np.array([q]), nodes)
        while True:
            nodes = nodes[self.bounds(np.array([q]), nodes)[0] >= self.worst[asked.rows(q)].min()]
            if not len(nodes):
                return
            large = held.inner[nodes] & (held.radius[nodes] > asked.radius[q])
            if not large.any():
                break
            nodes = np.concatenate([nodes[~large], *(held.children[r] for r in nodes[large])])
        inner = asked.inner[asked.children[q]]
        for part in self.groups(asked.children[q][~inner]):
            self.finish(part, nodes)
        for child in asked.children[q][inner]:
            self.visit(child, nodes)

    def finish(self, leaves: np.ndarray, nodes: np.ndarray) -> None:
        """The nodes in reach of a group of leaves of queries, the most promising first.

        Where less than a tenth of many pairs is in reach, the leaves go on in smaller groups.
        """
        sizes = self.asked.high[leaves] - self.asked.low[leaves]
        rows, starts = self.asked.rows_of(leaves), np.cumsum(sizes) - sizes

        def in_reach(bounds: np.ndarray) -> np.ndarray:
            return bounds >= np.minimum.reduceat(self.worst[rows], starts)[:, None]

        bounds = self.bounds(leaves, nodes)
        reach = in_reach(bounds)
        some = reach.any(axis=0)
        nodes, bounds, reach = nodes[some], bounds[:, some], reach[:, some]
        if not len(nodes):
            return
        if len(leaves) > 1 and reach.size > PAIRS and reach.mean() < 0.1:
            for part in np.array_split(leaves, 2):
                self.finish(part, nodes)
            return
        heap: list[tuple[float, int]] = []

        def take(nodes: np.ndarray, bounds: np.ndarray) -> None:
            top, inner = bounds.max(axis=0), self.held.inner[nodes]
            for bound, node in zip(top[inner], nodes[inner], strict=True):
                heapq.heappush(heap, (-float(bound), int(node)))
            order = np.flatnonzero(~inner)
            order = order[np.argsort(-top[order], kind="stable")]
            ends = np.cumsum(self.held.high[nodes[order]] - self.held.low[nodes[order]])
            low = 0
            while low < len(order) and top[order[low]] >= self.worst[rows].min():
                done = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, done + self.spec.batch, side="right")))
                batch = order[low:high]
                reach = in_reach(bounds[:, batch])
                asking = rows[np.repeat(reach.any(axis=1), sizes)]
                self.compare(asking, self.held.rows_of(nodes[batch[reach.any(axis=0)]]))
                low = high

        take(nodes, bounds)
        while heap:
            negative, node = heapq.heappop(heap)
            # At equal scores a smaller id may still enter.
            if -negative < self.worst[rows].min():
                return
            children = self.held.children[node]
            bounds = self.bounds(leaves, children)
            some = in_reach(bounds).any(axis=0)
            if some.any():
                take(children[some], bounds[:, some])

    def compare(self, asking: np.ndarray, rows: np.ndarray) -> None:
        # Equal vectors are one leaf, however many they are.
        for first in range(0, len(asking), self.spec.query_block):
            for low in range(0, len(rows), 2 * self.spec.batch):
                self.compare_some(asking[first : first + self.spec.query_block], rows[low : low + 2 * self.spec.batch])

    def compare_some(self, asking: np.ndarray, rows: np.ndarray) -> None:
        k = self.spec.k
        self.compared += len(asking) * len(rows)
        a, b, ids = self.queries[asking], self.data[rows], self.data_ids[rows]
        scores = a @ b.T if self.exact else products(a, b)
        # Rows of the query's own id must not take the places of others.
        promising = (scores >= self.worst[asking][:, None]) & (ids != self.query_ids[asking][:, None])
        many = np.flatnonzero(np.count_nonzero(promising, axis=1) > 4 * k)
        if len(many):
            offered = np.where(promising[many], scores[many], LEAST)
            promising[many] &= scores[many] >= np.partition(offered, -k, axis=1)[:, [-k]]
        at, hit = np.nonzero(promising)
        if not len(at):
            return
        changed = np.unique(at)
        kept, place = np.nonzero(np.arange(k) < self.filled[asking[changed]][:, None])
        row = np.concatenate([asking[at], asking[changed[kept]]])
        score = np.concatenate([scores[at, hit].astype(np.int64), self.scores[asking[changed[kept]], place]])
        id_ = np.concatenate([ids[hit], self.ids[asking[changed[kept]], place]])
        # The complement orders downwards and has no overflow.
        order = np.lexsort((id_, ~score, row))
        row = row[order]
        new = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
        best = place < k
        self.scores[row[best], place[best]], self.ids[row[best], place[best]] = score[order][best], id_[order][best]
        self.filled[row[new]] = np.minimum(k, np.diff(np.append(new, len(row))))
        full = row[new][self.filled[row[new]] == k]
        self.raise_floor(full, self.scores[full, k - 1].astype(np.float64))

    def found(self) -> pd.DataFrame:
        """``query_id, vec_id, score`` of what was found."""
        row, place = np.nonzero(np.arange(self.spec.k) < self.filled[:, None])
        return pd.DataFrame({"query_id": self.query_ids[row], "vec_id": self.ids[row, place], "score": self.scores[row, place]}).astype("int64")


class Cells:
    """The top of a cover tree over a sample: centres that rows are placed by. Their number is bounded."""

    def __init__(self, sample: np.ndarray, number: int, spec: SearchSpec) -> None:
        tree, open_nodes, closed = CoverTree(sample, spec), [], []
        heapq.heappush(open_nodes, (-tree.radius[0], 0))
        while open_nodes and len(open_nodes) + len(closed) < number:
            _, node = heapq.heappop(open_nodes)
            if not tree.inner[node]:
                closed.append(node)
                continue
            for child in tree.children[node]:
                heapq.heappush(open_nodes, (-tree.radius[child], int(child)))
        # One node may have most of the sample as children; as many as are asked for are enough.
        nodes = sorted([*closed, *(node for _, node in open_nodes)], key=lambda n: -tree.radius[n])[: min(number, spec.cells)]
        self.centers = sample[np.sort(tree.center[nodes])]

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each vector and the distance to it."""
        centers = widened(self.centers, vectors.shape[1])
        cell, apart = np.zeros(len(vectors), np.int32), np.full(len(vectors), np.inf)
        vectors, exact = widened(vectors, centers.shape[1]), whole(vectors) and whole(centers)
        if exact:
            norms = np.einsum("ij,ij->i", centers, centers)
            for low in range(0, len(vectors), 1024):
                some = vectors[low : low + 1024]
                squares = np.einsum("ij,ij->i", some, some)[:, None] + norms - 2 * (some @ centers.T)
                cell[low : low + 1024], apart[low : low + 1024] = squares.argmin(axis=1), np.sqrt(squares.min(axis=1))
            return cell, apart
        for number, center in enumerate(centers):
            here = distances(vectors, center, False)
            closer = here < apart
            cell[closer], apart[closer] = number, here[closer]
        return cell, apart

    def reach(self, vector: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """The best inner product that a row of each cell can have with ``vector``."""
        centers = widened(self.centers, len(vector))
        norms = np.sqrt(np.einsum("ij,ij->i", centers, centers))
        vector = widened(vector[None, :], centers.shape[1])[0]
        return best_products(centers @ vector, float(np.sqrt(vector @ vector)), 0.0, norms, radii)


def widened(vectors: np.ndarray, width: int) -> np.ndarray:
    """Vectors that end in zeros up to ``width``."""
    return np.pad(vectors, ((0, 0), (0, max(0, width - vectors.shape[1]))))


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component, as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))


def usable(vector: Column) -> Column:
    """Not null, and neither is a component, all of which are finite."""
    limit = F.lit(float("inf"))
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit)), F.lit(False)
    )


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def nearest(vectors: DataFrame, is_query: Column, spec: SearchSpec = SearchSpec()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of ``vectors`` (vec_id, embedding) for each query.

    Components become floor(256 x); the score is the exact inner product, limited to 64 bits. Ties go to the smaller
    vec_id. Rows without an id or with an unusable vector take no part; vectors of different lengths are
    compared as if the shorter one ended in zeros. Rows that share an id are not neighbours of each other, and the
    first of their vectors is the query. A query without other rows has no result, and an empty table has none.
    Other columns, whatever their names, take no part.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint"), quantised(F.col("embedding")).alias("v"), is_query.alias("asks")
    )
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    queries = rows.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    count = rows.count()
    if count <= spec.data_block:
        floor = F.lit(None).cast("bigint").alias("floor")
        return ranked(meet(queries.select("*", floor, F.lit(0).alias("block")), rows.withColumn("block", F.lit(0)), spec), spec)

    # The sample is bounded, and so are the centres and the sizes of the cells.
    sample = rows.orderBy(F.xxhash64("vec_id", "row")).limit(spec.sample).select("v").toPandas()["v"]
    cells = Cells(matrix(sample, max(map(len, sample))), min(spec.cells, -(-count // spec.data_block)), spec)

    @F.pandas_udf("cell int, apart double")
    def place(batch: pd.Series) -> pd.DataFrame:
        cell, apart = cells.place(matrix(batch, max(map(len, batch), default=0)))
        return pd.DataFrame({"cell": cell, "apart": apart})

    placed = checkpointed(rows.select("vec_id", "v", "row", place("v").alias("at")).select("vec_id", "v", "row", "at.*"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).toPandas()
    radii, pieces = np.full(len(cells.centers), -np.inf), np.zeros(len(cells.centers), np.int64)
    radii[sizes["cell"]] = sizes["radius"]
    pieces[sizes["cell"]] = -(-sizes["n"] // spec.data_block)
    first = np.cumsum(pieces) - pieces
    used = np.flatnonzero(pieces)
    cut = rows.sparkSession.createDataFrame(
        pd.DataFrame({"cell": used.astype(np.int32), "first": first[used], "pieces": pieces[used]})
    )
    piece = F.pmod(F.xxhash64("row"), F.col("pieces"))
    data = checkpointed(placed.join(F.broadcast(cut), "cell").select("vec_id", "v", (F.col("first") + piece).alias("block")))

    @F.pandas_udf("bigint")
    def home(batch: pd.Series) -> pd.Series:
        # A block of the cell whose centre scores best; the answer there bounds the k-th score from below.
        best = (used[int(cells.reach(np.array(v), np.zeros(len(radii)))[used].argmax())] for v in batch)
        return pd.Series([first[c] for c in best], dtype="int64")

    @F.pandas_udf("array<bigint>")
    def in_reach(batch: pd.Series, floors: pd.Series) -> pd.Series:
        out = []
        for vector, floor in zip(batch, floors, strict=True):
            reach = used[cells.reach(np.array(vector), radii)[used] >= (LEAST if pd.isna(floor) else np.nextafter(float(floor), -np.inf))]
            out.append(np.concatenate([np.arange(first[c], first[c] + pieces[c]) for c in reach] or [np.array([], np.int64)]))
        return pd.Series(out)

    started = queries.select("*", F.lit(None).cast("bigint").alias("floor"), home("v").alias("block"))
    kth = ranked(meet(started, data, spec), spec).filter(F.col("rank") == spec.k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    asking = checkpointed(queries.join(kth, "vec_id", "left"))
    return ranked(meet(asking.withColumn("block", F.explode(in_reach("v", "floor"))), data, spec), spec)


def meet(queries: DataFrame, data: DataFrame, spec: SearchSpec) -> DataFrame:
    """``query_id, vec_id, score``: up to k rows of each block for each query (vec_id, v, floor, block) sent to it.

    Blocks that many queries ask for are searched by groups of queries, each with a copy of the block.
    """
    asked = queries.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.ceil(F.col("n") / spec.query_block).alias("groups"))
    left = queries.join(asked, "block").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("groups")))
    right = data.join(asked, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))

    def search(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or held.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(1, max(map(len, [*asking["v"], *held["v"]])))
        floor = asking["floor"].astype("float64").fillna(-np.inf).to_numpy()
        task = Search(
            matrix(asking["v"], width),
            asking["vec_id"].to_numpy(),
            matrix(held["v"], width),
            held["vec_id"].to_numpy(),
            spec,
            np.where(np.abs(floor) >= EXACT, np.nextafter(floor, -np.inf), floor),
        )
        task.run()
        return task.found()

    def renewed(df: DataFrame, *names: str) -> DataFrame:
        # Both sides may come from one table, and a cogroup must tell their columns apart.
        return df.select(*(F.col(n).alias(n) for n in names))

    return (
        renewed(left, "vec_id", "v", "block", "part", "floor")
        .groupBy("block", "part")
        .cogroup(renewed(right, "vec_id", "v", "block", "part").groupBy("block", "part"))
        .applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    )


def ranked(found: DataFrame, spec: SearchSpec) -> DataFrame:
    """The k best of what the blocks offer; each offers at most k rows per query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")
