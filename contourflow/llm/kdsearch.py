"""Exact top-k by inner product: shards by median splits, a KD-tree in each, searched best box first; a query goes only to
shards whose box can still beat the kth score that it brings along."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, checkpointed

LEAF = 256


class KDTree:
    """Median splits along the widest side; each node has the tight bounding box of its vectors.

    vectors: integers in float64, or in object arrays where products could pass 2**53; ids break ties. Coordinates that
    are all equal can't be split further: such a node is cut in two by id, so that no leaf passes LEAF vectors.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids = vectors[order], ids[order]
        self.low, self.high, self.children, self.rows = [], [], [], []
        if len(ids):
            self._build(np.arange(len(ids)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        node, own = len(self.rows), self.vectors[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.rows.append(rows)
        if len(rows) > leaf:
            side = high - low
            axis = int(np.argmax(side)) if len(side) else 0
            half = len(rows) // 2
            if len(side) and side[axis] > 0:
                rows = rows[np.argsort(own[:, axis], kind="stable")]
            a = self._build(np.sort(rows[:half]), leaf)
            b = self._build(np.sort(rows[half:]), leaf)
            self.children[node], self.rows[node] = (a, b), None
        return node

    def search(self, query: np.ndarray, own_id: int, k: int, floor) -> list[tuple]:
        """The k best (score, id) whose score is at least floor, ties to smaller ids; own_id is left out."""
        if not self.rows:
            return []
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        bound = lambda n: self.high[n] @ up + self.low[n] @ down  # noqa: E731  no inner product within the box is larger
        best: list[tuple] = []  # a heap of (score, -id)
        todo = [(-bound(0), 0)]
        while todo:
            reach, node = heapq.heappop(todo)
            least = best[0][0] if len(best) == k else floor
            if least is not None and -reach < least:
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(todo, (-bound(child), child))
                continue
            rows = self.rows[node]
            rows = rows[self.ids[rows] != own_id]
            scores = self.vectors[rows] @ query
            if least is not None:
                fits = np.flatnonzero(scores >= least)
                rows, scores = rows[fits], scores[fits]
            if len(rows) > k:  # of equal scores the smaller ids, which come first
                fits = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[fits], scores[fits]
            for row, score in zip(rows.tolist(), scores.tolist(), strict=True):
                i = int(self.ids[row])
                if len(best) < k:
                    heapq.heappush(best, (int(score), -i))
                elif (int(score), -i) > best[0]:
                    heapq.heapreplace(best, (int(score), -i))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def integers(column: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null for vectors that are null or hold null or non-finite ones."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(column.isNotNull() & fine, F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A row for each vector; shorter vectors are filled with zeros, which change no inner product."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    ends, flat = np.asarray(column.offsets).astype(np.int64), np.asarray(column.values)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], sizes)] = flat[ends[0] : ends[-1]]
    return out


def _fitted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both to one width, and as Python integers if float64 might round a product's sum."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, width) >= 2**52:
        exact = np.frompyfunc(int, 1, 1)
        return exact(a).astype(object), exact(b).astype(object)
    return a, b


def _searched(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            vectors, queries = _fitted(_matrix(left.column("v")), _matrix(right.column("v")))
            tree = KDTree(vectors, left.column("vec_id").to_numpy())
            for q, own_id, floor in zip(queries, right.column("vec_id").to_pylist(), right.column("floor").to_pylist(), strict=True):
                out += [(own_id, i, s) for s, i in tree.search(q, own_id, k, floor)]
        fits = [(q, i, max(-(2**63), min(2**63 - 1, s))) for q, i, s in out]
        return pa.table({n: pa.array([x[j] for x in fits], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    return search


#: Boxes that meet a block of queries at once.
GROUP = 1024
#: Vectors that the shards' median splits are fitted on, at most. Every vector is in a shard, whatever the sample.
SAMPLE = 16_384


class Splits:
    """A tree of median splits along the widest side, of a sample; its leaves are the shards."""

    def __init__(self, sample: np.ndarray, n_shards: int):
        self.nodes: list[tuple[int, float, int, int] | int] = []
        self.n = 0
        self._build(sample, n_shards)

    def _build(self, own: np.ndarray, n: int) -> int:
        at = len(self.nodes)
        self.nodes.append(-1)
        side = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(0)
        if n < 2 or not side.size or side.max() <= 0:
            self.nodes[at], self.n = self.n, self.n + 1
            return at
        axis = int(side.argmax())
        cut = float(np.quantile(own[:, axis], (n // 2) / n, method="lower"))
        low = own[:, axis] <= cut
        if low.all():  # so many equal ones that the median is the largest
            cut = float(own[:, axis][own[:, axis] < cut].max())
            low = own[:, axis] <= cut
        a, b = self._build(own[low], n // 2), self._build(own[~low], n - n // 2)
        self.nodes[at] = axis, cut, a, b
        return at

    def shard_of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
                continue
            axis, cut, a, b = node
            low = vectors[rows, axis] <= cut if axis < vectors.shape[1] else np.full(len(rows), 0.0 <= cut)
            todo += [(a, rows[low]), (b, rows[~low])]
        return out


def sharded(given: DataFrame, shard_rows: int) -> DataFrame:
    """given (vec_id, v), which is written, with shard: about shard_rows to a shard.

    Shards are the leaves of median splits of a sample; one that holds more rows, of equal or hardly differing vectors,
    is dealt into parts by row number, so that no value makes a large one.
    """
    n = given.count()
    sample = given.orderBy(F.xxhash64("vec_id", "v")).select("v").limit(min(SAMPLE, n)).toArrow()
    splits = given.sparkSession.sparkContext.broadcast(Splits(_matrix(sample.column("v")), max(1, math.ceil(n / shard_rows))))

    def dealt(parts):
        for part in batches(parts, 8 << 20):
            leaf = splits.value.shard_of(_matrix(pa.chunked_array([part.column("v")])))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), part.column("row"), pa.array(leaf, pa.int64())], names=["vec_id", "v", "row", "leaf"])

    # given is written, so its rows are numbered alike whenever a task runs again.
    leaves = given.withColumn("row", F.monotonically_increasing_id()).mapInArrow(dealt, "vec_id bigint, v array<double>, row bigint, leaf bigint")
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("parts"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("parts").over(Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each leaf
    return leaves.join(sizes, "leaf").select("vec_id", "v", (F.col("before") + F.pmod(F.xxhash64("row"), F.col("parts"))).alias("shard"))


def boxes(shards: DataFrame) -> DataFrame:
    """(shard, low, high): the tight bounding box of each shard's vectors; shorter vectors count as filled with zeros."""

    def boxed(key, group):
        own = _matrix(group.column("v"))
        return pa.table({"shard": [key[0].as_py()], "low": pa.array([own.min(axis=0)], pa.list_(pa.float64())), "high": pa.array([own.max(axis=0)], pa.list_(pa.float64()))})

    return shards.groupBy("shard").applyInArrow(boxed, "shard bigint, low array<double>, high array<double>")


def _reaching(best_only: bool):
    """Pairs (q, shard, reach) of queries and boxes: of each query the box that reaches highest, or those beyond its floor.

    reach is the largest inner product with any point of the box, a little more where doubles round.
    """

    def reaching(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            low, high, queries = (_matrix(t.column(c)) for t, c in ((left, "low"), (left, "high"), (right, "v")))
            width = max(low.shape[1], queries.shape[1])
            low, high, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (low, high, queries))
            shards, q = left.column("shard").to_numpy(), right.column("q").to_numpy()
            floors = np.array([-np.inf if f is None else float(f) for f in right.column("floor").to_pylist()])
            for at in range(0, len(q), 1024):
                up, down = np.maximum(queries[at : at + 1024], 0), np.minimum(queries[at : at + 1024], 0)
                reach = up @ high.T + down @ low.T
                reach += 1e-9 * (up @ np.abs(high).T - down @ np.abs(low).T) + 1
                if best_only:
                    row, col = np.arange(len(up)), reach.argmax(axis=1)
                else:
                    row, col = np.nonzero(reach >= floors[at : at + 1024, None])
                out[0].append(q[at + row])
                out[1].append(shards[col])
                out[2].append(reach[row, col])
        return pa.table({n: pa.array(np.concatenate([*x, np.empty(0, d)]), t) for n, x, d, t in zip(("q", "shard", "reach"), out, (np.int64, np.int64, float), (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return reaching


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, shard_rows: int = 8192, block_rows: int = 8192) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the k vectors of highest inner product, exactly.

    vectors and queries have vec_id and v, an array of integral doubles; other columns don't matter, whatever their
    names. Rows without v or vec_id take no part; a query finds no row of its own id. Equal scores rank by smaller
    vec_id. Every row is a candidate: a vector given twice is found twice. Query rows of one id are one query, whose
    scores are those of all its rows. Vectors of fewer components are filled with zeros. Empty tables give no rows.

    Shards are leaves of median splits, each with its box. A query first searches the shard whose box reaches highest;
    the kth score found there is a bound, and of the other shards only those are searched whose box reaches it. Queries
    to one shard come in blocks of about block_rows; a tree is built for each shard and block. Where boxes tell nothing
    (directions without any structure) all shards are searched, and the work grows with vectors times queries. Scores
    outside of 64 bits are clamped.
    """
    given = checkpointed(vectors.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("v").cast("array<double>").alias("v")))
    asked = queries.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    asked = checkpointed(asked)
    shards = checkpointed(sharded(given, shard_rows))
    n_blocks, n_groups = max(1, math.ceil(asked.count() / block_rows)), 1 + (shards.agg(F.max("shard")).first()[0] or 0) // GROUP
    rows = asked.withColumn("q", F.monotonically_increasing_id())
    block = F.pmod(F.xxhash64("q"), F.lit(n_blocks))
    boxed = checkpointed(boxes(shards)).withColumn("group", F.expr(f"shard div {GROUP}")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    blocked = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))

    def reaching(asking: DataFrame, best_only: bool) -> DataFrame:
        right = asking.withColumn("block", block).withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_groups - 1).cast("bigint"))))
        return boxed.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(_reaching(best_only), "q bigint, shard bigint, reach double")

    def searched(pairs: DataFrame) -> DataFrame:
        right = pairs.join(rows, "q").select("shard", block.alias("block"), "vec_id", "v", "floor")
        return blocked.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_searched(k), "query_id bigint, vec_id bigint, score bigint")

    none = F.lit(None).cast("bigint")
    best = reaching(rows.withColumn("floor", none), True).groupBy("q").agg(F.max(F.struct("reach", "shard")).alias("m")).select("q", F.col("m.shard").alias("shard"))
    best = checkpointed(best)
    first = checkpointed(searched(best.withColumn("floor", none)))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(by)).where(f"rank <= {k}").where(f"rank = {k} and score > {-(2**63)}")
    floors = rows.join(kth.select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor")), "vec_id", "left").select("q", "vec_id", "v", "floor")
    other = reaching(floors, False).join(best, ["q", "shard"], "left_anti").join(floors.select("q", "floor"), "q").select("q", "shard", "floor")
    every = first.union(searched(other))
    return every.withColumn("rank", F.row_number().over(by)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
