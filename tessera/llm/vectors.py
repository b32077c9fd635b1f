"""Approximate nearest neighbours by inner product, with a vantage-point tree per shard.

Largest inner product becomes smallest distance: each vector gets one more component,
``sqrt(M^2 - |x|^2)`` with M the largest norm, and queries a zero there. A tree node keeps a
vantage vector and how far those on its inner and outer side lie from it; by the triangle
inequality a side whose closest possible distance is beyond the k-th best found so far holds
nothing. That bound is multiplied by ``factor``: one, the default, is exact, more skips sides sooner.

Rows are dealt to shards by a hash, so no value of a column decides a shard's size. Each shard's tree is built
once and staged; then queries meet the trees in blocks: a task holds one tree and one block. Equal vectors of
a shard are one point of its tree with their smallest ids, enough of them for any result without the
query's own, so a large group of copies costs nothing and loses nothing. Merging
the k best of each shard is a partial aggregation. Each query meets each shard, so the work is that of queries
times shards, and trees are sent once for each block.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no
part, neither as queries nor as candidates, and neither do those of another length than most have (the shorter
one of equally frequent lengths); ties go to the smaller id; a query with fewer
than k candidates gets all; of rows that repeat an id each is a candidate, but none for a query of that
id; rows that repeat a query's id and vector are one query, and an id with several query vectors gets the k best of all of them
together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ship, stage

K = 20
#: Vectors in a shard: a share of all, between these bounds; queries in a block, about.
SHARES, LEAST_SHARD, MOST_SHARD, BLOCK_ROWS = 8, 2048, 65_536, 16_384
LEAF = 48
NO_ID = np.iinfo(np.int64).max
#: Relaxation of the pruning bound; 1.0 is exact. The bound holds the raised component, which is far larger than
#: the differences between candidates where one vector is long, so no larger factor is safe for all norms.
FACTOR = 1.0


def usable(vector: Column) -> Column:
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & plain & F.exists(vector, lambda x: x != 0)


class VantageTree:
    """Points with lists of ids; ``search`` walks it with a block of queries at once."""

    def __init__(self, points: np.ndarray, seed: int = 5):
        self.points = points
        self.nodes: list[tuple] = []
        self.rng = np.random.default_rng(seed)
        if len(points):
            self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        me = len(self.nodes)
        if len(rows) <= LEAF:
            self.nodes.append((rows,))
            return me
        self.nodes.append(())
        v = int(rows[self.rng.integers(len(rows))])
        far = np.sqrt(np.maximum(0, ((self.points[rows] - self.points[v]) ** 2).sum(axis=1)))
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        inner, outer = order[:half], order[half:]
        a, b = self._build(rows[inner]), self._build(rows[outer])
        self.nodes[me] = (v, float(far[inner].min()), float(far[inner].max()), float(far[outer].min()), float(far[outer].max()), a, b)
        return me

    def search(self, queries: np.ndarray, best: BestK, factor: float) -> None:
        """First each query's own leaf, which gives a radius; then one walk for all, each side with the queries it may still serve."""
        if self.nodes:
            everyone = np.arange(len(queries))
            home = np.full(len(queries), -1)
            self._descend(0, queries, everyone, best, home)
            self._walk(0, queries, everyone, best, factor, home)

    def _sides(self, node: int, queries: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least possible distances to the inner and to the outer side."""
        v, in_lo, in_hi, out_lo, out_hi, _, _ = self.nodes[node]
        d = np.sqrt(np.maximum(0, ((queries[active] - self.points[v]) ** 2).sum(axis=1)))
        return np.maximum(0, np.maximum(in_lo - d, d - in_hi)), np.maximum(0, np.maximum(out_lo - d, d - out_hi))

    def _descend(self, node: int, queries: np.ndarray, active: np.ndarray, best: BestK, home: np.ndarray) -> None:
        if not len(active):
            return
        x = self.nodes[node]
        if len(x) == 1:
            home[active] = node
            best.offer(active, x[0])
            return
        to_in, to_out = self._sides(node, queries, active)
        self._descend(x[5], queries, active[to_in <= to_out], best, home)
        self._descend(x[6], queries, active[to_in > to_out], best, home)

    def _walk(self, node: int, queries: np.ndarray, active: np.ndarray, best: BestK, factor: float, home: np.ndarray) -> None:
        if not len(active):
            return
        x = self.nodes[node]
        if len(x) == 1:
            best.offer(active[home[active] != node], x[0])
            return
        to_in, to_out = self._sides(node, queries, active)
        self._walk(x[5], queries, active[to_in * factor <= best.radius(active)], best, factor, home)
        self._walk(x[6], queries, active[to_out * factor <= best.radius(active)], best, factor, home)


class BestK:
    """The k best of each query by (score descending, id ascending), from points with several ids each."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: list[np.ndarray], top: float, k: int):
        self.queries, self.query_ids, self.points, self.ids, self.top, self.k = queries, query_ids, points, ids, top, k
        self.norms2 = (queries**2).sum(axis=1)
        n = len(query_ids)
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), NO_ID)
        self.point = np.zeros((n, k), np.int64)
        self.reach = np.full(n, np.inf)

    def radius(self, rows: np.ndarray) -> np.ndarray:
        return self.reach[rows]

    def offer(self, rows: np.ndarray, points: np.ndarray) -> None:
        scores = self.queries[rows] @ self.points[points].T
        some = (scores >= self.score[rows, -1][:, None]).any(axis=1)
        rows, scores = rows[some], scores[some]
        if not len(rows):
            return
        many = [len(self.ids[p]) for p in points]
        at = np.repeat(np.arange(len(points)), many)
        ids = np.broadcast_to(np.concatenate([self.ids[p] for p in points]), (len(rows), len(at)))
        scores = np.where(ids == self.query_ids[rows][:, None], -np.inf, scores[:, at])
        ids = np.where(scores > -np.inf, ids, NO_ID)
        scores, ids = np.hstack((self.score[rows], scores)), np.hstack((self.id[rows], ids))
        source = np.hstack((self.point[rows], np.broadcast_to(points[at], (len(rows), len(at)))))
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        take = lambda x: np.take_along_axis(x, order, axis=1)
        self.score[rows], self.id[rows], self.point[rows] = take(scores), take(ids), take(source)
        # distance of the k-th best, with room for rounding
        last = self.score[rows, -1]
        self.reach[rows] = np.sqrt(np.maximum(0, self.norms2[rows] + self.top * self.top - 2 * last)) * (1 + 1e-9) + 1e-9


class Shard:
    """The tree over the different vectors of a shard, and the ids of each."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, top: float, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        vectors, ids = vectors[order], ids[order]
        first = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(axis=1)))
        starts = np.flatnonzero(first)
        # an id counts k times at most; then of 2k rows at least k are left without the rows of any one id
        repeat = np.arange(len(ids)) - np.maximum.accumulate(np.where(first | np.concatenate(([True], ids[1:] != ids[:-1])), np.arange(len(ids)), 0))
        self.ids = [g[r < k][: 2 * k] for g, r in zip(np.split(ids, starts[1:]), np.split(repeat, starts[1:]), strict=True)]
        self.points, self.top, self.k = vectors[starts], top, k
        self.tree = VantageTree(np.hstack((self.points, np.sqrt(np.maximum(0, top * top - (self.points**2).sum(axis=1)))[:, None])))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, vector ids and scores of the k best for each query."""
        best = BestK(queries, query_ids, self.points, self.ids, self.top, self.k)
        self.tree.search(np.hstack((queries, np.zeros((len(queries), 1)))), best, factor)
        at, rank = np.nonzero(best.id != NO_ID)
        # row by row, so that a pair's score doesn't depend on what else was searched
        score = (queries[at] * self.points[best.point[at, rank]]).sum(axis=1)
        return query_ids[at], best.id[at, rank], score


def shard_search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, top: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return Shard(vectors, ids, top, k).search(queries, query_ids, factor)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard_rows: int | None = None) -> DataFrame:
    """For rows and queries with ``vec_id`` and ``embedding``: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = rows.sparkSession
    ship(spark)
    plain = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows, queries = stage(plain(rows), "vectors"), plain(queries)
    usual = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, queries = (df.filter(F.size("embedding") == usual["size"]) for df in (rows, queries))
    queries = stage(queries.select("vec_id", "embedding").distinct(), "queries")
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    top = float(np.sqrt(rows.agg(F.max(norm2)).first()[0])) * (1 + 1e-12)
    shard_rows = shard_rows or min(MOST_SHARD, max(LEAST_SHARD, usual["count"] // SHARES))
    shards = max(1, -(-usual["count"] // shard_rows))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))

    def build(key: tuple[pa.Scalar, ...], vectors: pa.Table) -> pa.Table:
        shard = Shard(matrix(vectors.column("embedding")), vectors.column("vec_id").to_numpy(), top, k)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([pickle.dumps(shard, 5)], pa.binary())], names=["s", "tree"])

    trees = stage(rows.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("long")).groupBy("s").applyInArrow(build, "s long, tree binary"), "trees")
    # each block of queries meets each shard; a cell holds one tree and one block
    cell = lambda s, b: (s * blocks + b).cast("long").alias("cell")
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = trees.select("s", "tree", F.explode(numbers(blocks)).alias("b")).select(cell(F.col("s"), F.col("b")), "tree")
    right = queries.select(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).alias("b"), F.explode(numbers(shards)).alias("s"), "vec_id", "embedding").select(cell(F.col("s"), F.col("b")), "vec_id", "embedding")

    def run(tree: pa.Table, asked: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if tree.num_rows and asked.num_rows:
            shard = pickle.loads(tree.column("tree")[0].as_buffer())
            found = shard.search(matrix(asked.column("embedding")), asked.column("vec_id").to_numpy(), factor)
        return pa.table([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, "query_id long, vec_id long, score double")
    # a sorted list of the best of each shard; k rows a shard and query, so a list is bounded by the shards
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

