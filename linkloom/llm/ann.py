"""Nearest vectors by inner product: a vantage-point tree per shard, pruned by the triangle inequality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .vectors import doubles, matrix, row_products, usable

NEIGHBOURS = 20
#: Pruning factor of the production index. 1 is exact; larger values skip more of the tree.
FACTOR = 2.0
#: Vectors in one tree and queries sent to it at once.
SHARD_ROWS, QUERY_ROWS = 16_384, 4_096
LEAF_ROWS = 256
SLACK = 1e-9


class VantageTree:
    """Vectors in a metric in which the largest inner product is the smallest distance.

    A vector x gets one more component, sqrt(m^2 - |x|^2) with m the largest norm of all shards, and a
    query gets a 0 there; then the squared distance is m^2 + |q|^2 - 2 q.x. Nodes split at the median
    distance to a vantage point and keep the range of distances on both sides. The split is by rank, so
    equal vectors do not unbalance the tree.
    """

    def __init__(self, vectors: np.ndarray, largest_norm: float, leaf_rows: int = LEAF_ROWS) -> None:
        rest = np.maximum(largest_norm**2 - row_products(vectors, vectors), 0.0)
        self.points = np.hstack([vectors, np.sqrt(rest)[:, None]])
        self.leaf_rows = leaf_rows
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, members: np.ndarray):
        if len(members) <= self.leaf_rows:
            return members
        # the member farthest from the first one sees the others at the most different distances
        far = members[np.argmax(self._distances(self.points[members[0]], members))]
        distances = self._distances(self.points[far], members)
        half = len(members) // 2
        order = np.argpartition(distances, half)
        inside, outside = order[:half], order[half:]
        ranges = [(distances[side].min(), distances[side].max()) for side in (inside, outside)]
        return far, ranges, [self._build(members[inside]), self._build(members[outside])]

    def _distances(self, point: np.ndarray, members: np.ndarray) -> np.ndarray:
        gap = self.points[members] - point
        return np.sqrt(row_products(gap, gap))

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """For every query positions and scores of its ``k`` best vectors (position -1: fewer found).

        ``own`` holds the ids of the queries, which are not their own neighbours. A branch is skipped when
        ``factor`` times the least distance it can hold is above the distance of the k-th best so far.
        Ties go to the smaller id.
        """
        n, self.ids, self.own = len(queries), ids, own
        self.queries = np.hstack([queries, np.zeros((n, 1))])
        self.norms = row_products(queries, queries)
        self.k, self.factor = k, factor
        self.scores, self.best = np.full((n, k), -np.inf), np.full((n, k), -1)
        self.top = self._top()
        self._visit(self.root, np.arange(n))
        return self.best, self.scores

    def _top(self) -> float:
        return float(row_products(self.points[:1], self.points[:1])[0]) if len(self.points) else 0.0

    def _reach(self, asked: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far."""
        return np.sqrt(np.maximum(self.top + self.norms[asked] - 2 * self.scores[asked, -1], 0.0))

    def _visit(self, node, asked: np.ndarray) -> None:
        if not len(asked):
            return
        if isinstance(node, np.ndarray):
            return self._leaf(node, asked)
        far, ranges, sides = node
        to = self.queries[asked] @ self.points[far]
        distances = np.sqrt(np.maximum(self.top + self.norms[asked] - 2 * to, 0.0))
        bounds = np.array([np.maximum(0.0, np.maximum(low - distances, distances - high)) for low, high in ranges])
        nearer = bounds[0] <= bounds[1]
        for first, group in ((0, nearer), (1, ~nearer)):
            queries, gaps = asked[group], bounds[:, group]
            for side in (first, 1 - first):
                open_ = self.factor * gaps[side] <= self._reach(queries) + SLACK
                self._visit(sides[side], queries[open_])

    def _leaf(self, members: np.ndarray, asked: np.ndarray) -> None:
        products = self.queries[asked][:, :-1] @ self.points[members][:, :-1].T
        products[self.own[asked][:, None] == self.ids[members][None, :]] = -np.inf
        rows, columns = np.nonzero(products >= self.scores[asked, -1][:, None] - SLACK)
        if not len(rows):
            return
        exact = row_products(self.queries[asked[rows], :-1], self.points[members[columns], :-1])
        exact[np.isneginf(products[rows, columns])] = -np.inf
        hit = np.unique(rows)
        held = np.repeat(hit, self.k)
        rows = np.concatenate([rows, held])
        at = np.concatenate([members[columns], self.best[asked[hit]].ravel()])
        scores = np.concatenate([exact, self.scores[asked[hit]].ravel()])
        order = np.lexsort((np.where(at < 0, 0, self.ids[at]), -scores, rows))
        rows, at, scores = rows[order], at[order], scores[order]
        starts = np.searchsorted(rows, hit)
        take = starts[:, None] + np.arange(self.k)[None, :]
        self.scores[asked[hit]] = scores[take]
        self.best[asked[hit]] = np.where(np.isneginf(scores[take]), -1, at[take])


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, factor: float = FACTOR) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors with the largest inner product for every query.

    Vectors and queries that are null, zero, empty or hold null or non-finite components take no part;
    vectors of another length than the query are no candidates. A row with the query's own key is no
    candidate either. Every vector is indexed. Ties go to the smaller key. Other columns are ignored.

    Vectors are dealt into shards of bounded size by a hash of the key, whatever their values; every
    block of queries meets every shard in a task of its own, which passes on k rows per query.
    """
    def clean(rows: DataFrame) -> DataFrame:
        picked = rows.where(usable(vector) & F.col(key).isNotNull())
        values = picked.select(F.col(key).cast("long").alias("id"), doubles(vector).alias("vector"))
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        return values.withColumn("length", F.size("vector")).withColumn("norm", norm)

    base, asked = stage(clean(vectors), "vectors"), clean(queries)
    groups = base.groupBy("length").agg(F.max("norm").alias("largest"), F.ceil(F.count("*") / F.lit(SHARD_ROWS)).cast("int").alias("shards"))
    blocks = asked.groupBy("length").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("blocks"))
    sizes = stage(groups.join(blocks, "length"), "shards")
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shards = base.drop("norm").join(sizes, "length").withColumn("shard", part("shard", "shards")).withColumn("block", every("blocks"))
    asks = asked.drop("norm").join(sizes, "length").withColumn("block", part("block", "blocks")).withColumn("shard", every("shards"))
    cell = ["length", "shard", "block"]
    shards = shards.select(*cell, "id", "vector", "largest").groupBy(*cell)
    asks = asks.select(*cell, "id", "vector").groupBy(*cell)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _found([], [], [])
        ids, own = left["id"].to_numpy(), right["id"].to_numpy()
        tree = VantageTree(matrix(left["vector"]), left["largest"][0].as_py())
        best, scores = tree.search(matrix(right["vector"]), own, ids, k, factor)
        some = best >= 0
        return _found(np.repeat(own, k)[some.ravel()], ids[best[some]], scores[some])

    found = shards.cogroup(asks).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _found(queries, ids, scores) -> pa.Table:
    return pa.table({"query_id": pa.array(queries, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})
