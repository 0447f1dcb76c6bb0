"""Approximate nearest neighbours by inner product with vantage-point trees per shard (operator 9).

Inner products become distances by one more coordinate: with M at least every norm, a vector x becomes
(x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0), and |q' - x'|^2 = |q|^2 + M^2 - 2 q.x falls as q.x
rises. Vectors are dealt to shards by hash, each shard builds a vantage-point tree, and blocks of queries
descend it together. A subtree is left out when the triangle inequality shows that it is farther than
``factor`` times the k-th best distance so far; factor one is exact, smaller ones leave out more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


K = 20
LEAF = 256
#: Rows of a shard and queries of a block, on average: what one task holds. Documented bounds.
SHARD_ROWS = 4096
BLOCK_ROWS = 8192
FACTOR = 0.9


def usable(vector: str) -> Column:
    """Vectors that take part: not null, not empty, all components finite, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


class Tree:
    """A vantage-point tree over distinct rows of ``points``; every node and leaf is a range of ``order``."""

    def __init__(self, points: np.ndarray, seed: int = 7):
        self.points, self.random = points, np.random.default_rng(seed)
        self.root = self.build(np.arange(len(points)))

    def build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        at = int(self.random.integers(len(rows)))
        vantage, rest = rows[at], np.delete(rows, at)
        far = np.sqrt(np.maximum(0, ((self.points[rest] - self.points[vantage]) ** 2).sum(1)))
        middle = np.median(far)
        near = far <= middle
        if near.all():  # all at one distance: nothing to tell apart
            return rows
        inner, outer = rest[near], rest[~near]
        return (vantage, middle, far[near].max(), far[~near].min(), self.build(inner), self.build(outer))

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and rows of the ``k`` nearest points of each query, -1 where there are fewer."""
        best = np.full((len(queries), k), np.inf)
        which = np.full((len(queries), k), -1)
        norms = (self.points ** 2).sum(1)
        asked = (queries ** 2).sum(1)

        def offer(ask: np.ndarray, rows: np.ndarray) -> None:
            far = asked[ask, None] + norms[rows][None] - 2 * queries[ask] @ self.points[rows].T
            closer = (far < best[ask, -1][:, None]).any(1)
            if not closer.any():
                return
            ask, far = ask[closer], far[closer]
            if far.shape[1] > k:
                pick = np.argpartition(far, k - 1, 1)[:, :k]
                far, given = np.take_along_axis(far, pick, 1), rows[pick]
            else:
                given = np.broadcast_to(rows, far.shape)
            both, from_ = np.concatenate([best[ask], far], 1), np.concatenate([which[ask], given], 1)
            pick = np.argsort(both, 1, kind="stable")[:, :k]
            best[ask], which[ask] = np.take_along_axis(both, pick, 1), np.take_along_axis(from_, pick, 1)

        def visit(node, ask: np.ndarray) -> None:
            if not len(ask):
                return
            if isinstance(node, np.ndarray):
                return offer(ask, node)
            vantage, middle, inner_most, outer_least, inner, outer = node
            offer(ask, np.array([vantage]))
            far = np.sqrt(np.maximum(0, asked[ask] + norms[vantage] - 2 * queries[ask] @ self.points[vantage]))
            inside = far <= middle
            visit(inner, ask[inside])
            visit(outer, ask[~inside])
            reach = factor * np.sqrt(np.maximum(0, best[ask, -1])) + 1e-9
            visit(outer, ask[inside & (outer_least - far <= reach)])
            reach = factor * np.sqrt(np.maximum(0, best[ask, -1])) + 1e-9
            visit(inner, ask[~inside & (far - inner_most <= reach)])

        visit(self.root, np.arange(len(queries)))
        return best, which


def scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products, component after component, so equal vectors always get equal scores."""
    total = np.zeros(np.broadcast_shapes(queries.shape[:-1], points.shape[:-1]))
    for j in range(queries.shape[-1]):
        total += queries[..., j] * points[..., j]
    return total


def nearest_in_shard(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
                     largest: float, k: int, factor: float) -> pd.DataFrame:
    """Up to ``k`` best rows of one shard for each query, ties to the smaller id.

    Equal vectors are one point of the tree with their ids in order. One more point than ``k`` is asked
    for, since the query's own row is among them.
    """
    order = np.argsort(ids, kind="stable")
    points, ids = points[order], ids[order]
    distinct, inverse = np.unique(points, axis=0, return_inverse=True)
    by_point = np.argsort(inverse.ravel(), kind="stable")
    firsts = np.searchsorted(inverse.ravel()[by_point], np.arange(len(distinct) + 1))
    lift = np.sqrt(np.maximum(0, largest ** 2 - (distinct ** 2).sum(1)))
    tree = Tree(np.column_stack([distinct, lift]))
    _, which = tree.search(np.column_stack([queries, np.zeros(len(queries))]), k + 1, factor)
    ask, column = np.nonzero(which >= 0)
    hit = which[ask, column]
    score = scores(queries[ask], distinct[hit])
    many = np.minimum(firsts[hit + 1] - firsts[hit], k + 1)
    row = np.repeat(np.arange(len(hit)), many)
    step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    out = pd.DataFrame({"query_id": query_ids[ask[row]], "vec_id": ids[by_point[firsts[hit[row]] + step]], "score": score[row]})
    out = out[out.query_id != out.vec_id].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out[out.groupby("query_id").cumcount() < k]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, vector: str = "embedding",
           shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best of ``vectors`` (vec_id, ``vector``) for each of
    ``queries`` (same columns), best first, ties to the smaller vec_id.

    Rows without an id and vectors that are null, empty, zero, of another length than most, or hold null
    or non-finite components take no part. A row with the query's own vec_id is never its neighbour; a
    repeated query_id is asked once. More columns are dropped; an empty table gives no rows. Each block of
    queries meets each shard once, and of what shards find ``k`` rows a query are kept.
    """
    def clean(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("vec_id").isNotNull() & usable(vector)).select(
            F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))

    points = clean(vectors)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    size = points.agg(F.count("*").alias("n"), F.max(length).alias("norm"), F.mode(F.size("v"), True).alias("width")).head()
    asked = clean(queries).dropDuplicates(["vec_id"]).where(F.size("v") == F.lit(size["width"]))
    points = points.where(F.size("v") == F.lit(size["width"]))
    n_shards = -(-size["n"] // shard_rows) or 1
    n_blocks = -(-asked.count() // block_rows) or 1
    largest = float(size["norm"] or 0) * (1 + 1e-12)
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    # Repeats of a vector have ids of their own and so spread over the shards.
    left = points.withColumn("shard", salt).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = asked.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    schema = "query_id bigint, vec_id bigint, score double"

    def solve(shard: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "i8", "vec_id": "i8"})
        return nearest_in_shard(np.stack(shard.v), shard.vec_id.to_numpy(), np.stack(ask.v), ask.vec_id.to_numpy(),
                                largest, k, factor)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(solve, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
