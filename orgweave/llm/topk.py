"""Exact top-k by inner product: ball-tree branch and bound in each shard.

Every component becomes floor(64 x), and inner products of these integers are exact at any size. A shard's vectors
are split by the median of their widest direction into a tree of balls. For a query q no vector of a ball with centre c and radius r
scores more than q c + |q| r. Balls are visited from the highest bound down, and a ball is left out for the queries whose
kth score so far is above its bound; that score is shared among shards.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .shards import Best, all_groups, few_copies, first_k, groups_of, matrix, meet, merge, nothing, packed, queries_of, usable

LEAF, SCALE = 128, 64


class BallTree:
    """Nodes level by level: parents, centres, radii; the leaves' rows are consecutive."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, leaf: int = LEAF) -> None:
        x = whole.astype(np.float64)
        order, spans = np.arange(len(x)), [(0, len(x))]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        parents = [0]
        while True:
            centres = np.stack([x[order[a:b]].mean(0) for a, b in spans])
            radii = np.array([np.sqrt(((x[order[a:b]] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, centres)])
            self.levels.append((np.array(parents), centres, radii))
            if all(b - a <= leaf for a, b in spans):
                break
            parents, new = [], []
            for node, (a, b) in enumerate(spans):
                if b - a <= leaf:
                    parents.append(node)
                    new.append((a, b))
                    continue
                part = x[order[a:b]]
                away = part[((part - centres[node]) ** 2).sum(1).argmax()] - centres[node]
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part @ away, mid)]
                parents += [node, node]
                new += [(a, a + mid), (a + mid, b)]
            spans = new
        self.spans, self.ids, self.x = spans, ids[order], whole[order]

    def leaf_bounds(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Upper bounds of every leaf for every query; -inf below a ball that a query has left out."""
        size, open_ = np.sqrt((q * q).sum(1))[:, None], np.ones((len(q), 1), dtype=bool)
        for parents, centres, radii in self.levels:
            bound = q @ centres.T + size * radii
            bound += 1e-9 * size * (np.sqrt((centres * centres).sum(1)) + radii) + 1e-6  # the bound itself is rounded
            bound[~open_[:, parents]] = -np.inf
            open_ = bound >= kth[:, None]
        return bound


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors as 64-bit integers, exact; those over the range of a long are held to it.

    Up to 2^53 doubles are exact and fast, up to 2^63 64-bit integers are, and beyond Python's own integers.
    """
    most = max(int(q.max()), -int(q.min())) * max(int(x.max()), -int(x.min())) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return q @ x.T
    whole = q.astype(object) @ x.astype(object).T
    return np.array([[min(max(int(v), -(2**63)), 2**63 - 1) for v in row] for row in whole], dtype=np.int64).reshape(len(q), len(x))


def build(table: pa.Table) -> BallTree:
    return BallTree(table.column("vec_id").to_numpy(), matrix(table.column("embedding")))


def find(tree: BallTree, ids: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray) -> Best:
    """The best k of the tree's vectors for each query, given lower bounds of the kth scores (doubles, never above the true ones)."""
    best = nothing(len(x), k, np.int64)
    upper, kth = tree.leaf_bounds(x.astype(np.float64), bound), bound.copy()

    def visit(rows: np.ndarray, leaf: int) -> None:
        a, b = tree.spans[leaf]
        score = products(x[rows], tree.x[a:b])
        other = tree.ids[a:b][None, :] != ids[rows][:, None]
        gain = (other & (score.astype(np.float64) >= kth[rows, None])).any(1)
        if gain.any():
            rows = rows[gain]
            new = merge(tuple(m[rows] for m in best), (other[gain], score[gain], np.broadcast_to(tree.ids[a:b], (len(rows), b - a))), k)
            for old, m in zip(best, new):
                old[rows] = m
            kth[rows] = np.maximum(kth[rows], kth_bound(new))

    first = upper.argmax(1)
    for leaf in np.unique(first):
        rows = np.flatnonzero((first == leaf) & (upper[:, leaf] >= kth))
        if len(rows):
            visit(rows, leaf)
    upper[np.arange(len(x)), first] = -np.inf
    for leaf in np.argsort(-upper.max(0)):
        rows = np.flatnonzero((upper[:, leaf] >= kth) & (upper[:, leaf] > -np.inf))
        if len(rows):
            visit(rows, leaf)
    return best


def kth_bound(best: Best) -> np.ndarray:
    """The kth score of each query as a double that is not above it; -inf where there are fewer."""
    return np.where(best[0][:, -1], np.nextafter(best[1][:, -1].astype(np.float64), -np.inf), -np.inf)


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, shard_bytes: int = 4 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to the smaller id.

    Vectors that are null or hold null or non-finite components take no part, nor rows without an id; vectors of different
    dimension are not compared. Repeated rows count once; rows that share an id with different vectors are candidates each, and for an id that is
    divisible by ``every`` the vector that sorts first asks. Fewer candidates than k give fewer rows, an empty table none. Components and scores
    over the range of a long are held to it. Other columns are ignored.
    """
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(9.223372036854774e18)), F.lit(-9.223372036854774e18))))
    rows = usable(vectors, False).withColumn("embedding", whole)
    is_query = F.col("vec_id") % every == 0
    n, n_queries = rows.agg(F.sum("dim"), F.sum(F.when(is_query, F.col("dim")))).first()
    n_shards, n_blocks = max(1, -(-8 * (n or 0) // shard_bytes)), max(1, -(-8 * (n_queries or 0) // block_bytes))
    n_groups = groups_of(spark, n_shards, n_blocks)
    index = packed(few_copies(rows, k), n_shards, build, "index", "vec_id")
    blocks = packed(queries_of(rows, every), n_blocks, lambda t: (t.column("vec_id").to_numpy(), matrix(t.column("embedding")), None), "blocks", "vec_id")

    def look(block: tuple, shards: Iterator[BallTree]) -> Best:
        ids, x, bound = block
        bound, best = np.full(len(ids), -np.inf) if bound is None else bound, nothing(len(ids), k, np.int64)
        for tree in shards:
            best = merge(best, find(tree, ids, x, k, bound), k)
            bound = np.maximum(bound, kth_bound(best))
        return best

    def bounds(key: tuple, block: tuple, shards: Iterator[BallTree]) -> pa.Table:
        data = pickle.dumps((*block[:2], kth_bound(look(block, shards))))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    def hits(key: tuple, block: tuple, shards: Iterator[BallTree]) -> pa.Table:
        has, score, who = look(block, shards)
        return pa.table({"query_id": np.repeat(block[0], has.sum(1)), "vec_id": who[has], "score": score[has]})

    if n_groups > 1:
        # what a block finds in one group is the bound with which it starts in all others
        blocks = materialize(meet(index, blocks, n_groups, lambda b: F.array(b % n_groups), bounds, "dim int, part int, data binary"), "blocks")
    return first_k(meet(index, blocks, n_groups, all_groups(n_groups), hits, "query_id long, vec_id long, score long"), k)
