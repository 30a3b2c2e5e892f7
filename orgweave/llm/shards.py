"""Vectors in shards, queries in blocks: the frame of both searches.

Of equal vectors only as many rows as a result can hold stay candidates, those of the smallest ids, so a vector that is everywhere is no heavy
shard. Candidates are dealt by hash into shards and queries into blocks, both bounded in bytes; each is packed into one row by one task. Every block
meets every group of a few shards in a task of its own, so neither side is ever whole in one place; that is a stated query set against all rows, in
blocks. What is shuffled is the index once for each block and the queries once for each group, so larger blocks mean less of it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Shards that a block meets in one task, unless there are fewer tasks than cores.
GROUP = 4
#: Best scores of each query so far: (whether there is one, score, name), each an array of queries by k.
Best = tuple[np.ndarray, np.ndarray, np.ndarray]


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, embedding, dim) of rows with an id and finite components, with ``nonzero`` at least one of them not zero."""
    v = F.col("embedding")
    ok = v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if nonzero:
        ok = ok & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), F.size(v).alias("dim"))


def few_copies(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` without repeats, and of equal vectors those of the k + 1 smallest ids: a query's own row and k others are all that it can need.

    Both steps reduce before they shuffle, so neither a repeated row nor a vector that many ids share makes a heavy task.
    """
    nth = F.row_number().over(Window.partitionBy("dim", "embedding").orderBy("vec_id"))
    return rows.dropDuplicates(["vec_id", "dim", "embedding"]).withColumn("_nth", nth).where(F.col("_nth") <= k + 1).drop("_nth")


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """(vec_id, embedding, dim): one vector for each id divisible by ``every``; of several the one that sorts first."""
    return rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column, all of one length, as rows."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def nothing(n: int, k: int, kind: type) -> Best:
    return np.zeros((n, k), dtype=bool), np.zeros((n, k), dtype=kind), np.zeros((n, k), dtype=np.int64)


def merge(a: Best, b: Best, k: int) -> Best:
    """The k best of both by score, ties to the smaller name. Integer scores are compared as integers."""
    has, score, who = (np.concatenate([x, y], axis=1) for x, y in zip(a, b))
    falling = ~score if score.dtype.kind == "i" else -score
    order = np.lexsort((who, falling, ~has), axis=-1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (has, score, who))


def part(count: int, *names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(count)).cast("int")


def packed(rows: DataFrame, count: int, make: Callable, name: str, *by: str) -> DataFrame:
    """(dim, part, data): the rows of each dimension dealt into ``count`` parts by a hash; ``make(table)`` is pickled."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([pickle.dumps(make(table))], pa.binary())})

    return materialize(rows.select("*", part(count, *by).alias("part")).groupBy("dim", "part").applyInArrow(run, "dim int, part int, data binary"), name)


def groups_of(spark, n_shards: int, n_blocks: int) -> int:
    return min(n_shards, max(-(-n_shards // GROUP), -(-spark.sparkContext.defaultParallelism // n_blocks)))


def meet(index: DataFrame, blocks: DataFrame, n_groups: int, groups: Callable[[Column], Column], work: Callable, out: str) -> DataFrame:
    """Each block with each of ``groups`` (of its number) of shards: ``work(key, block, shards)`` gives a table of schema ``out``.

    ``shards`` is an iterator in the shards' order.
    """
    left = blocks.select("dim", F.col("part").alias("block"), "data", F.explode(groups(F.col("part"))).alias("grp"))
    wanted = blocks.select(F.col("dim").alias("of_dim"), F.col("part").alias("of_block"), F.explode(groups(F.col("part"))).alias("of_grp"))
    right = index.join(wanted, (F.col("dim") == F.col("of_dim")) & (F.col("part") % n_groups == F.col("of_grp"))).select("of_dim", "of_block", "of_grp", "part", "data")

    def run(key: tuple, queries: pa.Table, shards: pa.Table) -> pa.Table:
        data, order = shards.column("data"), np.argsort(shards.column("part").to_numpy())
        return work(key, pickle.loads(queries.column("data")[0].as_py()), (pickle.loads(data[int(i)].as_py()) for i in order))

    return left.groupBy("dim", "block", "grp").cogroup(right.groupBy("of_dim", "of_block", "of_grp")).applyInArrow(run, out)


def all_groups(n_groups: int) -> Callable[[Column], Column]:
    return lambda _: F.sequence(F.lit(0), F.lit(n_groups - 1))


def first_k(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of each query; the limit is applied before the shuffle as well."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
