"""Approximate nearest neighbours by score-aware (anisotropic) quantisation.

For maximum inner product the part of a vector's residual that is parallel to the vector matters more than the rest, so codewords
are learned and assigned under a loss that weighs it more. What is quantised is a vector's direction less the directions' mean; its length is kept beside the code, so neither
rows of very different length nor a part that all rows share takes codewords. Each component has 16 codewords, four bits. A query's inner products with all
codewords are tables; two four-bit tables are joined to one of 256 entries, and a scan adds up table entries for each vector, adds the mean's and multiplies by the length.
The best of the scan are reranked by their exact inner products.

The codebook is fitted on the driver over a bounded sample of the vectors; every vector is indexed, in shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .shards import Best, all_groups, few_copies, first_k, groups_of, matrix, meet, merge, nothing, packed, part, queries_of, usable

#: Components of a subspace (pairs lose tight clusters and weak components), codewords, the cosine from which scores matter, candidates of a query that are reranked.
WIDTH, WORDS, THRESHOLD, RERANK = 1, 16, 0.2, 400
#: The fit's sample of a dimension: vectors, and bytes.
SAMPLE, SAMPLE_BYTES = 16_384, 32 << 20


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' lengths, and the rows divided by them; components of any size."""
    most = np.maximum(np.abs(x).max(1, initial=0), 1e-300)[:, None]
    length = np.maximum(np.sqrt(((x / most) ** 2).sum(1)), 1e-300)[:, None]
    return (most * length)[:, 0], x / most / length


class Quantizer:
    """Codebooks (subspaces x words x width) under the loss |r|^2 + weight (r x/|x|)^2 of a residual r."""

    def __init__(self, dim: int, width: int = WIDTH, words: int = WORDS, threshold: float = THRESHOLD) -> None:
        self.dim, self.width, self.words = dim, width, words
        self.spaces = -(-dim // width)
        self.spaces += self.spaces % 2  # they are scanned in pairs
        self.weight = max(0.0, (dim - 1) * threshold**2 / (1 - threshold**2) - 1)
        self.books = np.zeros((self.spaces, words, width))
        self.mean = np.zeros(dim)

    def parts(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.spaces * self.width))
        out[:, :self.dim] = x
        return out.reshape(len(x), self.spaces, self.width)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent: from the nearest codewords, each subspace in turn takes the word of the least loss given the others."""
        p = self.parts(x)
        u = p / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None, None]
        codes = np.empty((len(x), self.spaces), dtype=np.uint8)
        rows = np.arange(len(x))
        along = np.empty((len(x), self.spaces))
        for m in range(self.spaces):
            codes[:, m] = ((p[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1)
            along[:, m] = ((p[:, m] - self.books[m][codes[:, m]]) * u[:, m]).sum(1)
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(self.spaces):
                r = p[:, m, None] - self.books[m]
                parallel = np.einsum("nwk,nk->nw", r, u[:, m])
                loss = (r * r).sum(2) + self.weight * (total[:, None] - along[:, m, None] + parallel) ** 2
                codes[:, m] = loss.argmin(1)
                new = parallel[rows, codes[:, m]]
                total += new - along[:, m]
                along[:, m] = new
        return codes

    def fit(self, x: np.ndarray, rounds: int = 6, seed: int = 13) -> "Quantizer":
        rng = np.random.default_rng(seed)
        if not len(x):
            return self
        p = self.parts(x)
        u = p / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None, None]
        for m in range(self.spaces):
            self.books[m] = p[rng.choice(len(x), self.words, replace=len(x) < self.words), m]
            for _ in range(4):  # plain k-means to start from
                near = ((p[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1)
                n = np.bincount(near, minlength=self.words)
                sums = np.stack([np.bincount(near, p[:, m, j], self.words) for j in range(self.width)], 1)
                self.books[m][n > 0] = (sums / np.maximum(n, 1)[:, None])[n > 0]
        for _ in range(rounds):
            codes = self.encode(x, 1)
            along = np.stack([((p[:, m] - self.books[m][codes[:, m]]) * u[:, m]).sum(1) for m in range(self.spaces)], 1)
            total = along.sum(1)
            for m in range(self.spaces):
                rest = total - along[:, m]
                for w in range(self.words):  # the codeword of least loss for its vectors: a small linear system
                    at = codes[:, m] == w
                    if at.any():
                        um, pm = u[at, m], p[at, m]
                        left = at.sum() * np.eye(self.width) + self.weight * um.T @ um
                        right = pm.sum(0) + self.weight * (um * (rest[at] + (pm * um).sum(1))[:, None]).sum(0)
                        self.books[m, w] = np.linalg.solve(left + 1e-9 * np.eye(self.width), right)
                along[:, m] = ((p[:, m] - self.books[m][codes[:, m]]) * u[:, m]).sum(1)
                total = rest + along[:, m]
        return self

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For every query and pair of subspaces the 256 sums of two table entries."""
        one = np.einsum("qmk,mwk->qmw", self.parts(q), self.books).astype(np.float32)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), self.spaces // 2, -1)


def build(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard: the names of its vectors, their packed codes and their lengths."""
    names, codes = table.column("name").to_numpy(), table.column("code").combine_chunks()
    rows = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint8).reshape(len(names), -1)
    return names, rows[:, :-8].copy(), rows[:, -8:].copy().view(np.float64)[:, 0]


def scan(quantizer: Quantizer, shard: tuple, x: np.ndarray, keep: int, block: int = 64) -> Best:
    """The ``keep`` vectors of a shard with the largest inner products by their codes for each query; a query's scores are in its own unit."""
    names, packed_codes, lengths = shard
    some = min(keep, len(names))
    has, score, who = nothing(len(x), keep, np.float64)
    columns = [packed_codes[:, j].astype(np.intp) for j in range(packed_codes.shape[1])]
    for a in range(0, len(x), block):
        _, q = directions(x[a:a + block])
        tables = quantizer.tables(q)
        near = np.zeros((len(tables), len(names)), dtype=np.float32)
        for j, column in enumerate(columns):
            near += tables[:, j].take(column, axis=1)
        near = (near + (q @ quantizer.mean)[:, None]) * lengths
        chosen = np.argpartition(-near, some - 1, axis=1)[:, :some]
        score[a:a + block, :some] = np.take_along_axis(near, chosen, 1)
        who[a:a + block, :some], has[a:a + block, :some] = names[chosen], True
    return has, score, who


def coded(members: DataFrame, quantizers: dict[int, Quantizer]) -> DataFrame:
    """(dim, name, code) of members (dim, name, embedding, ids): two four-bit words in a byte, then the length. Rows are coded where they stand."""
    shared = members.sparkSession.sparkContext.broadcast(quantizers)  # 16 words for each component

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                quantizer = shared.value[int(dim)]
                lengths, u = directions(matrix(pa.chunked_array([rows.column("embedding")])).astype(np.float64))
                codes = quantizer.encode(u - quantizer.mean)
                both = codes[:, 0::2] * WORDS + codes[:, 1::2]
                yield pa.RecordBatch.from_arrays([rows.column("dim"), rows.column("name"), pa.array([r.tobytes() + l.tobytes() for r, l in zip(both, lengths)], pa.binary())], names=["dim", "name", "code"])

    return members.select("dim", "name", "embedding").mapInArrow(run, "dim int, name long, code binary")


def rerank(pairs: DataFrame, queries: DataFrame, members: DataFrame, n_blocks: int, n_parts: int) -> DataFrame:
    """(query_id, vec_id, score): exact inner products of the pairs (query_id, name), for each of a vector's ids but the query's own.

    A vector is sent once to each block of queries that has it as a candidate, and a block's candidates are dealt into ``n_parts``.
    """
    held = pairs.select(part(n_blocks, "query_id").alias("block"), part(n_parts, "name").alias("grp"), "query_id", "name")
    wanted = held.select("block", "grp", "name").distinct().join(members, "name").select(F.col("block").alias("of_block"), F.col("grp").alias("of_grp"), "dim", F.col("name").alias("of"), "embedding", "ids")
    asked = queries.select(part(n_blocks, "vec_id").alias("of_block"), F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("of_grp"), "dim", F.col("vec_id").alias("of"), "embedding",
                           F.lit(None).cast("array<long>").alias("ids"))

    def run(key: tuple, some: pa.Table, vectors: pa.Table) -> pa.Table:
        out = []
        for dim in pc.unique(vectors.column("dim")).to_pylist():
            of_dim = vectors.filter(pc.equal(vectors.column("dim"), dim))
            is_query = pc.is_null(of_dim.column("ids"))
            ask, have = of_dim.filter(is_query).sort_by("of"), of_dim.filter(pc.invert(is_query)).sort_by("of")
            if not ask.num_rows or not have.num_rows:
                continue
            q_names, x_names = ask.column("of").to_numpy(), have.column("of").to_numpy()
            q, x, ids = matrix(ask.column("embedding")), matrix(have.column("embedding")), have.column("ids").combine_chunks()
            query, name = some.column("query_id").to_numpy(), some.column("name").to_numpy()
            i, j = (np.minimum(np.searchsorted(names, want), len(names) - 1) for names, want in ((q_names, query), (x_names, name)))
            ok = (q_names[i] == query) & (x_names[j] == name)
            i, j = i[ok], j[ok]
            score = np.concatenate([np.empty(0), *(np.einsum("nd,nd->n", q[i[a:a + 8192]].astype(np.float64), x[j[a:a + 8192]].astype(np.float64)) for a in range(0, len(i), 8192))])
            out.append(pa.table({"query_id": q_names[i], "ids": ids.take(pa.array(j)), "score": score}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})

    scored = held.groupBy("block", "grp").cogroup(wanted.unionByName(asked).groupBy("of_block", "of_grp")).applyInArrow(run, "query_id long, ids array<long>, score double")
    return scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")


def fit(rows: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> dict[int, Quantizer]:
    """A quantizer for each dimension, fitted on at most ``sample_bytes`` of its vectors, one dimension after the other."""
    out = {}
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):
        slot = F.pmod(F.xxhash64("embedding"), F.lit(max(WORDS, min(SAMPLE, sample_bytes // (8 * dim)))))
        chosen = rows.where(F.col("dim") == dim).groupBy(slot.alias("slot")).agg(F.min("embedding").alias("embedding")).select("embedding").toArrow()
        x = matrix(chosen.column("embedding")).astype(np.float64) if chosen.num_rows else np.empty((0, dim))
        out[dim] = Quantizer(dim)
        if len(x):
            _, u = directions(x[np.lexsort(x.T[::-1])])
            out[dim].mean = u.mean(0)
            out[dim].fit(u - out[dim].mean)
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, keep: int = RERANK, shard_bytes: int = 2 << 20, block_bytes: int = 4 << 20,
            rerank_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query, exact scores, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor rows without an id; vectors of different dimension are
    not compared. Repeated rows count once; rows that share an id with different vectors are candidates each, and for an id that is divisible by
    ``every`` the vector that sorts first asks. Equal vectors are coded once and share their place. Other columns are ignored. An empty table
    gives no rows. Blocks meet codes alone; the vectors of the ``keep`` best of a query's scan are sent to its block and reranked.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, True)
    quantizers = fit(rows)
    members = few_copies(rows, k).groupBy("dim", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    members = materialize(members.withColumn("name", F.xxhash64("embedding")), "members")
    queries = queries_of(rows, every)
    n, total = members.agg(F.sum(16 + F.col("dim") / 2), F.sum("dim")).first()
    n_queries = queries.agg(F.sum(8 * F.col("dim"))).first()[0]
    n_shards, n_blocks = max(1, math.ceil((n or 0) / shard_bytes)), max(1, math.ceil((n_queries or 0) / block_bytes))
    n_groups = groups_of(spark, n_shards, n_blocks)
    index = packed(coded(members, quantizers), n_shards, build, "index", "name")
    blocks = packed(queries, n_blocks, lambda t: (t.column("vec_id").to_numpy(), matrix(t.column("embedding")).astype(np.float64)), "blocks", "vec_id")
    shared = spark.sparkContext.broadcast(quantizers)

    def candidates(key: tuple, block: tuple, shards: Iterator[tuple]) -> pa.Table:
        ids, x = block
        best = nothing(len(ids), keep, np.float64)
        for shard in shards:
            best = merge(best, scan(shared.value[key[0].as_py()], shard, x, keep), keep)
        has, score, who = best
        return pa.table({"query_id": np.repeat(ids, has.sum(1)), "vec_id": who[has], "score": score[has]})

    found = meet(index, blocks, n_groups, all_groups(n_groups), candidates, "query_id long, vec_id long, score double")
    pairs = materialize(first_k(found, keep).select("query_id", F.col("vec_id").alias("name")), "pairs")
    # what a block's candidates may weigh: all vectors, or as many as its queries can name
    most = min(8 * (total or 0), keep * block_bytes)
    return first_k(rerank(pairs, queries, members, n_blocks, max(1, math.ceil(most / rerank_bytes))), k)
