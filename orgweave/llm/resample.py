"""Importance resampling towards a target: draw the documents whose words look most like those of a target text collection.

Features are all runs of one to three words, hashed into buckets. Two Arrow passes over the texts do the work. In the first each task
counts its features with ``np.bincount`` into one vector of a number for each bucket, and ``treeReduce`` adds up the tasks' vectors.
A bucket's gain is the logarithm of how much likelier it is in the target than in the source. In the second pass the gains, a broadcast
of one number a bucket, are gathered at the features and summed for each document by a weighted ``np.bincount``. Gumbel noise of a hash of the
document's id is added, so that the highest scores are a sample without replacement in proportion to the weights' exponentials; they
are ranked by ranges, so that no task holds them all.

The buckets are CRC-32 of the features' bytes, for which no feature is put together: the checksum of two strings in a row follows from
the checksums of both and the second's length, by tables.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, give_back, materialize
from .order import numbered

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 42, 5, 20
#: Words up to this many bytes are summed together, longer ones one by one.
_LONG = 64
#: Characters of a block of texts, and words that are hashed at once.
_BLOCK_CHARS, _WORDS = 2_000_000, 500_000


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: what it is in lower case, and whether it is part of a word (digits, letters, everything beyond ASCII)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inner = np.zeros(256, dtype=bool)
    inner[48:58] = inner[97:123] = inner[128:] = True
    return lower, inner[lower]


_LOWER, _INNER = _byte_tables()


@cache
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _images(length: int) -> np.ndarray:
    """(4, 256): what ``length`` zero bytes after a checksum make of each of its bytes; the images of a checksum's bytes are added by exclusive or."""
    # the register of a message with one bit set, before and after zeros, by repeated squaring of the one-byte step
    step = np.array([zlib_step(1 << i) for i in range(32)], dtype=np.uint32)
    out, n = np.array([1 << i for i in range(32)], dtype=np.uint32), length
    while n:
        if n & 1:
            out = _apply(step, out)
        step = _apply(step, step)
        n >>= 1
    return np.stack([_apply(out, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


def zlib_step(register: int) -> int:
    """A zero byte's effect on the checksum's register."""
    return (register >> 8) ^ int(_crc_table()[register & 255])


def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The linear map with the images ``matrix`` of the 32 bits, of each value."""
    out = np.zeros_like(values)
    for i in range(32):
        out ^= np.where(values >> np.uint32(i) & np.uint32(1), matrix[i], np.uint32(0))
    return out


@cache
def _short_images() -> np.ndarray:
    return np.stack([_images(n) for n in range(_LONG + 2)])


def append_crc(head: np.ndarray, tail: np.ndarray, tail_bytes: np.ndarray) -> np.ndarray:
    """The CRC-32 of the concatenations, from those of heads and tails and the tails' lengths."""
    images = _short_images()
    short = np.minimum(tail_bytes, _LONG + 1)
    out = tail.copy()
    for k in range(4):
        out ^= images[short, k, (head >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(tail_bytes > _LONG + 1):
        own = _images(int(tail_bytes[i]))
        out[i] = tail[i] ^ np.bitwise_xor.reduce([own[k, int(head[i]) >> 8 * k & 255] for k in range(4)])
    return out


def _crc_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The CRC-32 of every run of bytes, after the bytes whose register is ``first``: position by position, over the runs that reach so far."""
    table, crc = _crc_table(), np.full(len(starts), first, dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")[::-1]
    start, size, state = starts[order], lengths[order], crc[order]
    ends = np.searchsorted(-size, -np.arange(1, min(int(size[0]) if len(size) else 0, _LONG) + 1), side="right")
    for i, n in enumerate(ends):
        state[:n] = table[(state[:n] ^ data[start[:n] + i]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    crc[order] = state
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > _LONG):
        crc[i] = zlib.crc32(data[starts[i]:starts[i] + lengths[i]].tobytes(), first ^ 0xFFFFFFFF)
    return crc


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a block of texts (null: no words), in slices: (text numbers of the words, buckets of the features, text numbers of the features)."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    # a separator after each text, so that no word runs on into the next one
    joined = pc.binary_join_element_wise(raw, pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    data = _LOWER[np.frombuffer(joined.buffers()[2], dtype=np.uint8, count=int(pc.sum(pc.binary_length(joined)).as_py() or 0))]
    inner = _INNER[data]
    edges = np.flatnonzero(np.diff(inner.view(np.int8), prepend=0, append=0))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    ends_of_texts = np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False))
    space = int(_crc_table()[(0xFFFFFFFF ^ 32) & 255]) ^ (0xFFFFFFFF >> 8)
    for at in range(0, len(starts), _WORDS):
        a = max(0, at - 2)  # the runs that end in this slice begin up to two words before it
        s, n = starts[a:at + _WORDS], lengths[a:at + _WORDS]
        text = np.searchsorted(ends_of_texts, s, side="right")
        alone, spaced = _crc_runs(data, s, n, 0xFFFFFFFF), _crc_runs(data, s, n, space)
        two = append_crc(alone[:-1], spaced[1:], n[1:] + 1)
        three = append_crc(two[:-1], spaced[2:], n[2:] + 1)
        in_two, in_three = text[:-1] == text[1:], text[:-2] == text[2:]
        in_two[:max(0, at - a - 1)] = False  # a pair that ends before the slice was the last one's
        crcs = [alone[at - a:], two[in_two], three[in_three]]
        yield text[at - a:], np.concatenate(crcs) % np.uint32(buckets), np.concatenate([text[at - a:], text[1:][in_two], text[2:][in_three]])


def _blocks_of(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, pa.Array]]:
    column = batch.column(text_col)
    for a, b in blocks(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), _BLOCK_CHARS):
        yield a, column.slice(a, b - a)


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: one vector of each task, merged by ``treeReduce``.

    The vectors are of one size whatever a task reads; what reaches the driver at last is about the cube root of the tasks' number of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in _blocks_of(batch, "text"):
                for _, bucket, _ in features(texts, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = rows.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "counts binary").rdd
    if vectors.getNumPartitions() == 0:
        return np.zeros(buckets, dtype=np.int64)
    add = lambda a, b: (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()
    return np.frombuffer(vectors.map(lambda r: bytes(r[0])).treeReduce(add, depth=3), dtype=np.int64)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) of each bucket, in doubles."""
    n = len(source)
    all_source, all_target = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_source / ((float(s) + 1) * all_target))) for s, t in zip(source, target)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with n_words, n_features and weight, the sum of the gains of a text's features."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value.astype(np.float64)  # sums of whole numbers far below 2^53 are exact
        for batch in batches:
            words, count, weight = np.zeros((3, batch.num_rows))
            for a, texts in _blocks_of(batch, text_col):
                n = len(texts)
                for of_words, bucket, of in features(texts, len(gain)):
                    words[a:a + n] += np.bincount(of_words, minlength=n)
                    count[a:a + n] += np.bincount(of, minlength=n)
                    weight[a:a + n] += np.bincount(of, weights=gain[bucket], minlength=n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x.astype(np.int64)) for x in (words, count, weight))],
                                             names=[*keep, "n_words", "n_features", "weight"])
        give_back()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(sums, f"{kinds}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is 1, 2, 3 ... for those drawn, else null.

    Drawn are floor(percent * N / 100) of the N documents with at least ``least_words`` words, by score, ties to the smaller id.
    A null or empty text and one without words have no features and weight 0; a null id's noise is that of the empty text, and it comes last among ties;
    repeated rows each take part; other columns are not carried, so their names can't clash; an empty table gives no rows, an empty target is one without counts.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(rows, "text", buckets), bucket_counts(target, target_col, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    scored = weigh(rows, gains, ["doc_id"]).withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((noise + 0.5) / 4294967296.0))))
    # written before it is numbered: choosing the ranges reads it first
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "weighed")
    eligible = F.col("n_words") >= least_words
    ranked, n = numbered(scored, [eligible.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], eligible)
    drawn = F.when(eligible & (F.col("position") < percent * n // 100), F.col("position") + 1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", drawn.alias("rank"))
