"""Best-fit packing of token sequences by minimum bin slack.

A document is its token ids and an end id; only longer ones are cut into pieces of the capacity. Which lengths stand
together depends on the number of pieces of each length alone, a histogram of at most ``capacity`` rows. On it the
driver runs minimum bin slack: for each bin, anchored at the longest length left, a bitset subset-sum dynamic
programme over the available lengths finds the fullest feasible combination, which is then removed, as many times
at once as the counts allow. Each removal leaves one of its lengths short, so there are at most
sum(capacity / length) patterns, whatever the corpus. Spark numbers the pieces of each length, in salted groups so
that a frequent length is split among tasks, and each piece finds its bin and place from its number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary, encoder
from .common import map_texts, materialize

#: The salted groups of a length; numbering a length that holds every row still spreads over as many tasks.
SALTS = 1024

#: Characters that a task tokenizes at a time; what is laid out for them stays beside an executor's heap.
BLOCK_CHARS = 1_000_000


def cut_pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) for every piece of every whole text; null texts count as empty.

    Write it before it is used: the salt follows from a row's place.
    """
    path = path or default_vocabulary()

    def start():
        enc = encoder(path)
        end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

        def work(texts: list[str]) -> dict:
            take, rows = [], []
            for i, raw in enumerate(enc.encode_words([t or "" for t in texts])):
                raw += end
                for at in range(0, len(raw), step):
                    part = raw[at:at + step]
                    take.append(i)
                    rows.append((at // step, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = np.array(rows, dtype=np.int64).T
            return {"take": take, "columns": [columns[0].astype(np.int32), *columns[1:]]}

        return work

    pieces = map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], start,
                       "piece int, start long, length long, ids_crc32 long", block_chars=BLOCK_CHARS)
    # by the row's number, so that equal rows are dealt out too; the pieces are written before the salt is used
    return pieces.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination of the available lengths with the largest sum up to ``room``, larger lengths first.

    ``reach`` is a bitset: bit s says that sum s can be had. Copies of a length are taken in binary portions.
    """
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        copies = min(counts[length], room // length)
        portion = 1
        while copies > 0:
            take = min(portion, copies)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            copies -= take
            portion *= 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, copies in a bin, first bin, offset of the first copy), sorted; the number of bins."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(counts, reverse=True)
    taken = dict.fromkeys(counts, 0)
    rows, bins = [], 0
    while lengths:
        anchor = lengths[0]
        counts[anchor] -= 1
        pattern = fullest(counts, lengths, capacity - anchor)
        counts[anchor] += 1
        pattern[anchor] = pattern.get(anchor, 0) + 1
        times = min(counts[n] // m for n, m in pattern.items())
        offset = 0
        for n in sorted(pattern, reverse=True):
            m = pattern[n]
            rows.append((n, taken[n], m, bins, offset))
            taken[n] += m * times
            counts[n] -= m * times
            offset += n * m
        bins += times
        if any(counts[n] == 0 for n in pattern):
            lengths = [n for n in lengths if counts[n]]
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), bins


def place_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give each piece of ``cut_pieces``, as written, its ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    totals = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    plan, _ = plan_bins({r["length"]: r["n"] for r in totals}, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (pieces.join(bases, ["length", "salt"])
              .withColumn("rank", F.col("base") + F.row_number().over(within) - 1))
    shared = spark.sparkContext.broadcast(plan)  # bounded by the capacity, see above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, copies, bin0, offset = shared.value.T
        span = 1 << 44
        keys = length * span + first
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, n * span + rank, side="right") - 1
            r = rank - first[k]
            placed = [bin0[k] + r // copies[k], offset[k] + (r % copies[k]) * n]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, placed)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens: one row per piece.

    Null and empty texts are a piece of the end id alone. Repeated rows are packed as often as they occur; rows that are
    equal take any of their places. Null ids are kept, extra columns left out; an empty table gives no rows. Texts are
    tokenized once: the pieces, a few numbers each, are written to the shared folder.
    """
    pieces = materialize(cut_pieces(docs, capacity, end_id, path, id_col, text_col), "pieces")
    return place_pieces(pieces, capacity)
