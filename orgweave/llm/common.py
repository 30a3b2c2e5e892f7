"""Shared helpers of the corpus operators: shared-folder tables, bounded samples, text blocks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize, shared_dir

__all__ = ["blocks", "crc_mod", "discard", "filter_texts", "free_name", "held", "labelled_texts", "let_go", "map_texts", "materialize", "sample_ids", "shared_dir"]


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever its columns are called."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(n)


def sample_ids(labelled: DataFrame, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """At most ``per_label`` ids of each label: of every hash slot the smallest id.

    One map-side-combined aggregation; which rows are taken depends on the ids alone, not on partitioning.
    """
    slot = F.pmod(F.xxhash64(id_col), F.lit(per_label))
    return (labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(label_col).alias("label"), slot.alias("slot")).agg(F.min(id_col).alias("sample_id"))
            .select("sample_id", "label"))


def labelled_texts(docs: DataFrame, chosen: DataFrame, max_chars: int,
                   id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, object]]:
    """(text, label) of the chosen ids, for fitting on the driver.

    ``chosen`` is bounded by ``per_label`` times the number of labels, so it may be broadcast and its texts
    collected; texts over ``max_chars`` are left out of the fit, which bounds the driver's memory.
    """
    rows = (docs.where(F.length(text_col).between(1, max_chars))
            .join(F.broadcast(chosen), F.col(id_col) == F.col("sample_id"))
            .select("sample_id", F.col(text_col).alias("text"), "label").collect())
    first: dict = {}
    for r in sorted(rows, key=lambda r: (r["sample_id"], str(r["label"]), r["text"])):
        first.setdefault(r["sample_id"], (r["text"], r["label"]))
    return list(first.values())


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What an operator keeps in its Python worker from task to task. A worker serves many operators, so only the last one's is kept."""
    if name not in _HELD:
        let_go()
        _HELD[name] = make()
    return _HELD[name]


def let_go() -> None:
    """Drop what other operators' tasks have left in this worker."""
    _HELD.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker stays alive between tasks, beside an executor with a bound for both."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) whose sizes sum to ``most`` at most; a larger single item stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(rows: DataFrame, keep: list[str], start: Callable[[], Callable[[list[str]], list]], fields: str,
              text_col: str = "text", block_chars: int = 4_000_000, least_chars: int = 0) -> DataFrame:
    """Columns ``keep`` of ``rows`` as they are, beside what a function makes of the texts, where the rows stand.

    ``start()`` runs once in a task and gives the function; that takes a block of texts (null as None) and returns one list of values
    for each of ``fields`` (a schema string); a text counts as ``least_chars`` at least, which bounds a block's number of texts, or, where it repeats rows, a dict of
    ``take`` (row numbers) and ``columns``.
    """
    names = [f.strip().rpartition(" ")[0] for f in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            column = batch.column(text_col)
            sizes = pc.max_element_wise(pc.fill_null(pc.utf8_length(column), 0), least_chars).to_pylist()
            for a, b in blocks(sizes, block_chars):
                made = work(column.slice(a, b - a).to_pylist())
                kept = batch.select(keep).slice(a, b - a)
                if isinstance(made, dict):
                    kept, made = kept.take(pa.array(made["take"], pa.int64())), made["columns"]
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v) for v in made)], names=[*keep, *names])
        del work
        give_back()

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, f"{kinds}, {fields}")


def filter_texts(rows: DataFrame, start: Callable[[], Callable[[list[str]], list[bool]]], text_col: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """The rows, all their columns, for whose text the function says true; as ``map_texts`` otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            column = batch.column(text_col)
            for a, b in blocks(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), block_chars):
                yield batch.slice(a, b - a).filter(pa.array(work(column.slice(a, b - a).to_pylist()), pa.bool_()))
        del work
        give_back()

    return rows.mapInArrow(run, rows.schema)
