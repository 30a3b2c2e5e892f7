"""All matches of many patterns with their places, in one Arrow pass over the texts.

A pattern is compiled once in a task, a text is read once for all patterns, and what stands around a match is cut out by its offsets. ``scanned`` is a
column of matches, ``regex_hits`` a table of them. Both are mapped where the rows stand, without a shuffle. Within lambda functions, where no
Python runs, ``extract.matches`` gives the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regex import SPACE, rewritten, text

_CODE = re.compile(r"\\x\{([0-9A-Fa-f]+)\}")
_HIT = pa.struct([("start", pa.int32()), ("match", pa.string()), ("g1", pa.string()), ("g2", pa.string()), ("g3", pa.string()), ("window", pa.string())])
_HIT_SQL = "array<struct<start:int,match:string,g1:string,g2:string,g3:string,window:string>>"


def compiled(pattern: str, ignore_case: bool = True) -> re.Pattern:
    """A pattern as ``regex.rx`` means it: ASCII word edges and cases, white space of any kind."""
    return re.compile(_CODE.sub(lambda m: re.escape(chr(int(m[1], 16))), rewritten(pattern, r"\b", SPACE)), re.ASCII | (re.IGNORECASE if ignore_case else 0))


def _hits(t: str, patterns: list[re.Pattern], before: int, after: int) -> Iterator[tuple[int, re.Match, str]]:
    for k, p in enumerate(patterns):
        for m in p.finditer(t):
            yield k, m, t[max(0, m.start() - before):m.end() + after]


def scanned(c: Column, patterns: tuple[str, ...], before: int, after: int, ignore_case: bool = True, needs: tuple[str, ...] = ()) -> Column:
    """Every match of each pattern in turn: structs (start, match, g1, g2, g3, window), groups that don't take part as empty texts; a null text counts as empty.

    ``needs`` are words in small letters one of which each pattern's match holds; a text without any is not searched.
    """

    @F.arrow_udf(_HIT_SQL)
    def find(texts: pa.Array) -> pa.Array:
        ready = [compiled(p, ignore_case) for p in patterns]
        out = []
        for t in texts.to_pylist():
            rows = []
            if t and (not needs or any(w in low for low in (t.lower(),) for w in needs)):
                for _, m, window in _hits(t, ready, before, after):
                    groups = [g or "" for g in m.groups()[:3]]
                    rows.append((m.start(), m[0], *groups, *[""] * (3 - len(groups)), window))
            out.append([dict(zip(("start", "match", "g1", "g2", "g3", "window"), r)) for r in rows])
        return pa.array(out, pa.list_(_HIT))

    return find(text(c))


def regex_hits(rows: DataFrame, patterns: dict[str, str], keep: list[str], text_col: str = "text", before: int = 0, after: int = 0, ignore_case: bool = False) -> DataFrame:
    """(keep..., pattern, nth, start, match, groups, window): a row for each match of each named pattern in every whole text.

    ``nth`` counts a pattern's matches in a text from 1; ``start`` is the number of characters before. Null texts have no matches. What leaves a task is bounded by a batch's matches.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ready = list(patterns), [compiled(p, ignore_case) for p in patterns.values()]
        for batch in batches:
            take: list[int] = []
            columns: list[list] = [[] for _ in range(6)]
            for i, t in enumerate(batch.column("searched").to_pylist()):
                nth = [0] * len(ready)
                for k, m, window in _hits(t or "", ready, before, after):
                    nth[k] += 1
                    take.append(i)
                    for column, value in zip(columns, (names[k], nth[k], m.start(), m[0], [g or "" for g in m.groups()], window)):
                        column.append(value)
            kept = batch.select(keep).take(pa.array(take, pa.int64()))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v, kind) for v, kind in zip(columns, kinds))], names=[*keep, "pattern", "nth", "start", "match", "groups", "window"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, text(F.col(f"`{text_col}`")).alias("searched")).mapInArrow(find, f"{kinds}, pattern string, nth int, start int, match string, groups array<string>, window string")
