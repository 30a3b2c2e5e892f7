"""The place of every row in a total order, without putting the rows into one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

#: ``monotonically_increasing_id`` has the partition above these bits and the row's number in it below.
_BITS = 33


def numbered(rows: DataFrame, order: list[Column], counted: Column | None = None, name: str = "position") -> tuple[DataFrame, int]:
    """``rows`` with a long column ``name``: how many rows for which ``counted`` holds (all, if none is given) stand before each in the order; and their total.

    The rows are dealt out by ranges of the order and sorted within them, and written so; a range's number of rows is all that reaches the driver, one
    number for each shuffle partition. Rows that are equal in ``order`` stand together in one range: give it a last column that differs.
    """
    place = free_name(rows, "place")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    part = F.shiftright(place, _BITS)
    written = materialize(ranged, name)
    tally = F.count(F.lit(1)) if counted is None else F.count_if(counted)
    sizes = sorted(map(tuple, written.groupBy(part.alias("part")).agg(tally).collect()))
    starts = [0, *accumulate(n for _, n in sizes)]
    if not sizes:
        return written.withColumn(name, F.lit(0).cast("long")).drop(place), 0
    part_col, start_col = free_name(written, "part"), free_name(written, "start")
    offsets = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], f"{part_col} long, {start_col} long")
    # where only some rows are counted, the order has them first, so within a range the number of rows before is the number of counted ones
    out = written.withColumn(part_col, part).join(F.broadcast(offsets), part_col)
    return out.withColumn(name, F.col(start_col) + F.col(place).bitwiseAND(F.lit((1 << _BITS) - 1))).drop(part_col, start_col, place), starts[-1]
