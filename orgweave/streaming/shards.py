"""Keyed state by shards: the keys of a shard have one table as their state and are folded together, so Python is called for a shard and not for a key."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: A shard's table is read and written as a whole; this many keep the states of 10 million keys in tables of 40,000.
SHARDS = 256
STATE = "rows binary"


def by_shard(log: DataFrame, key: str, shards: int):
    """The log grouped by the shard of its keys; a null key has a shard as others do."""
    return log.withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(shards))).groupBy("_shard")


def load(state: GroupState) -> list[pd.DataFrame]:
    """The shard's table, if there is one."""
    return [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []


def save(state: GroupState, rows: pd.DataFrame, timer: int | None) -> None:
    """Keep the shard's table and call again at ``timer`` (milliseconds of the log's time), if there is one; without rows nothing is kept."""
    if not len(rows):
        state.remove()
        return
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))
    if timer is not None:
        state.setTimeoutTimestamp(max(timer, state.getCurrentWatermarkMs() + 1))
