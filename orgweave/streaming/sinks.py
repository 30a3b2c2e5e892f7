"""Update streams into keyed stores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import store
from ..sources.shared import discard, materialize


def into_store(stream: DataFrame, path: str, key: str, stamp: str, checkpoint: str, buckets: int = store.BUCKETS) -> None:
    """Put all that an update stream has to give now into the store at ``path``, batch by batch, and return.

    A batch is written once, so its state is folded once, and then merged into the buckets that it touches. A batch that is run again after a failure
    gives the same rows: the newest of a key stays, of equal stamps what comes in.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = materialize(batch, "batch")
        store.merge(batch.sparkSession, rows, path, key, stamp, buckets)
        discard(rows)

    stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
