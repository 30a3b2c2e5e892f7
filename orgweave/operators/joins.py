"""How tables that grow meet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def keyed(df: DataFrame) -> DataFrame:
    """``df`` as a side of an equi-join that is dealt by its key and never broadcast.

    Spark guesses a size from compressed files and the columns read of them. Rows of a few megabytes there, with texts made of their keys, are
    hundreds in a broadcast, which the driver collects whole.
    """
    return df.hint("merge")
