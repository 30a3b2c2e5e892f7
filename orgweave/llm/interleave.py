"""Shards that all have the mixture of the whole: proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank says how far through its source it comes. Sorted by
that, the sources lie interleaved in proportion to their sizes, and equal cuts of the sequence are shards whose numbers of rows differ by one at
most and in which every source has its share, within two rows. Both orders are made by ranges (``order.numbered``), so a source that
holds most rows is spread over as many tasks as its rows fill; texts are read once, and only ids, sizes and checksums are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .order import numbered

SHARDS, SEED = 24, 42


def _whole(a: Column, b: int) -> Column:
    """The whole part of a quotient of whole numbers, exactly."""
    return ((a - F.pmod(a, F.lit(b).cast("long"))) / b).cast("long")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, text_crc32, law, shard, slot, grown_shard): each row's shard from 0, and its place there from 0, without gaps.

    The law is ``rows``: numbers of rows at most one apart; so copies of a text are dealt out as other rows are, and ``grown_shard`` is null.
    A null text has no bytes; rows without a source are a source of their own; a null id is hashed as the empty text; repeated rows each get a place;
    other columns are not carried, so their names can't clash; an empty table gives no rows, and with fewer rows than shards some stay empty.
    """
    text, name = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{source_col}`")
    own = F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))
    shuffled = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    rows = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), name.alias("source"), own.alias("stratum"), shuffled.alias("shuffled"), (F.octet_length(text) + 8).cast("long").alias("size"),
                                   F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    by_source, n = numbered(rows, [F.col("stratum"), F.col("shuffled"), F.col("row")], name="at")
    # written, so that Spark knows the size of the list of sources and sends it whole only where that is small
    sources = materialize(by_source.groupBy("stratum").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "shard-sources")
    through = (F.col("at") - F.col("first") + 0.5) / F.col("n")
    fractional = by_source.join(sources, "stratum").withColumn("through", through)
    # written before it is numbered: choosing the ranges reads it first
    mixed, _ = numbered(materialize(fractional.select("doc_id", "source", "size", "text_crc32", "through", "stratum", "row"), "shard-fractions"),
                        [F.col("through"), F.col("stratum"), F.col("row")], name="at")
    return (mixed.withColumn("shard", _whole(F.col("at") * shards, max(n, 1)).cast("int"))
            .withColumn("slot", F.col("at") - _whole(F.col("shard").cast("long") * n + shards - 1, shards))
            .select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
