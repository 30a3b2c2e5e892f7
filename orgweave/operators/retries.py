"""The queue of lookups that may need another try: what came of each, from a log of attempts. The batch form; ``streaming.retries`` is its twin.

A log has (key, seq, at, http_status): attempts in the order of their times, then of ``seq``. A lookup's first three attempts count; the first of them that
brought an answer, or a refusal that another try won't change, settles it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
ATTEMPTS = 3
# ----------------------------------------------------------------------------------------------------------------
FINAL = ("done", "http")


def outcome(status: Column) -> Column:
    """What an attempt's status says: done, rate_limited, transient (no status, 0 or a server's fault) or http (refused for good)."""
    return F.when(status.between(200, 299), "done").when(status == 429, "rate_limited").when(status.isNull() | (status <= 0) | (status >= 500), "transient").otherwise("http")


def lookups(log: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(key, state, reason, attempts, at): ``done``, ``refused``, ``given_up`` after so many attempts, or ``waiting`` for another; the last attempt's outcome and time.

    An attempt that was logged several times, by key, time and ``seq``, counts once, with its largest status. Keys and times may be null: a null key is a key, a null time comes first. The rank is
    limited before the shuffle, so of a key that holds a third of the log each task sends three rows.
    """
    once = log.groupBy("key", "at", "seq").agg(F.max("http_status").alias("http_status"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.col("at").asc_nulls_first(), F.col("seq").asc_nulls_first()))
    early = once.withColumn("nth", nth).where(F.col("nth") <= attempts).withColumn("reason", outcome(F.col("http_status")))
    row = F.struct("nth", "reason", "at")
    of = early.groupBy("key").agg(F.min(F.when(F.col("reason").isin(*FINAL), row)).alias("settled"), F.max(row).alias("last"))
    one = of.select("key", F.coalesce("settled", "last").alias("o"))
    state = F.when(F.col("o.reason") == "done", "done").when(F.col("o.reason") == "http", "refused").when(F.col("o.nth") >= attempts, "given_up").otherwise("waiting")
    return one.select("key", state.alias("state"), "o.reason", F.col("o.nth").alias("attempts"), "o.at")


def again(lookups: DataFrame) -> DataFrame:
    """The keys to look up once more."""
    return lookups.where("state = 'waiting'").select("key", "attempts", "at")
