"""Corrections: last writer wins per company, deletions leave expiring tombstones. The batch form; ``streaming.corrections`` is its twin.

A change log has (company_key, company_name, domain, source, created_at, updated_at, deleted, origin, seq): ``origin`` 0 for what is stored and
1 for what comes in, ``seq`` the order within an origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domains import store_domain
from ..functions.regex import cut, text, trim
from ..functions.text import store_key

# --- fixed values -----------------------------------------------------------------------------------------------
TOMBSTONE_DAYS = 365
#: A missing time counts as this.
MISSING = "2000-01-01 00:00:00"
# ----------------------------------------------------------------------------------------------------------------


def when(df_ts: Column) -> Column:
    return F.coalesce(df_ts, F.lit(MISSING).cast("timestamp"))


def sanitize(raw: DataFrame, as_of: Column) -> DataFrame:
    """Usable corrections and deletions of a raw log: keys made where they lack, domains cleaned, times defaulted to ``as_of``."""
    c = F.col
    name = trim(text("company_name"))
    key = store_key(F.coalesce(F.nullif(text("company_key"), F.lit("")), name))
    df = raw.withColumns({"company_name": name, "company_key": key, "domain": store_domain(c("domain")), "source": cut(F.coalesce(F.nullif(text("source"), F.lit("")), F.lit("manual")), 40),
                          "created_at": F.coalesce(c("created_at"), as_of), "updated_at": F.coalesce(c("updated_at"), as_of), "deleted": F.coalesce(c("deleted"), F.lit(False))})
    return df.where((c("company_key") != "") & (c("deleted") | ((c("company_name") != "") & F.contains("domain", F.lit(".")))))


def merge_corrections(log: DataFrame) -> DataFrame:
    """The newest correction of each key; of equal times what comes in later wins. ``created_at`` stays the key's first one.

    Maxima over structs, combined map-side: no window over a key's history.
    """
    live = log.where(~F.col("deleted"))
    stamp = when(F.coalesce("updated_at", "created_at"))
    row = F.struct("company_name", "domain", "source", "updated_at")
    return (live.groupBy("company_key").agg(F.max_by(row, F.struct(stamp.alias("t"), "origin", "seq")).alias("row"), F.max(stamp).alias("stamp"),
                                            F.min_by("created_at", F.struct("origin", "seq")).alias("created_at"))
            .select("company_key", "row.*", "created_at", "stamp"))


def merge_deletions(log: DataFrame) -> DataFrame:
    """The newest deletion of each key; of equal times the stored one stays."""
    return log.where("deleted").groupBy("company_key").agg(F.max(when(F.col("updated_at"))).alias("deleted_at"))


def reconcile(log: DataFrame, as_of: Column) -> DataFrame:
    """(company_key, company_name, domain, source, created_at, updated_at, state): ``kept`` corrections and ``deleted`` tombstones.

    Tombstones of over a year are forgotten. A correction survives if it is strictly newer than its tombstone, which then goes; a tie stays deleted.
    """
    c = F.col
    tombs = merge_deletions(log).where(c("deleted_at") >= as_of - F.expr(f"INTERVAL {TOMBSTONE_DAYS} DAYS"))
    both = merge_corrections(log).join(tombs, "company_key", "full_outer")
    kept = c("stamp").isNotNull() & (c("deleted_at").isNull() | (c("stamp") > c("deleted_at")))
    return both.select("company_key", *[F.when(kept, c(x)).alias(x) for x in ("company_name", "domain", "source", "created_at")],
                       F.when(kept, c("updated_at")).otherwise(c("deleted_at")).alias("updated_at"), F.when(kept, "kept").otherwise("deleted").alias("state"))


def export_order(store: DataFrame) -> DataFrame:
    """Kept corrections in the order of a snapshot: by name under the Unicode collation."""
    return store.where("state = 'kept'").orderBy(F.collate("company_name", "UNICODE"), "company_key")


def delete(keys: DataFrame, as_of: Column) -> DataFrame:
    """Log rows that delete the given keys now."""
    return keys.select(store_key(F.col("company_key")).alias("company_key"), F.lit(None).cast("string").alias("company_name"), F.lit(None).cast("string").alias("domain"),
                       F.lit("manual").alias("source"), as_of.alias("created_at"), as_of.alias("updated_at"), F.lit(True).alias("deleted"), F.lit(1).alias("origin"), F.lit(0).cast("long").alias("seq"))
