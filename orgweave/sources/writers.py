"""Outputs: quoted exports, JSON reports, keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domains import registrable
from ..functions.fields import notes
from ..functions.regex import text
from . import store

#: The export's columns and their headings.
EXPORT = {"company_name": "Company Name", "website": "Website", "industry": "Industry", "headcount": "Headcount (est.)", "location": "Location", "notes": "Notes"}


def csv_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): every value in quotes, quotes doubled; null as the empty text."""
    quoted = [F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return rows.select(F.concat_ws(",", *quoted).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """The six-column export; notes are cleaned."""
    shaped = rows.withColumn("notes", notes(F.col("notes"))).select(*[text(c).alias(h) for c, h in EXPORT.items()])
    shaped.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


#: The batch export's columns and their headings.
BATCH_EXPORT = {"company_name": "Company Name", "website": "Website", "industry": "Industry", "headcount": "Headcount (est.)", "location": "Location", "founders": "Founders", "notes": "Notes"}


def batch_csv_rows(rows: DataFrame) -> DataFrame:
    """(line): the seven-column export of a batch, all values in quotes; notes are cleaned. The heading is ``batch_csv_heading``."""
    return csv_rows(rows.withColumn("notes", notes(F.col("notes"))), list(BATCH_EXPORT))


def batch_csv_heading() -> str:
    return ",".join(f'"{h}"' for h in BATCH_EXPORT.values())


def write_report(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """A report's two parts, as JSON lines, side by side."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/rows")


#: The newest row of each key.
upsert = store.newest


def write_store(spark: SparkSession, merged: DataFrame, path: str) -> None:
    """Write a merged store beside the old one and let the pointer file name it, so that readers never see half a store."""
    import uuid

    target = f"{path}/v-{uuid.uuid4().hex}"
    merged.write.parquet(target)
    spark.createDataFrame([(target,)], "current string").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def write_cache(spark: SparkSession, cache: DataFrame | None, incoming: DataFrame, path: str, as_of: Column) -> None:
    """A provider's answers (domain, company) put into its cache (domain, fetched_at, source, company): a domain's newest row stays.

    Only the buckets of the answers' domains are rewritten. ``cache`` are rows that a first cache begins with.
    """
    new = incoming.select(registrable(F.col("domain")).alias("domain"), as_of.alias("fetched_at"), F.lit("provider").alias("source"), "company")
    first = cache is not None and not store.exists(spark, path)
    store.merge(spark, upsert(cache, new, "domain", "fetched_at") if first else new, path, "domain", "fetched_at")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A store of ``write_store``, or one in buckets."""
    if store.exists(spark, path):
        return store.read(spark, path)
    return spark.read.parquet(spark.read.schema("current string").json(f"{path}/current").first()["current"])


def snapshot(stored: DataFrame, as_of: Column) -> DataFrame:
    """(json): the store as JSON lines, a line for the version, then the kept corrections in order of their names and the tombstones by key.

    Ordered by ranges, so no task holds the whole store.
    """
    kept = F.to_json(F.struct(F.col("company_name").alias("companyName"), F.col("company_key").alias("companyKey"), "domain", "source"))
    gone = F.to_json(F.struct(F.col("company_key").alias("companyKey"), F.col("updated_at").alias("deletedAt")))
    lines = stored.select(F.when(F.col("state") == "kept", 1).otherwise(2).alias("part"), F.coalesce("company_name", F.lit("")).alias("name"), "company_key", F.when(F.col("state") == "kept", kept).otherwise(gone).alias("json"))
    head = stored.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("name"), F.lit("").alias("company_key"), F.to_json(F.struct(F.lit(1).alias("version"), as_of.alias("updatedAt"))).alias("json"))
    return head.unionByName(lines).orderBy("part", F.collate("name", "UNICODE"), "company_key").select("json")
