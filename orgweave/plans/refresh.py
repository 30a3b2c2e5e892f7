"""Edited rows run again: from what has changed to the companies that it reaches, and only those anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..sources import store
from ..sources.readers import stack
from ..sources.shared import materialize
from .resolve import resolve_identity


def affected_companies(pool: DataFrame, edited: DataFrame | None = None, changed_pages: DataFrame | None = None, changed_classes: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """(company_id) whose result may differ: rows edited themselves (company_id), those with a candidate on a host whose page changed (url), and those with an
    entity (company_id, classes) one of whose classes changed (class). All are equi-joins; a host that many companies share makes many of them affected.
    """
    c = F.col
    found = []
    if edited is not None:
        found.append(edited.select("company_id"))
    if changed_pages is not None:
        hosts = changed_pages.select(D.host_of(c("url")).alias("host")).where("host <> ''").distinct()
        found.append(pool.select("company_id", D.host_of(c("domain")).alias("host")).join(hosts, "host", "left_semi").select("company_id"))
    if changed_classes is not None and entities is not None:
        found.append(entities.select("company_id", F.explode("classes").alias("class")).join(changed_classes.select("class").distinct(), "class", "left_semi").select("company_id"))
    if not found:
        return pool.select("company_id").limit(0)
    return stack(*found).distinct()


def rerun_identities(affected: DataFrame, companies: DataFrame, pool: DataFrame, pages: DataFrame) -> DataFrame:
    """``resolve_identity`` of the affected companies alone; only pages of their candidates' hosts are parsed.

    A company's decision depends on its own candidates and their pages, so the rows are those of a full run.
    """
    some = pool.join(affected, "company_id", "left_semi")
    hosts = some.select(D.host_of(F.col("domain")).alias("_host")).distinct()
    near = pages.join(hosts, D.host_of(F.col("url")) == F.col("_host"), "left_semi")
    return resolve_identity(companies.join(affected, "company_id", "left_semi"), some, near)


def refresh_identities(spark: SparkSession, path: str, companies: DataFrame, pool: DataFrame, pages: DataFrame, affected: DataFrame, as_of) -> list[int]:
    """Run the affected companies again and put them into the store of decisions at ``path``; the buckets rewritten. Companies that are gone are marked."""
    affected = materialize(affected.select("company_id").distinct(), "affected")
    again = rerun_identities(affected, companies, pool, pages)
    shown = again.select("company_id", "status", "domain", "confidence", "reason")
    gone = affected.join(again, "company_id", "left_anti").select("company_id", F.lit("removed").alias("status"), *[F.lit(None).cast("string").alias(x) for x in ("domain", "confidence", "reason")])
    return store.merge(spark, shown.unionByName(gone).withColumn("decided_at", as_of), path, "company_id", "decided_at")
