"""Recorded responses of services as a source: lines of JSON in a folder for each provider, and the rows that they hold.

A folder has ``provider=<name>/*.json``; a line is a request with its answer's status and body. Spark's own reader is used rather than a data source in Python:
it lists, splits and prunes folders on every file system that Spark knows. Bodies are parsed where they are read, as variants, so flat and nested answers need no
schema of their own. A line or body that is no JSON is kept, with its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domains import host_of
from ..functions.regex import text, trim

LINE = "company_id long, seq long, company string, request string, fetched_at timestamp, http_status int, latency_ms int, body string"
# --- fixed values -----------------------------------------------------------------------------------------------
OFFICIAL_TYPE, OFFICIAL_LABELS = "official_website", ("Official Website", "Website")
PREVIEW = 500
# ----------------------------------------------------------------------------------------------------------------


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a folder with ``provider``, ``answer`` (the parsed body; null where there is none) and ``bad`` (the text that is no JSON, else null).

    Filters on ``provider`` prune folders. A null or blank body is no answer, but not bad; a missing column is null; other fields of a line are left out.
    """
    lines = spark.read.schema(f"{LINE}, _corrupt string, provider string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    answer = F.try_parse_json(F.nullif(trim(text("body")), F.lit("")))
    bad = F.coalesce("_corrupt", F.when(answer.isNull() & (trim(text("body")) != ""), F.col("body")))
    return lines.select("provider", *[part.split()[0] for part in LINE.split(", ")], answer.alias("answer"), bad.alias("bad"))


def fetch_log(responses: DataFrame) -> DataFrame:
    """(company_id, source, http_status, latency_ms, preview) of every response."""
    return responses.select("company_id", F.col("provider").alias("source"), "http_status", "latency_ms", F.substring(F.coalesce("body", "bad", F.lit("")), 1, PREVIEW).alias("preview"))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _said(v: Column, *paths: str) -> Column:
    """The first of the paths' values that isn't empty."""
    return F.coalesce(*[F.nullif(_get(v, p), F.lit("")) for p in paths])


def first_requests(responses: DataFrame) -> DataFrame:
    """Responses to requests that their company made for the first time, whatever came of it; case and outer spaces don't tell requests apart.

    Only the keys are grouped and joined back, so bodies are not aggregated.
    """
    asked = responses.withColumn("_asked", F.lower(trim(text("request")))).where("_asked <> ''")
    firsts = asked.groupBy("provider", "company_id", "_asked").agg(F.min("seq").alias("seq"))
    return asked.join(firsts, ["provider", "company_id", "_asked", "seq"], "left_semi").drop("_asked")


def _answered(responses: DataFrame, provider: str) -> DataFrame:
    return responses.where((F.col("provider") == provider) & F.col("http_status").between(200, 299))


def autocomplete_rows(responses: DataFrame) -> DataFrame:
    """Candidates (company_id, seq, place, query, domain, name, snippet, source) of autocomplete answers, which are arrays; items without a domain are left out."""
    asked = _answered(first_requests(responses.where("provider = 'autocomplete'")), "autocomplete")
    items = asked.select("company_id", "seq", "request", F.posexplode(_get(F.col("answer"), "$", "array<variant>")).alias("place", "item"))
    v = F.col("item")
    rows = items.select("company_id", "seq", "place", F.col("request").alias("query"), _said(v, "$.domain").alias("domain"), _said(v, "$.name", "$.domain").alias("name"),
                        F.coalesce(_get(v, "$.industry"), F.lit("")).alias("snippet"), F.lit("autocomplete").alias("source"))
    return rows.where("domain IS NOT NULL")


def instant_rows(responses: DataFrame) -> DataFrame:
    """Candidates (company_id, seq, place, query, domain, name, snippet, source) of instant answers: the infobox's official site, then the host of the abstract's page.

    Hosts of encyclopedias are left out; their pages are for ``instant_titles``.
    """
    v = F.col("answer")
    content = _get(v, "$.Infobox.content", "array<variant>")
    official = F.get(F.filter(content, lambda i: F.coalesce(_get(i, "$.data_type") == OFFICIAL_TYPE, F.lit(False)) | F.coalesce(_get(i, "$.label").isin(*OFFICIAL_LABELS), F.lit(False))), F.lit(0))
    site, page = host_of(_get(official, "$.value")), host_of(_get(v, "$.AbstractURL"))
    both = F.array(F.when((site != "") & ~F.contains(site, F.lit("wikipedia.org")), F.struct(site.alias("domain"), F.lit("official").alias("snippet"))),
                   F.when((page != "") & ~page.rlike("(?i)wikipedia[.]org|wikidata[.]org"), F.struct(page.alias("domain"), F.lit("abstract").alias("snippet"))))
    rows = _answered(responses, "instant").select("company_id", "seq", F.col("request").alias("query"), F.coalesce(_said(v, "$.Heading"), F.col("company")).alias("name"), F.posexplode(both).alias("place", "c"))
    return rows.where("c IS NOT NULL").select("company_id", "seq", "place", "query", "c.domain", "name", "c.snippet", F.lit("instant").alias("source"))


def instant_titles(responses: DataFrame) -> DataFrame:
    """(company_id, seq, title): the encyclopedia page that an instant answer's abstract comes from."""
    raw = F.regexp_extract(text(_get(F.col("answer"), "$.AbstractURL")), r"(?i)wikipedia\.org/wiki/([^?#]+)", 1)
    plain = F.replace(F.replace(raw, F.lit("_"), F.lit(" ")), F.lit("+"), F.lit("%2B"))
    return _answered(responses, "instant").where(raw != "").select("company_id", "seq", F.coalesce(F.try_url_decode(plain), plain).alias("title"))


def provider_rows(responses: DataFrame) -> DataFrame:
    """What a data provider says of the domains it was asked for: (company_id, seq, place, domain, enabled, http_status, error, likelihood, website, provider_name, size,
    employee_count, alternative_names, alternative_domains).

    An answer to one domain is a flat object. An answer to many (``request`` names them, separated by commas) is an array in their order; an item is flat or wraps
    its object in ``data``, and has a status of its own. A body that can't be read is an error like an unanswered request.
    """
    asked = responses.where("provider = 'enrich'")
    v, item = F.col("answer"), F.col("item")
    ok = F.col("http_status").between(200, 299) & v.isNotNull()
    many = _get(v, "$", "array<variant>")
    items = F.when(ok & many.isNotNull(), many).otherwise(F.array(v))
    rows = asked.withColumns({"bulk": F.coalesce(ok & many.isNotNull(), F.lit(False)), "ok": F.coalesce(ok, F.lit(False)), "of": F.split(text("request"), ",")})
    rows = rows.select("company_id", "seq", "bulk", "ok", "of", "http_status", F.posexplode(items).alias("place", "item"))
    nested = F.when(F.col("bulk"), _get(item, "$.data", "variant"))
    inner = F.coalesce(F.when(F.schema_of_variant(nested).startswith("OBJECT"), nested), item)
    own = _get(item, "$.status", "int")
    status = F.when(~F.col("bulk"), F.col("http_status")).otherwise(F.coalesce(own, F.when(F.schema_of_variant(nested).startswith("OBJECT"), 200).otherwise(0)))
    found = F.col("ok") & (F.col("state") == 200)
    told = F.coalesce(_get(item, "$.error.message"), F.when(F.col("bulk"), _get(item, "$.error")), _get(item, "$.message"))
    error = F.when(found, None).when(~F.col("bulk") & (F.col("state") == 404), "not_found").when(F.col("bulk"), F.coalesce(told, F.concat(F.lit("status_"), F.col("state").cast("string"))))
    error = error.when(F.col("state").between(200, 299) & ~F.col("ok"), "unreadable").otherwise(F.coalesce(told, F.concat(F.lit("http_"), F.coalesce(F.col("state"), F.lit(0)).cast("string"))))
    keep = lambda path, kind="string": F.when(found, _get(F.col("inner"), path, kind))
    return rows.withColumns({"state": status, "inner": inner}).select(
        "company_id", "seq", "place", trim(F.get("of", F.when(F.col("bulk"), F.col("place")).otherwise(F.lit(0)))).alias("domain"), F.lit(True).alias("enabled"), F.col("state").alias("http_status"), error.alias("error"),
        F.coalesce(_get(item, "$.likelihood", "int"), _get(F.col("inner"), "$.likelihood", "int")).alias("likelihood"), keep("$.website").alias("website"), keep("$.name").alias("provider_name"), keep("$.size").alias("size"),
        keep("$.employee_count", "long").alias("employee_count"), keep("$.alternative_names", "array<string>").alias("alternative_names"), keep("$.alternative_domains", "array<string>").alias("alternative_domains"))


def people_rows(responses: DataFrame) -> DataFrame:
    """(company_id, domain, company, full_name, title, job_company_website, job_company_name) of the persons in answered searches for people, for ``founder_people``."""
    found = _answered(responses, "people").select("company_id", F.col("request").alias("domain"), "company", F.explode(_get(F.col("answer"), "$.data", "array<variant>")).alias("p"))
    p = F.col("p")
    return found.select("company_id", "domain", "company", _get(p, "$.full_name").alias("full_name"), _get(p, "$.job_title").alias("title"), _get(p, "$.job_company_website").alias("job_company_website"),
                        _get(p, "$.job_company_name").alias("job_company_name"))
