"""Inputs: pasted text, files of names, lookups kept as tables, fixtures. Every connector is a table, so every result can be reproduced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import html as H
from ..functions import text as T
from ..functions.regex import cut, has, squeeze, text, trim
from ..operators.joins import keyed

#: Schemas of the lookup tables that stand for live services.
SCHEMAS = {
    "candidates": "company_id long, seq long, source string, query string, domain string, name string, snippet string, prominence int",
    "titles": "company_id long, seq long, title string, entity_id string", "entities": "entity_id string, classes array<string>, official_site string, label string, description string",
    "class_edges": "child string, parent string", "facts": "url string, property string, value string, label string", "fetch_log": "company_id long, source string, http_status int, latency_ms int, preview string",
    "liveness": "domain string, dns_ok boolean", "provider": "domain string, enabled boolean, http_status int, error string, likelihood int, website string, provider_name string, size string, "
    "employee_count long, alternative_names array<string>, alternative_domains array<string>", "people": "company_id long, domain string, company string, full_name string, title string, "
    "job_company_website string, job_company_name string", "corrections": "company_key string, company_name string, domain string, source string, created_at timestamp, updated_at timestamp, deleted boolean, origin int, seq long"}
#: Paths of a company's site that say most, and how many characters of each count.
DEEP_PATHS = {"/": 5000, "/about": 4000, "/about-us": 4000, "/company": 3000, "/team": 3000, "/contact": 2000}


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the non-empty lines, trimmed."""
    return spark.read.text(path).select(trim(F.col("value")).alias("value")).where("value <> ''")


def company_file(spark: SparkSession, path: str) -> DataFrame:
    """(company_name) of a comma-separated file with a header: the first column named after companies or names, else the first one."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False)
    named = [c for c in df.columns if any(word in c.lower() for word in ("company", "name", "business"))]
    column = F.col(f"`{(named or df.columns)[0]}`")
    return df.select(trim(text(column)).alias("company_name")).where("company_name <> ''")


def pasted_names(pastes: DataFrame, id_col: str = "paste_id", text_col: str = "text") -> DataFrame:
    """(paste_id, seq, name) of every name in pasted texts."""
    return pastes.select(F.col(id_col).alias("paste_id"), F.posexplode(T.paste_lines(F.col(text_col))).alias("seq", "name"))


def input_records(lines: DataFrame, col: str = "value") -> DataFrame:
    """Rows with ``name`` and ``context`` of ``Name | context`` lines."""
    return lines.withColumn("_p", T.parse_company(F.col(col))).select(*lines.columns, F.col("_p.name").alias("name"), F.col("_p.context").alias("context"))


def aliased_records(rows: DataFrame) -> DataFrame:
    """Rows with ``name, industry, location`` of whichever alias columns they have."""

    def one(*names: str) -> Column:
        have = [F.nullif(trim(text(n)), F.lit("")) for n in names if n in rows.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    return rows.select(one("name", "company").alias("name"), one("industry", "contextIndustry", "sector").alias("industry"), one("location", "hq").alias("location"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fixtures, one JSON document a file; a row that doesn't fit the schema is kept, with its text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, host, title, description, site_name, heading, json_ld_name, page_text) of pages (page_id, url, html); listed sites are left out."""
    c = F.col
    df = pages.withColumn("host", D.host_of(c("url"))).where(~D.is_junk_host(c("host")))
    df = df.withColumns({"p": H.page_identity(c("html")), "ld": H.json_ld_organizations(c("html"))})
    return df.select("page_id", "host", "p.*", F.get("ld", F.lit(0))["name"].alias("json_ld_name"), cut(H.html_text(c("html")), 4000).alias("page_text"))


def deep_site_evidence(pages: DataFrame) -> DataFrame:
    """(host, text, paths, json_ld_name): the words of a site's telling paths, in their order, each cut to its share; within a page the last organization's name counts."""
    c = F.col
    path = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract("url", r"^(?:https?://)?[^/?#]*(/[^?#]*)", 1), F.lit("")), F.lit("/")), r"(?<=.)/$", "")
    place = F.array_position(F.array(*map(F.lit, DEEP_PATHS)), F.lower(path))
    limit = F.create_map(*[F.lit(x) for p in DEEP_PATHS.items() for x in p])
    df = pages.withColumns({"host": D.host_of(c("url")), "place": place, "path": F.lower(path)}).where("place > 0")
    df = df.withColumns({"words": F.substr(H.html_text(c("html")), F.lit(1), F.element_at(limit, c("path"))), "ld": H.json_ld_organizations(c("html"))})
    firsts = df.groupBy("host", "place").agg(F.min(F.struct("page_id", "words", F.get(F.reverse("ld"), F.lit(0))["name"].alias("ld"))).alias("one"))
    return firsts.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "one.words", "one.ld"))).alias("all")).select(
        "host", F.array_join(F.transform("all", lambda x: x["words"]), " ").alias("text"), F.size("all").alias("paths"),
        F.get(F.filter(F.transform("all", lambda x: x["ld"]), lambda n: n.isNotNull()), F.lit(0)).alias("json_ld_name"))


def facts_by_site(companies: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of a company's site in any of the ways in which its address is written: an equi-join on the spelled addresses."""
    h = D.host_of(F.col("domain"))
    forms = F.array(*[F.concat(F.lit(a), h, F.lit(b)) for a in ("https://", "https://www.", "http://", "http://www.") for b in ("", "/")])
    spelled = companies.select("company_id", F.explode(forms).alias("url"))
    return spelled.join(keyed(facts), "url").select("company_id", "property", "value", "label").distinct()


def brand_guesses(companies: DataFrame, official: DataFrame) -> DataFrame:
    """Candidate rows for the hosts that a company's official address and name suggest."""
    df = companies.join(official.select("company_id", F.col("official_site")), "company_id", "left")
    guesses = D.official_guesses(F.coalesce("official_site", F.lit("")), F.col("company"))
    bare = F.filter(F.array_compact(F.array(F.concat(T.identity_key(F.col("company")), F.lit(".com")))), lambda d: F.length(d) >= 7)
    listed = F.when(F.size(guesses) > 0, guesses).otherwise(bare)
    return df.select("company_id", "company", F.posexplode(listed).alias("seq", "domain")).withColumn("source", F.when(F.col("seq") == 0, "wikidata_official").otherwise("brand_guess"))


def shortened_queries(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """(company_id, query) for companies without any candidate: the name, then its first two words and its first one."""
    lonely = companies.join(candidates.select("company_id").distinct(), "company_id", "left_anti")
    w = F.filter(F.split(squeeze(F.regexp_replace(text("company"), r"[^\w&.' -]", " ")), " "), lambda x: x != "")
    forms = F.array_distinct(F.array_compact(F.array(F.array_join(w, " "), F.array_join(F.slice(w, 1, 2), " "), F.get(w, F.lit(0)))))
    return lonely.select("company_id", F.posexplode(forms).alias("seq", "query")).where("query <> ''")


def search_queries(companies: DataFrame, most: int = 8) -> DataFrame:
    """(company_id, seq, query): distinct queries for a name and its context, in order."""
    name, context = trim(text("company")), trim(text("context"))
    forms = F.array(name, F.concat(name, F.lit(" official website")), F.concat(name, F.lit(" company")), F.when(context != "", F.concat_ws(" ", name, context)), T.strip_legal(name))
    return companies.select("company_id", F.posexplode(F.slice(F.array_distinct(F.filter(F.array_compact(forms), lambda q: trim(q) != "")), 1, most)).alias("seq", "query"))


def usable_titles(titles: DataFrame) -> DataFrame:
    """Titles that are no disambiguation pages or lists of names, one row per company and entity, the first."""
    ok = titles.where(~has(text("title"), r"\bdisambiguation\b|\bsurname\b|\bgiven name\b|^List of "))
    return ok.groupBy("company_id", "entity_id").agg(F.min(F.struct("seq", "title")).alias("t")).select("company_id", "entity_id", "t.seq", "t.title")


def fresh(cache: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Cache rows that are not older than ``days``; rows without a time count as of the year 2000."""
    return cache.where(F.coalesce("fetched_at", F.lit("2000-01-01").cast("timestamp")) >= as_of - F.make_dt_interval(F.lit(days)))


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """Lookup tables of a folder, with their schemas."""
    return [spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}.parquet") for n in names]


def stack(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
