"""A data provider as fallback: validate its match, fill only what is unknown, keep what conflicts, and cache with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domains import registrable
from ..functions.fields import location, lookup, title_words
from ..functions.regex import has, let, squeeze, text, trim, words
from ..functions.text import is_blank, match_key
from .joins import keyed

# --- fixed values -----------------------------------------------------------------------------------------------
LEAST_LIKELIHOOD, SURE_LIKELIHOOD, CACHE_DAYS, CHUNK, BULK = 6, 8, 30, 50, 100
SIZES = {"1-10": "1–10", "11-50": "11–50", "51-200": "51–200", "201-500": "201–500", "501-1000": "501–1,000", "1001-5000": "1,001–5,000", "5001-10000": "5,001–10,000", "10001+": "10,001+"}
AUTHORITY = {"official_about": 100, "official_contact": 95, "json_ld": 90, "wikidata": 85, "official_page": 80, "structured_profile": 70, "search_snippet": 50, "press": 40, "text": 30}
#: The states that a provider's places are shortened to.
STATES = {"california": "CA", "new york": "NY", "texas": "TX", "washington": "WA", "massachusetts": "MA", "illinois": "IL", "florida": "FL", "colorado": "CO", "georgia": "GA", "oregon": "OR", "virginia": "VA",
          "pennsylvania": "PA", "new jersey": "NJ", "arizona": "AZ", "michigan": "MI", "north carolina": "NC"}
# ----------------------------------------------------------------------------------------------------------------


def similar_names(a: Column, b: Column) -> Column:
    """Equal match keys, or one of four characters or more within the other."""
    pair = F.struct(match_key(a).alias("a"), match_key(b).alias("b"))
    return let(pair, lambda p: (p["a"] != "") & (p["b"] != "") & ((p["a"] == p["b"]) | ((F.length(p["a"]) >= 4) & F.contains(p["b"], p["a"])) | ((F.length(p["b"]) >= 4) & F.contains(p["a"], p["b"]))))


def validate(responses: DataFrame) -> DataFrame:
    """Add ``match_status`` and ``match_reason`` to (requested_domain, requested_name, enabled, http_status, error, likelihood, website, provider_name,
    alternative_names, alternative_domains): disabled, not_found, error, rejected or accepted, in this order of tests."""
    c = F.col
    none = F.array().cast("array<string>")
    df = responses.withColumns({"_req": registrable(c("requested_domain")), "_got": registrable(c("website")),
                                "_alt": F.transform(F.coalesce(c("alternative_domains"), none), registrable), "_like": F.coalesce(c("likelihood"), F.lit(0))})
    dotted = lambda x: F.concat(F.lit("."), x)
    domain_ok = (c("_req") != "") & ((c("_got") == c("_req")) | F.array_contains("_alt", c("_req")) | ((c("_got") != "") & (c("_req").endswith(dotted(c("_got"))) | c("_got").endswith(dotted(c("_req"))))))
    names = F.array_compact(F.concat(F.coalesce(c("alternative_names"), none), F.array("provider_name")))
    name_ok = (text("requested_name") == "") | F.exists(names, lambda n: similar_names(n, c("requested_name")))
    steps = ((~F.coalesce(c("enabled"), F.lit(False)), "disabled", F.lit("not_configured")), ((c("http_status") == 404) | c("error").eqNullSafe("not_found"), "not_found", F.lit("not_found")),
             (c("error").isNotNull() & ~c("http_status").eqNullSafe(200), "error", c("error")), (~c("http_status").eqNullSafe(200) | (c("website").isNull() & c("provider_name").isNull()), "error", F.lit("empty_response")),
             (c("_like") < LEAST_LIKELIHOOD, "rejected", F.concat(F.lit("likelihood_"), c("_like").cast("string"), F.lit(f"_below_{LEAST_LIKELIHOOD}"))),
             (~domain_ok, "rejected", F.concat(F.lit("domain_mismatch_req_"), c("_req"), F.lit("_got_"), F.coalesce(F.nullif(c("_got"), F.lit("")), F.lit("none")))),
             (~name_ok & (c("_like") < SURE_LIKELIHOOD), "rejected", F.lit("name_mismatch_with_moderate_likelihood")))
    status, reason = F.lit("accepted"), F.lit(None).cast("string")
    for test, s, r in reversed(steps):
        test = F.coalesce(test, F.lit(False))
        status, reason = F.when(test, s).otherwise(status), F.when(test, r).otherwise(reason)
    return df.withColumns({"match_status": status, "match_reason": reason}).drop("_req", "_got", "_alt", "_like")


def founder_people(people: DataFrame) -> DataFrame:
    """(company_id, full_name, title) of people (company_id, domain, company, full_name, title, job_company_website, job_company_name) whose title
    says founder and whose company is the one asked for."""
    c = F.col
    same = (registrable(c("domain")) == "") | (registrable(c("job_company_website")) == registrable(c("domain"))) | similar_names(c("job_company_name"), c("company"))
    ok = has(text("title"), r"\b(co-?founder|founder)\b") & same & (F.size(words(text("full_name"))) >= 2)
    return people.where(ok).select("company_id", squeeze(text("full_name")).alias("full_name"), "title")


def headcount(size: Column, count: Column) -> Column:
    from ..functions.fields import headcount_bucket

    return F.coalesce(lookup(F.lower(text(size)), SIZES), headcount_bucket(F.when(count > 0, count)))


def place(raw: Column) -> Column:
    """A provider's place as ``City, ST`` or ``City, Country``; null without a usable one."""

    def body(p: Column) -> Column:
        region, last = F.get(p, F.lit(1)), F.element_at(p, -1)
        two = F.when(region.rlike("^[A-Za-z]{2}$"), F.concat_ws(", ", F.get(p, F.lit(0)), F.upper(region))).otherwise(location(F.concat_ws(", ", F.get(p, F.lit(0)), F.when(F.size(p) >= 3, last).otherwise(region))))
        many = F.coalesce(F.concat(F.get(p, F.lit(0)), F.lit(", "), lookup(F.lower(region), STATES)), two)
        return F.when(F.size(p) >= 2, many).otherwise(let(location(F.get(p, F.lit(0))), lambda n: F.when(~is_blank(n), n)))

    shown = title_words(squeeze(text(raw)))
    return let(F.filter(F.transform(F.split(shown, ","), trim), lambda x: x != ""), lambda p: F.when(F.size(p) > 0, body(p)))


def headquarters(locality: Column, region: Column, country: Column, name: Column) -> Column:
    """struct(value, raw, evidence) of a provider's location: its locality with the region or else the country, else the first two parts of its name."""
    some = lambda c: F.nullif(text(c), F.lit(""))
    parts = F.filter(F.transform(F.split(text(name), ","), trim), lambda p: p != "")
    raw = F.coalesce(F.concat(some(locality), F.lit(", "), F.coalesce(some(region), some(country))), F.when(F.size(parts) >= 2, F.concat_ws(", ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))))
    return let(F.struct(place(raw).alias("value"), raw.alias("raw")), lambda x: F.when(
        x["value"].isNotNull() & ~is_blank(x["value"]), F.struct(x["value"].alias("value"), x["raw"].alias("raw"), F.concat(F.lit("Provider location: "), F.coalesce(some(name), x["raw"])).alias("evidence"))))


def counts(validated: DataFrame, filled: DataFrame | None = None) -> DataFrame:
    """One row of counters of ``validate``'s rows (with ``from_cache``, if they have it), and of ``fill_unknown``'s rows, if given."""
    status = lambda s: F.count_if(F.col("match_status") == s)
    cached = F.coalesce(F.col("from_cache"), F.lit(False)) if "from_cache" in validated.columns else F.lit(False)
    asked = F.col("match_status") != "disabled"
    out = validated.agg(F.count_if(asked & ~cached).alias("requests"), F.count_if(asked & cached).alias("cache_hits"), status("accepted").alias("matches"), status("rejected").alias("rejected"),
                        status("not_found").alias("not_found"), status("error").alias("errors"))
    if filled is None:
        return out
    gains = filled.agg(F.coalesce(F.sum(F.size("filled")), F.lit(0)).alias("filled"), F.coalesce(F.sum(F.size("conflicts")), F.lit(0)).alias("conflicts"))
    return out.withColumn("_one", F.lit(1)).join(gains.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each


def fill_unknown(fields: DataFrame, provider: DataFrame, names: tuple[str, ...] = ("industry", "location", "headcount", "founders")) -> DataFrame:
    """Fields of accepted companies, with unknown ones taken from the provider; where both know and differ, ours stays and ``conflicts`` names the field.

    ``provider`` has (company_id, match_status, <field>...). One equi-join on the company.
    """
    given = provider.where("match_status = 'accepted'").select("company_id", *[F.col(n).alias(f"_{n}") for n in names])
    df = fields.join(given, "company_id", "left")
    differ = [F.when(~is_blank(F.col(n)) & ~is_blank(F.col(f"_{n}")) & (F.lower(text(n)) != F.lower(text(f"_{n}"))), F.lit(n)) for n in names]
    filled = [F.when(is_blank(F.col(n)) & ~is_blank(F.col(f"_{n}")), F.lit(n)) for n in names]
    out = df.withColumns({"conflicts": F.array_compact(F.array(*differ)), "filled": F.array_compact(F.array(*filled))})
    out = out.withColumns({n: F.when(is_blank(F.col(n)) & ~is_blank(F.col(f"_{n}")), F.col(f"_{n}")).otherwise(F.col(n)) for n in names})
    return out.drop(*[f"_{n}" for n in names])


def through_cache(requests: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Requests (domain, ...) with ``cached``, the company of a cache row (domain, fetched_at, company) not older than 30 days. Rows without a company never serve."""
    fresh = cache.where(F.col("company").isNotNull() & (F.col("fetched_at") >= as_of - F.expr(f"INTERVAL {CACHE_DAYS} DAYS")))
    newest = fresh.groupBy("domain").agg(F.max_by("company", "fetched_at").alias("cached"))
    return requests.join(keyed(newest), "domain", "left")


def chunks(requests: DataFrame, seq: str = "seq", size: int = CHUNK) -> DataFrame:
    """Add ``chunk``: which bulk request a row belongs to, from its consecutive ``seq`` (from 0)."""
    return requests.withColumn("chunk", F.floor(F.col(seq) / size))


def needs_fallback(value: Column, source: Column, confidence: Column) -> Column:
    """Unknown, or known from no source of high authority."""
    return is_blank(value) | ~((F.coalesce(lookup(source, {k: str(v) for k, v in AUTHORITY.items()}).cast("int"), F.lit(20)) >= 80) & (confidence == "high"))
