"""The registered queries of the engine's own operators, each with the SQL that says the same where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import domains as D
from .functions import extract as X
from .functions import fields as L
from .functions import html as H
from .functions import matching as N
from .functions import scan
from .functions import text as T
from .operators import candidates as C
from .operators import consensus as S
from .operators import corrections as K
from .operators import guard as G
from .operators import industry as I
from .operators import metrics as M
from .operators import provider as P
from .operators import retries
from .operators import scoring as R
from .operators import selection as W
from .operators.joins import keyed
from .plans import refresh, resolve
from .sources import readers, responses, store, writers
from .sources.shared import discard, forget, materialize, shared_dir
from .streaming import corrections as stream_of_corrections
from .streaming import retries as stream_of_retries
from .streaming import sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt by the hash of ``by`` to four tasks a core. A file is read by as few tasks as it has row groups, which is one for a million short rows; where each row takes long, that is most cores idle."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


# SQL fragments -----------------------------------------------------------------------------------------------------
_HOST = r"trim(split_part(split_part(regexp_replace(regexp_replace(lower({0}), '[\[\]]', '', 'g'), '^(https?://)?(www\.)?', ''), '/', 1), '?', 1))"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_LEGAL = r"regexp_replace(regexp_replace({0}, '" + T.LEGAL_FORMS + r"', ' ', 'gi'), '[.,]', ' ', 'g')"
_KEY = r"regexp_replace(lower(" + _LEGAL + r"), '[^a-z0-9]+', '', 'g')"
_PAGE_HOST = _HOST.format("url")
_TITLE = _SQUEEZE.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_H1 = _SQUEEZE.format(r"regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')")
_JUNK = r"'(^|\.)(" + "|".join(h.replace(".", r"\.") for h in D.JUNK_HOSTS) + r")(/|$)'"


_META = """trim(coalesce(nullif(regexp_extract(html, '(?is)<meta[^>]+(?:name|property)=["'']{0}["''][^>]+content=["'']([^"'']*)["'']', 1), ''), regexp_extract(html, '(?is)<meta[^>]+content=["'']([^"'']*)["''][^>]+(?:name|property)=["'']{0}["'']', 1)))"""


# pages ---------------------------------------------------------------------------------------------------------------
@query(f"""
WITH p AS (SELECT page_id, {_PAGE_HOST} AS host, {_TITLE} AS title, {_H1} AS heading FROM pages),
q AS (SELECT *, string_split(host, '.') AS parts FROM p WHERE NOT regexp_matches(host, {_JUNK})),
r AS (SELECT *, CASE WHEN len(parts) >= 3 AND regexp_matches(parts[1], '{D.PROPERTY_LABELS}') THEN array_to_string(parts[2:], '.') ELSE host END AS owner,
  (CASE WHEN len(parts) >= 3 AND regexp_matches(parts[1], '{D.PENALIZED_LABELS}') THEN -55 ELSE 0 END) + (CASE WHEN len(parts) >= 3 AND parts[1] <> 'www' THEN -25 ELSE 0 END) AS penalty FROM q),
s AS (SELECT *, list_filter(string_split(regexp_replace(lower(split_part(owner, '.', 1)), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 3) AS tokens FROM r),
u AS (SELECT page_id, owner, host, title, CAST(penalty + 10 * len(list_filter(tokens, lambda t: contains(lower(concat_ws(' ', title, heading)), t))) AS INTEGER) AS score FROM s)
SELECT owner, page_id, host, title, score FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, page_id) AS k FROM u) WHERE k = 1""")
def site_front_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each site the page that speaks most for its owner: property hosts are penalized, pages that name the owner preferred."""
    c = F.col
    p = table(spark, sf_dir, "pages").select("page_id", D.host_of(c("url")).alias("host"), H.title(c("html")).alias("title"), H.heading(c("html")).alias("heading"))
    p = p.where(~D.is_junk_host(c("host"))).withColumn("owner", D.without_property_label(c("host")))
    parts = D.labels(c("host"))
    deep = F.size(parts) >= 3
    penalty = F.when(deep & parts[0].rlike("(?i)" + D.PENALIZED_LABELS), -55).otherwise(0) + F.when(deep & (parts[0] != "www"), -25).otherwise(0)
    hits = F.size(F.filter(F.split(F.regexp_replace(F.substring_index("owner", ".", 1), "[^a-z0-9]+", " "), " "),
                           lambda t: (F.length(t) >= 3) & F.contains(F.lower(F.concat_ws(" ", "title", "heading")), t)))
    best = p.withColumn("score", penalty + 10 * hits).groupBy("owner").agg(F.max_by(F.struct("page_id", "host", "title", "score"), F.struct("score", -c("page_id"))).alias("b"))
    return best.select("owner", "b.*")


@query(f"""SELECT page_id, {_TITLE} AS title, {_H1} AS heading, coalesce(nullif({_META.format('description')}, ''), {_META.format('og:description')}) AS description, {_META.format('og:site_name')} AS site_name FROM pages""")
def page_identity_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.page_identity(F.col("html")).alias("p")).select("page_id", "p.title", "p.heading", "p.description", "p.site_name")


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'),
'<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '[\s\x{A0}\x{2000}-\x{200A}]+', ' ', 'g')) AS words FROM pages""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.html_text(F.col("html")).alias("words"))


@query(f"""WITH p AS (SELECT page_id, {_PAGE_HOST} AS host FROM pages), q AS (SELECT *, string_split(split_part(split_part(host, '#', 1), ':', 1), '.') AS parts FROM p)
SELECT page_id, host, CASE WHEN len(string_split(host, '.')) >= 3 AND regexp_matches(split_part(host, '.', 1), '{D.PROPERTY_LABELS}') THEN array_to_string(string_split(host, '.')[2:], '.') ELSE host END AS owner,
CASE WHEN len(parts) <= 2 THEN array_to_string(parts, '.') ELSE array_to_string(parts[-2:], '.') END AS registrable, parts[-1] AS tld FROM q""")
def hosts_and_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "pages").select("page_id", D.host_of(c("url")).alias("host"), D.without_property_label(c("url")).alias("owner"), D.registrable(c("url")).alias("registrable"), D.decisive_tld(D.clean_host(c("url"))).alias("tld"))


@query(f"""WITH p AS (SELECT page_id, {_PAGE_HOST} AS host FROM pages)
SELECT page_id, host, regexp_matches(host, {_JUNK}) AS junk, CAST((CASE WHEN len(string_split(host, '.')) >= 3 AND regexp_matches(split_part(host, '.', 1), '{D.PENALIZED_LABELS}') THEN -55 ELSE 0 END)
+ (CASE WHEN len(string_split(host, '.')) >= 3 AND split_part(host, '.', 1) <> 'www' THEN -25 ELSE 0 END) + (CASE WHEN regexp_matches(host, '\\.shop$|\\.store$|(^|\\.)shop\\.|(^|\\.)store\\.') THEN -60 ELSE 0 END)
+ (CASE WHEN regexp_matches(replace(host, '.', ''), '(casualgames|merchandise|merch|fanclub|community|support|careers|jobs|developers?|devportal|events)') THEN -50 ELSE 0 END) AS INTEGER) AS penalty FROM p""")
def host_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = F.col, F.lit(None).cast("string")
    p = table(spark, sf_dir, "pages").select("page_id", D.host_of(c("url")).alias("host"))
    return p.select("page_id", "host", D.is_junk_host(c("host")).alias("junk"), R.total(F.array_compact(F.array(*R.affiliate_signals(c("host"), none, none, none)))).alias("penalty"))


@query(f"""WITH p AS (SELECT page_id, {_PAGE_HOST} AS host, lower(concat_ws(' ', {_TITLE}, '', '', {_H1})) AS blob FROM pages),
q AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(host, '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 3 AND t NOT IN {T.PAGE_STOP})) AS tokens FROM p)
SELECT page_id, CAST(len(tokens) AS INTEGER) AS tokens, CAST(len(list_filter(tokens, lambda t: contains(blob, t))) AS INTEGER) AS hits FROM q""")
def title_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", D.host_of(F.col("url")).alias("host"), H.page_identity(F.col("html")).alias("p"))
    return p.select("page_id", H.token_overlap(F.col("host"), F.col("p")).alias("o")).select("page_id", "o.tokens", "o.hits")


_PAGE_POOL = f"SELECT page_id % 40 AS company_id, page_id AS seq, {_PAGE_HOST} AS domain, {_TITLE} AS name, {_H1} AS snippet, CASE page_id % 3 WHEN 0 THEN 'guess' WHEN 1 THEN 'search' ELSE 'wiki' END AS source, page_id % 7 AS prominence FROM pages"


def _page_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    source = F.when(c("page_id") % 3 == 0, "guess").when(c("page_id") % 3 == 1, "search").otherwise("wiki")
    return table(spark, sf_dir, "pages").select((c("page_id") % 40).alias("company_id"), c("page_id").alias("seq"), D.host_of(c("url")).alias("domain"), H.title(c("html")).alias("name"),
                                                H.heading(c("html")).alias("snippet"), source.alias("source"), (c("page_id") % 7).alias("prominence"))


@query(f"""WITH c AS ({_PAGE_POOL}), v AS (SELECT * FROM c WHERE regexp_matches(domain, '^[a-z0-9][a-z0-9.-]*\\.[a-z]{{2,}}$')),
s AS (SELECT company_id, domain, source, min(seq) AS seq FROM v GROUP BY ALL), t AS (SELECT company_id, domain, string_agg(source, ',' ORDER BY seq) AS sources FROM s GROUP BY ALL)
SELECT company_id, domain, t.sources, max(prominence) AS prominence, arg_min(name, seq) FILTER (WHERE name <> '' AND lower(name) <> domain) AS name, arg_min(snippet, seq) FILTER (WHERE snippet <> '') AS snippet, min(seq) AS seq
FROM v JOIN t USING (company_id, domain) GROUP BY company_id, domain, t.sources""")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_by_domain(_page_pool(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH c AS ({_PAGE_POOL}) SELECT company_id, domain, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, CAST(count(DISTINCT source) AS INTEGER) AS agreement FROM c GROUP BY ALL")
def candidate_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consensus(_page_pool(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH c AS ({_PAGE_POOL}), r AS (SELECT DISTINCT company_id, domain FROM c WHERE source = 'wiki') SELECT company_id, seq, domain FROM c ANTI JOIN r USING (company_id, domain)""")
def rejected_domains_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _page_pool(spark, sf_dir)
    return C.reject_domains(pool, pool.where("source = 'wiki'")).select("company_id", "seq", "domain")


# names ---------------------------------------------------------------------------------------------------------------
@query(f"""WITH k AS (SELECT p_partkey AS seq, p_name AS name, {_KEY.format('p_name')} AS match_key FROM part) SELECT match_key, min(seq) AS seq, arg_min(name, seq) AS name FROM k WHERE match_key <> '' GROUP BY match_key""")
def match_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"))
    return C.dedupe_names(names).select("match_key", "seq", "name")


_FIRMS = "SELECT s_suppkey AS id, concat(s_name, CASE s_suppkey % 6 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Holdings LLC' WHEN 2 THEN ' Group (SG)' WHEN 3 THEN ' Technologies' WHEN 4 THEN ' & Partners Ltd.' ELSE '' END) AS name FROM supplier"


def _firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 6
    end = F.when(k == 0, ", Inc.").when(k == 1, " Holdings LLC").when(k == 2, " Group (SG)").when(k == 3, " Technologies").when(k == 4, " & Partners Ltd.").otherwise("")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", end).alias("name"))


@query(f"""WITH f AS ({_FIRMS}), i AS (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '{T.IDENTITY_FORMS}', ' ', 'gi'), '[.,]', ' ', 'g'), '\\s+', ' ', 'g'))) AS plain FROM f)
SELECT id, {_KEY.format('name')} AS match_key, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[.,]', ' ', 'g'), '{T.LEGAL_FORMS}', ' ', 'gi'), '\\s*\\(.*?\\)\\s*', ' ', 'g'), '\\s+', ' ', 'g')) AS name_core,
regexp_replace(plain, '[^a-z0-9]+', '', 'g') AS identity_key, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS store_key,
array_to_string(list_filter(list_transform(string_split(plain, ' '), lambda t: regexp_replace(t, '[^a-z0-9]', '', 'g')), lambda t: length(t) > 1 AND t NOT IN {T.GENERIC_WORDS}), ' ') AS tokens FROM i""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return _firms(spark, sf_dir).select("id", T.match_key(n).alias("match_key"), T.name_core(n).alias("name_core"), T.identity_key(n).alias("identity_key"), T.store_key(n).alias("store_key"),
                                        F.array_join(T.identity_tokens(n), " ").alias("tokens"))


@query(f"""WITH k AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key, list_filter(string_split(lower(p_name), ' '), lambda t: length(t) > 1 AND t NOT IN {T.GENERIC_WORDS}) AS tokens FROM part)
SELECT id, CAST(least(100, (CASE WHEN len(tokens) <= 1 THEN 35 ELSE 0 END) + (CASE WHEN len(tokens) = 2 THEN 15 ELSE 0 END)
+ (CASE WHEN len(list_filter(tokens, lambda t: NOT (t IN {T.COMMON_BRANDS} OR length(t) <= 4))) = 0 THEN 25 ELSE 0 END) + (CASE WHEN length(key) <= 6 THEN 15 ELSE 0 END)) AS INTEGER) AS risk FROM k""")
def ambiguity_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.ambiguity_risk(F.col("p_name")).alias("risk"))


_DICTIONARY = "(VALUES (0, 'ring', 'ring.example.com'), (1, 'redwidget', 'widget.example.com'), (2, 'bolt', 'bolt.example.org'), (3, 'bluebolt', 'bluebolt.example.org'), (4, 'gear', 'gear.example.net'))"


@query(f"""WITH d(entry_seq, key, domain) AS {_DICTIONARY}, n AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part),
h AS (SELECT n.id, n.key, d.domain, d.entry_seq, d.key = n.key AS exact, row_number() OVER (PARTITION BY n.id ORDER BY CASE WHEN d.key = n.key THEN 0 ELSE 1 END, d.entry_seq) AS k
FROM n JOIN d ON d.key = n.key OR (length(n.key) >= 4 AND (contains(d.key, n.key) OR contains(n.key, d.key)))) SELECT n.id, n.key, h.domain, h.entry_seq, h.exact FROM n LEFT JOIN h ON n.id = h.id AND h.k = 1""")
def dictionary_fuzzy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "ring", "ring.example.com"), (1, "redwidget", "widget.example.com"), (2, "bolt", "bolt.example.org"), (3, "bluebolt", "bluebolt.example.org"), (4, "gear", "gear.example.net")]
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return C.fuzzy_lookup(names, spark.createDataFrame(rows, "entry_seq int, key string, domain string")).drop("name")


_LISTED = "SELECT s_suppkey AS entry_seq, CASE WHEN s_suppkey % 2 = 0 THEN concat('customer', substr(s_name, 10, 8)) ELSE concat('the', 'customer', substr(s_name, 10), 'holding') END AS key, concat('s', s_suppkey, '.example.com') AS domain FROM supplier"


@query(f"""WITH d AS ({_LISTED}), n AS (SELECT c_custkey AS id, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key FROM customer),
h AS (SELECT n.id, d.domain, d.entry_seq, row_number() OVER (PARTITION BY n.id ORDER BY d.key <> n.key, d.entry_seq) AS k FROM n JOIN d ON d.key = n.key OR contains(d.key, n.key) OR contains(n.key, d.key))
SELECT n.id, n.key, h.domain, h.entry_seq FROM n LEFT JOIN h ON n.id = h.id AND h.k = 1""")
def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that all begin alike, looked up in a dictionary of a firm of every supplier whose keys begin alike too, by containment in either direction."""
    c, lit = F.col, F.lit
    digits = F.substring("s_name", 10, 9)
    key = F.when(c("s_suppkey") % 2 == 0, F.concat(lit("customer"), F.substring(digits, 1, 8))).otherwise(F.concat(lit("thecustomer"), digits, lit("holding")))
    entries = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("entry_seq"), key.alias("key"), F.concat(lit("s"), c("s_suppkey").cast("string"), lit(".example.com")).alias("domain"))
    return C.fuzzy_lookup(table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name")), entries).drop("name", "exact")


@query(f"""WITH p AS (SELECT DISTINCT {_PAGE_HOST} AS found FROM pages), w AS (SELECT DISTINCT array_to_string(string_split(found, '.')[-3:], '.') AS wanted FROM p UNION SELECT concat('www.', found) FROM p UNION SELECT substr(found, 4) FROM p)
SELECT found, wanted FROM p, w WHERE contains(found, '.') AND contains(wanted, '.') AND (found LIKE concat('%', wanted) OR wanted LIKE concat('%', found))""")
def related_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' hosts against sites above them, below them, and hosts that begin within a label."""
    found = table(spark, sf_dir, "pages").select(D.host_of(F.col("url")).alias("host"))
    labels = F.split("host", "[.]")
    above = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    wanted = found.select(F.explode(F.array(above, F.concat(F.lit("www."), "host"), F.substr("host", F.lit(4)))).alias("host"))
    return C.related_hosts(found, wanted)


@query(f"""WITH p AS (SELECT page_id, {_PAGE_HOST} AS host, {_TITLE} AS title, page_id % 40 AS company_id FROM pages), c AS (SELECT DISTINCT company_id, host AS domain FROM p WHERE page_id < 40),
h AS (SELECT c.company_id, domain, page_id, title FROM c JOIN p USING (company_id) WHERE title <> '' AND host <> '' AND (suffix(domain, host) OR suffix(host, domain)))
SELECT company_id, domain, substr(string_agg(title, ' · ' ORDER BY page_id), 1, 1500) AS search_snippets FROM h GROUP BY ALL""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as search hits of forty companies, whose candidates are their first pages' hosts. The companies have no name here, so hosts alone decide."""
    c = F.col
    p = table(spark, sf_dir, "pages").select("page_id", D.host_of(c("url")).alias("host"), H.title(c("html")).alias("title"), (c("page_id") % 40).alias("company_id"))
    candidates = p.where("page_id < 40").select("company_id", F.lit("").alias("company"), c("host").alias("domain"))
    return C.search_snippets(candidates, p.select("company_id", c("page_id").alias("seq"), "host", "title", F.lit(None).cast("string").alias("snippet")))


@query("""WITH s AS (SELECT p_brand AS company_id, p_partkey AS seq, p_name AS domain, CAST(floor(p_retailprice) AS INTEGER) % 100 AS score FROM part),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS runner_up FROM s WINDOW w AS (PARTITION BY company_id ORDER BY score DESC, seq))
SELECT company_id, domain, score, runner_up, CASE WHEN score - runner_up < 15 AND runner_up >= 40 THEN 'unverified' WHEN score >= 75 THEN 'verified' WHEN score >= 45 THEN 'unverified' ELSE 'not_found' END AS verification FROM r WHERE k = 1""")
def candidate_close_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    s = table(spark, sf_dir, "part").select(c("p_brand").alias("company_id"), c("p_partkey").alias("seq"), c("p_name").alias("domain"), (F.floor("p_retailprice").cast("int") % 100).alias("score"))
    return W.close_race(s)


@query("""WITH s AS (SELECT p_partkey AS id, p_brand AS domain, p_name AS value, lower(trim(p_name)) AS norm FROM part), f AS (SELECT norm, arg_min(domain, id) AS first FROM s WHERE length(norm) >= 4 GROUP BY norm)
SELECT id, domain, CASE WHEN first IS NULL OR first = domain THEN value END AS value FROM s LEFT JOIN f USING (norm)""")
def uniqueness_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("domain"), F.col("p_name").alias("value"))
    return C.uniqueness_guard(rows, "value", "domain", "id")


@query("""WITH d AS (SELECT p_brand AS domain, p_name AS key, p_partkey AS entry_seq FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY length(key) DESC, entry_seq) AS k FROM d) SELECT domain, key FROM r WHERE k = 1""")
def longest_key_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.longest_key_per_domain(table(spark, sf_dir, "part").select(F.col("p_brand").alias("domain"), F.col("p_name").alias("key"), F.col("p_partkey").alias("entry_seq")))


# fields --------------------------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT p_partkey AS id, p_size * p_size * CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 40 END AS n FROM part), t AS (SELECT id, CASE WHEN id % 4 = 0 THEN n + 1 WHEN id % 4 = 2 THEN n + 5 ELSE n END AS m FROM s)
SELECT id, CASE WHEN m <= 10 THEN '1–10' WHEN m <= 50 THEN '11–50' WHEN m <= 200 THEN '51–200' WHEN m <= 500 THEN '201–500' WHEN m <= 1000 THEN '501–1,000' WHEN m <= 5000 THEN '1,001–5,000' WHEN m <= 10000 THEN '5,001–10,000' ELSE '10,001+' END AS bucket FROM t""")
def headcount_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    n = c("p_size") * c("p_size") * F.when(c("p_partkey") % 3 == 0, 1).when(c("p_partkey") % 3 == 1, 7).otherwise(40)
    k = c("p_partkey") % 4
    said = F.when(k == 0, F.concat(F.lit("More than "), F.format_number(n, 0))).when(k == 1, F.concat(n.cast("string"), F.lit("+"))).when(k == 2, F.concat_ws(" - ", n.cast("string"), (n + 10).cast("string"))).otherwise(n.cast("string"))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), L.headcount(said).alias("bucket"))


_TAXONOMY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}', 'i') THEN '{label}'" for p, label in L.TAXONOMY) + " ELSE NULL END"
_PHRASES = ("GPU maker", "cloud software for banks", "Climate tech VC", "medical device", "robotics lab", "law firm", "hedge fund", "Seed and early fund", "SaaS", "vc", "Saas", "boat building", "retail bank", "game studio", "AI research", "oil and gas", None)


@query("WITH p(k, s) AS (VALUES " + ", ".join(f"({i}, {'NULL' if p is None else repr(p)})" for i, p in enumerate(_PHRASES)) + f"""), q AS (SELECT s_suppkey AS id, s FROM supplier JOIN p ON s_suppkey % {len(_PHRASES)} = k)
SELECT id, CASE WHEN s IS NULL THEN 'Unknown' ELSE coalesce({_TAXONOMY_SQL}, CASE lower(s) WHEN 'vc' THEN 'Venture Capital' ELSE 'Boat Building' END) END AS industry FROM q""")
def industry_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = F.array(*[F.lit(p).cast("string") for p in _PHRASES])
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), L.industry(F.get(phrases, (F.col("s_suppkey") % len(_PHRASES)).cast("int"))).alias("industry"))


# Companies, people and places made of the tables' keys, the same in SQL. Digits become letters, so every key has a name of its own.
_LETTERS = "translate(CAST({0} AS VARCHAR), '0123456789', 'abcdefghij')"
_CITY = "CASE {0} % 5 WHEN 0 THEN 'Austin' WHEN 1 THEN 'Denver' WHEN 2 THEN 'Portland' WHEN 3 THEN 'Columbus' ELSE 'Boise' END"
_STATE = "CASE {0} % 5 WHEN 0 THEN 'Texas' WHEN 1 THEN 'Colorado' WHEN 2 THEN 'Oregon' WHEN 3 THEN 'Ohio' ELSE 'Idaho' END"
_CODE = "CASE {0} % 5 WHEN 0 THEN 'TX' WHEN 1 THEN 'CO' WHEN 2 THEN 'OR' WHEN 3 THEN 'OH' ELSE 'ID' END"
_BUCKET = "CASE WHEN {0} <= 10 THEN '1–10' WHEN {0} <= 50 THEN '11–50' WHEN {0} <= 200 THEN '51–200' WHEN {0} <= 500 THEN '201–500' WHEN {0} <= 1000 THEN '501–1,000' WHEN {0} <= 5000 THEN '1,001–5,000' WHEN {0} <= 10000 THEN '5,001–10,000' ELSE '10,001+' END"
_MADE = (f"SELECT c_custkey AS k, concat('Zor', {_LETTERS.format('c_custkey')}) AS z, {_CITY.format('c_custkey')} AS city, {_STATE.format('c_custkey')} AS state, {_CODE.format('c_custkey')} AS code, "
         f"concat('Jane Do', {_LETTERS.format('c_custkey')}) AS p1, concat('John Ro', {_LETTERS.format('c_custkey')}) AS p2, concat('Ann Le', {_LETTERS.format('c_custkey')}) AS p3, c_custkey * 37 % 12000 + 1 AS n FROM customer")


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, z, city, state, code, p1, p2, p3, n) for every customer: a company's word, a place, three persons, a number."""
    k = F.col("c_custkey")
    letters = F.translate(k.cast("string"), "0123456789", "abcdefghij")
    of = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % 5 + 1).cast("int"))
    person = lambda start: F.concat(F.lit(start), letters)
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(
        k.alias("k"), F.concat(F.lit("Zor"), letters).alias("z"), of("Austin", "Denver", "Portland", "Columbus", "Boise").alias("city"), of("Texas", "Colorado", "Oregon", "Ohio", "Idaho").alias("state"),
        of("TX", "CO", "OR", "OH", "ID").alias("code"), person("Jane Do").alias("p1"), person("John Ro").alias("p2"), person("Ann Le").alias("p3"), (k * 37 % 12000 + 1).alias("n"))


def _case(n: int, *values) -> "F.Column":
    """The value of ``k % n``; what is no Column is a literal."""
    out = F.lit(None)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col("k") % n == i, v if not isinstance(v, (str, bool, int, type(None))) else F.lit(v)).otherwise(out)
    return out


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, CASE k % 7 WHEN 0 THEN {_BUCKET.format('n')} WHEN 1 THEN {_BUCKET.format('(n + 1)')} WHEN 2 THEN {_BUCKET.format('(n + 25)')} WHEN 3 THEN {_BUCKET.format('n')} WHEN 4 THEN {_BUCKET.format('(n + 100)')}
WHEN 5 THEN 'Unknown' ELSE concat('some ', z) END AS bucket FROM m""")
def headcount_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    shown = lambda x: F.format_number(x, 0)
    said = _case(7, F.concat(shown(c("n")), F.lit("+")), F.concat(F.lit("More than "), shown(c("n"))), F.concat(c("n").cast("string"), F.lit("-"), (c("n") + 50).cast("string")), shown(c("n")),
                 F.concat(F.lit("about "), shown(c("n")), F.lit(" to "), shown(c("n") + 200), F.lit(" people")), "-", F.concat(F.lit("some "), c("z")))
    return _made(spark, sf_dir).select(c("k").alias("id"), L.headcount(said).alias("bucket"))


@query(f"WITH m AS ({_MADE}) SELECT k AS id, CASE k % 7 WHEN 0 THEN concat(city, ', ', code) WHEN 1 THEN concat(city, ', Japan') WHEN 3 THEN 'London' WHEN 4 THEN concat(city, ', ', code) WHEN 6 THEN concat(city, ', ', code) END AS place FROM m")
def headquarters_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    pair = F.concat_ws(", ", "city", "state")
    said = _case(7, F.concat(F.lit("headquartered in "), pair), F.concat(c("city"), F.lit(", Aichi, Japan")), F.concat(c("z"), F.lit(", osaka")), "London", F.concat(F.concat_ws(", ", "city", "code"), F.lit(", USA")), c("z"),
                 F.concat(F.lit("based in "), c("city"), F.lit(", "), c("code")))
    return _made(spark, sf_dir).select(c("k").alias("id"), L.hq(said).alias("place"))


@query(f"WITH m AS ({_MADE}) SELECT k AS id, CASE k % 5 WHEN 0 THEN concat(p1, '; ', p2) WHEN 1 THEN p1 WHEN 2 THEN 'Unknown' WHEN 3 THEN 'not_applicable' ELSE p3 END AS names FROM m")
def founder_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    said = _case(5, F.concat_ws(" and ", "p1", "p2"), F.concat(c("p1"), F.lit(" (CEO), "), F.lower("p1"), F.lit(", "), c("z")), "The Team", "not_applicable", F.concat(c("p3"), F.lit(", CEO")))
    return _made(spark, sf_dir).select(c("k").alias("id"), L.founders(said).alias("names"))


@query(r"""SELECT doc_id, regexp_extract(coalesce(text, ''), '[A-Za-z]+ [A-Za-z]+ [A-Za-z]+') AS note FROM documents""")
def notes_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words of each document between what a pipeline says of itself."""
    said = F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+ [A-Za-z]+ [A-Za-z]+", 0)
    raw = F.concat(F.lit("Score "), (F.col("doc_id") % 90 + 10).cast("string"), F.lit(" · "), said, F.lit(" | DNS | Verifying selected domain..."))
    return table(spark, sf_dir, "documents").select("doc_id", L.notes(raw).alias("note"))


def _rule_sql(text: str, patterns: tuple[str, ...]) -> str:
    return "(" + " + ".join([f"CAST(regexp_matches({text}, '\\b{p}\\b', 'i') AS INTEGER)" for p in patterns] or ["0"]) + ")"


_CORPORA = ("Acme is a fabless semiconductor company that designs and sells GPUs", "An observability platform and SaaS provider for the semiconductor industry", "A venture capital firm for seed and early-stage founders",
            "They run an online marketplace where merchants sell apparel", "a technology company with many offices around the world", "short", "nothing that any rule would know about at all, really")


@query("WITH c(k, p) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(_CORPORA)) + "), g AS (SELECT doc_id, p AS said, trim(coalesce(text, '')) AS t FROM documents LEFT JOIN c ON doc_id % 10 = k), "
       "d AS (SELECT doc_id, substr(CASE WHEN said IS NULL THEN t WHEN t = '' THEN said ELSE concat(said, ' · ', t) END, 1, 4000) AS p, substr(concat(said, ' ', t), 1, 12000) AS f FROM g), s AS (SELECT doc_id, p, "
       + "[" + ", ".join(f"struct_pack(label := '{label}', place := {i}, least := {least}, strong := {_rule_sql('p', strong)}, score := {_rule_sql('p', strong)} * 4 + {_rule_sql('p', pos)} * 2 - CASE WHEN {_rule_sql('p', strong)} = 0 THEN 3 * {_rule_sql('f', neg)} ELSE 0 END, no := {_rule_sql('p', neg)})"
                         for i, (label, strong, pos, neg, least) in enumerate(I.RULES)) + "] AS r FROM d), "
       "t AS (SELECT doc_id, p, list_filter(r, lambda x: NOT (x.no > 0 AND x.strong = 0) AND x.score >= x.least) AS r FROM s), "
       "u AS (SELECT doc_id, p, (SELECT arg_max(v, v.score * 100 - v.place) FROM (SELECT unnest(r) AS v)) AS b FROM t) "
       "SELECT doc_id, CASE WHEN length(p) < 20 THEN 'Unknown' WHEN b IS NOT NULL THEN CASE WHEN b.strong > 0 OR b.score >= b.least + 2 THEN b.label ELSE 'Unknown' END WHEN regexp_matches(p, '\\btechnology company\\b', 'i') THEN 'Technology' ELSE 'Unknown' END AS industry FROM u")
def industry_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every document; seven of ten have a sentence about a company before it."""
    k = F.col("doc_id") % 10
    said = F.when(k < len(_CORPORA), F.get(F.array(*map(F.lit, _CORPORA)), k.cast("int")))
    return I.classify(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", F.array(said, F.col("text")).alias("parts"))).select("doc_id", "industry")


#: Capitalised pairs, numbers with what follows, and sentence openings: patterns with groups that occur in the texts.
_HITS = {"capitals": r"\b([A-Z][a-z]+) ([A-Z][a-z]+)\b", "number": r"\b(\d+)[.,]?\d*", "mail": r"([a-z0-9.]+)@([a-z0-9.]+)", "opening": r"[.!?] ([A-Z])"}
_HITS_SQL = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS pattern, text, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 1) AS gs FROM documents" for name, p in _HITS.items())


@query(f"""WITH a AS ({_HITS_SQL}), n AS (SELECT doc_id, pattern, text, ms, gaps, gs, unnest(range(1, len(ms) + 1)) AS nth FROM a),
s AS (SELECT doc_id, pattern, CAST(nth AS INTEGER) AS nth, ms[nth] AS match, gs[nth] AS first_group, CAST(list_sum(list_transform(gaps[1:nth], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:nth - 1], lambda g: length(g))), 0) AS INTEGER) AS start, text FROM n)
SELECT doc_id, pattern, nth, start, match, first_group, substr(text, greatest(start - 12, 0) + 1, start - greatest(start - 12, 0) + length(match) + 9) AS around FROM s""")
def regex_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of four patterns in all documents, with its place and what stands around it."""
    found = scan.regex_hits(table(spark, sf_dir, "documents"), _HITS, ["doc_id"], before=12, after=9)
    return found.select("doc_id", "pattern", "nth", "start", "match", F.get("groups", F.lit(0)).alias("first_group"), F.col("window").alias("around"))


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, CASE WHEN k % 4 = 0 THEN concat(city, ', ', code) ELSE '' END AS hq, CASE k % 4 WHEN 0 THEN {_BUCKET.format('n')} WHEN 1 THEN concat({_BUCKET.format('(n + 25)')}, ',', {_BUCKET.format('(n + 50)')}) ELSE '' END AS headcount,
CASE WHEN k % 4 = 2 THEN p1 ELSE '' END AS founders FROM m""")
def prose_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    shown = lambda x: F.format_number(x, 0)
    said = _case(4, F.concat(c("z"), F.lit(" Labs is headquartered in "), c("city"), F.lit(", "), c("state"), F.lit(". It employs about "), shown(c("n")), F.lit(" people.")),
                 F.concat(F.lit("We have an office in Paris, France. "), shown(c("n")), F.lit("-"), shown(c("n") + 50), F.lit(" employees work here.")),
                 F.concat(c("z"), F.lit(" Labs was founded by "), c("p1"), F.lit(" in 1999. Followers: 9,000 employees of others, users.")), F.concat(c("p1"), F.lit(", Founder of Other Corp, said so.")))
    rows = _made(spark, sf_dir).select("k", F.concat(c("z"), F.lit(" Labs")).alias("company"), said.alias("t"))
    join = lambda hits: F.array_join(F.transform(hits, lambda h: h["value"]), ",")
    hq = F.array_join(F.array_distinct(F.transform(X.hq_hits(c("t")), lambda h: h["value"])), ",")
    return rows.select(c("k").alias("id"), hq.alias("hq"), join(X.headcount_hits(c("t"))).alias("headcount"), join(X.founder_hits(c("t"), c("company"))).alias("founders"))


@query(f"WITH m AS ({_MADE}), n AS (SELECT k, unnest(['Nvidia', z, concat(z, ' Inc, Bar'), concat(z, ' Widgets'), concat(p1, ' – CFO\t', z, ' (x)'), concat(p2, ', Partner')]) AS name, unnest(range(6)) AS seq FROM m) SELECT k AS paste_id, CAST(seq AS INTEGER) AS seq, name FROM n".replace("\\t", "' || chr(9) || '"))
def pasted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    text = F.concat(lit("• Nvidia, "), c("z"), lit("\n1. "), c("z"), lit(" Inc, Bar\r\n\n[3] "), c("z"), lit(" Widgets\n"), c("p1"), lit(" – CFO\t"), c("z"), lit(" (x)\n"), c("p2"), lit(", Partner\n"))
    return readers.pasted_names(_made(spark, sf_dir).select(c("k").alias("paste_id"), text.alias("text"))).select("paste_id", "seq", "name")


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, CASE k % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 3 THEN 'near-exact' ELSE 'none' END AS kind,
CAST(CASE k % 5 WHEN 0 THEN 50 + 25 + 20 + 15 + 20 WHEN 1 THEN 50 + 25 + 15 + 20 WHEN 2 THEN -100 WHEN 3 THEN 25 + 15 + 20 ELSE 0 END AS DOUBLE) AS score, k % 5 IN (0, 1, 3) AS ok FROM m""")
def wiki_page_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = F.col, F.lit(None).cast("string")
    title = _case(5, F.concat(c("z"), F.lit(" (company)")), c("z"), F.concat(c("z"), F.lit(" (film)")), F.concat(c("z"), F.lit(" Steel")), "Other")
    name = _case(5, F.concat(c("z"), F.lit(" Inc")), F.concat(c("z"), F.lit(", Inc.")), c("z"), c("z"), c("z"))
    j = N.judge_wiki_page(title, name, F.lit(None).cast("array<string>"), none, none, none, none, F.lit(None).cast("int"), F.lit(None).cast("int"))
    return _made(spark, sf_dir).select(c("k").alias("id"), j.alias("j")).select("id", "j.kind", "j.score", "j.ok")


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, CASE k % 4 WHEN 0 THEN 100 + 15 + 30 WHEN 1 THEN 100 - 40 + 30 ELSE 0 END AS score, CASE k % 4 WHEN 2 THEN concat('plum', lower(z), ' alley') WHEN 3 THEN '' ELSE lower(z) END AS plain,
CASE k % 4 WHEN 2 THEN FALSE WHEN 3 THEN TRUE ELSE length(z) <= 6 END AS ambiguous, CASE k % 4 WHEN 0 THEN 60 + 20 WHEN 1 THEN 60 + 20 ELSE 0 END AS simple FROM m""")
def first_generation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    low = F.lower("z")
    n = _case(4, F.concat(c("z"), lit(", Inc.")), F.concat(lit("The "), c("z"), lit(" Co")), F.concat(lit("Plum"), low, lit(" Alley")), "")
    d = _case(4, F.concat(lit("www."), low, lit(".com")), F.concat(low, lit(".zz")), "qqq.com", "a.com")
    s = _case(4, c("z"), F.concat(c("z"), lit(" Ltd")), lit(None).cast("string"), "")
    df = _made(spark, sf_dir).select("k", n.alias("n"), d.alias("d"), s.alias("s"))
    return df.select(c("k").alias("id"), N.domain_score(c("d"), c("n"), c("s")).alias("score"), N.plain_name(c("n")).alias("plain"), N.is_ambiguous_name(c("n")).alias("ambiguous"), N.domain_for_name(c("n"), c("d")).alias("simple"))


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, CASE WHEN k % 5 = 4 THEN 'Unknown' ELSE concat(city, ', ', code) END AS location, CASE WHEN k % 5 = 4 THEN 'Unknown' ELSE {_BUCKET.format('(n + 25)')} END AS headcount, CASE WHEN k % 5 = 4 THEN 'Unknown' ELSE p1 END AS founders,
CASE WHEN k % 5 = 4 THEN 'Unknown' ELSE 'Venture Capital' END AS industry FROM m""")
def search_corpus_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    shown = lambda x: F.format_number(x, 0)
    said = F.concat(c("z"), lit(" is a venture capital firm based in "), c("city"), lit(", "), c("code"), lit(" and has "), shown(c("n")), lit("-"), shown(c("n") + 50), lit(" employees. It was founded by "), c("p1"), lit(" in 1999."))
    rows = _made(spark, sf_dir).select(c("k").alias("id"), F.when(c("k") % 5 == 4, "short").otherwise(said).alias("t"))
    return rows.select("id", N.corpus_fields(c("t")).alias("f"), N.infer_industry(c("t")).alias("industry")).select("id", "f.location", "f.headcount", "f.founders", "industry")


# names, hosts, fields and pages made of the tables' keys -----------------------------------------------------------------
@query(f"""WITH m AS ({_MADE}) SELECT k AS id, concat(z, '|', z, ' Robotics') AS variants, lower(z) || ' robotics' AS plain, CASE WHEN k % 2 = 0 THEN 'Unknown' ELSE z END AS chosen, concat(z, ' & <b> "', p1, '"') AS decoded,
concat(upper(left(z, 1)), substr(z, 2), CASE WHEN k % 2 = 0 THEN ' LLC' ELSE ' Labs' END) AS pretty, k % 2 = 0 AS is_person, lower(z) AS picked, concat(lower(z), 'robotics') AS key, lower(z) || 'robotics' AS core_key, concat('z', 'r') AS acronym, concat(lower(z), ',robotics') AS tokens FROM m""")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    full = F.concat(c("z"), lit(" Robotics ("), c("z"), lit(")"))
    df = _made(spark, sf_dir).withColumns({"full": full, "plain": F.concat(lit("  "), c("z"), lit(" \u00a0 Robotics "))})
    forms = T.decisive_forms(c("full"))
    return df.select(c("k").alias("id"), F.array_join(T.name_variants(c("full")), "|").alias("variants"), T.normalized(c("plain")).alias("plain"), T.prefer(_case(2, "-", c("z")), _case(2, "unknown", "x")).alias("chosen"),
                     T.decode_entities(F.concat(c("z"), lit("&nbsp;&amp;&nbsp;&lt;b&gt; &quot;"), c("p1"), lit("&quot;"))).alias("decoded"), N.pretty_key(F.concat(c("z"), _case(2, " llc", " labs"))).alias("pretty"),
                     N.is_non_entity(F.concat(c("p1"), _case(2, " (Moderator)", " (Speaker)"))).alias("is_person"), N.picker_query(F.concat(lit("The "), c("z"), lit(" Holdings, Inc"))).alias("picked"), forms["key"].alias("key"),
                     forms["core_key"].alias("core_key"), forms["acronym"].alias("acronym"), F.array_join(T.distinctive_tokens(F.concat(c("z"), lit(" Robotics Vista The"))), ",").alias("tokens"))


@query(f"""WITH m AS ({_MADE}), p AS (SELECT *, lower(z) AS l FROM m) SELECT k AS id, CASE WHEN k % 2 = 0 THEN concat('shop.', l, '.com') END AS host, concat('shop.', l, '.com,', l, '.com,', l, 'robotics.com,', l, '.robotics') AS guesses,
k % 3 <> 2 AS matches, k % 2 = 0 AS sibling, k % 2 = 0 AS same FROM p""")
def host_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    low = F.lower("z")
    df = _made(spark, sf_dir)
    return df.select(c("k").alias("id"), D.text_host(_case(2, F.concat(lit("see [https://shop."), low, lit(".com/x] now")), "no address")).alias("host"),
                     F.array_join(D.official_guesses(F.concat(lit("https://shop."), low, lit(".com/")), F.concat(c("z"), lit(" Robotics"))), ",").alias("guesses"),
                     D.matches_expected(F.concat(lit("www."), low, lit(".com")), F.concat(_case(3, "", "ir.", "my"), low, lit(".com")), F.array(lit(""))).alias("matches"),
                     D.is_regional_sibling(F.concat(low, _case(2, ".de", ".org")), F.concat(low, lit(".com"))).alias("sibling"), D.same_site(F.concat(lit("a."), low, lit(".com")), F.concat(low, _case(2, ".com", ".net"))).alias("same"))


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, 'Venture Capital' AS industry, concat(city, ', ', code) AS location, {_BUCKET.format('n')} AS headcount, p1 AS founders, concat('Note on ', z) AS notes, CASE k % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender,
k % 2 = 0 AS executive, CASE WHEN k % 2 = 0 THEN 'Unknown' ELSE z END AS value, CASE WHEN k % 2 = 0 THEN 'no_reliable_source_found' END AS unknown_reason, CASE k % 4 WHEN 0 THEN 'Nonprofit / Foundation' WHEN 1 THEN 'Education' WHEN 2 THEN 'Government' END AS kind,
CASE k % 4 WHEN 0 THEN 'Nonprofit / Foundation' WHEN 1 THEN 'Education' WHEN 2 THEN 'Government' ELSE 'Software' END AS guess, CASE WHEN k % 2 = 0 THEN concat(city, ', ', code) ELSE 'Unknown' END AS inferred, 1900 + k % 100 AS year, concat(p1, '; ', p2) AS explicit, p3 AS bios,
CASE k % 3 WHEN 0 THEN 'unknown_pipeline_error' WHEN 1 THEN 'unknown_no_data' END AS founders_unknown FROM m""")
def field_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    none = lit(None).cast("string")
    place = F.concat_ws(", ", "city", "code")
    record = L.field_record(_case(2, "-", c("z")), lit("json_ld"), lit("high"), lit("2024-01-01").cast("timestamp"))
    name, domain = F.concat(c("z"), _case(4, " Foundation", " College", "", "")), F.concat(F.lower("z"), _case(4, ".org", ".com", ".gov", ".com"))
    return _made(spark, sf_dir).select(
        c("k").alias("id"), *L.finalize(lit("vc"), F.concat(place, lit(", USA")), F.format_number("n", 0), F.concat(c("p1"), lit(" (Founder)")), F.concat(lit("Note on "), c("z"), lit(" | DNS"))),
        L.gender(_case(3, "http://x/Q6581097", "", ""), _case(3, none, "Woman", "other")).alias("gender"), L.is_executive_only(_case(2, "CEO", "Co-Founder and CEO")).alias("executive"), record["value"].alias("value"), record["unknown_reason"].alias("unknown_reason"),
        L.entity_industry(name, domain).alias("kind"), N.guess_industry(name, domain, lit("a platform")).alias("guess"), N.infer_location(_case(2, F.concat(lit("offices at "), place), "nowhere")).alias("inferred"),
        H.year(F.concat(lit("since "), (c("k") % 100 + 1900).cast("string"), lit(" or so"))).cast("long").alias("year"), N.explicit_founders(F.concat(lit("It was founded by "), c("p1"), lit(" in 1999. "), c("p2"), lit(" is a co-founder."))).alias("explicit"),
        N.founder_bios(F.concat(c("p3"), lit(" - founding partner\n"), c("p1"), lit(" - CEO"))).alias("bios"),
        N.founders_unknown_status(_case(3, "", "-", c("p1")), F.when(c("k") % 3 == 0, F.array(lit("timeout")))).alias("founders_unknown"))


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, 'Robots' AS industry, 1999 AS founded_year, concat(city, ', ', state) AS hq, concat(z, ' Works') AS former, CASE WHEN k % 2 = 0 THEN concat(p1, '; ', p2) ELSE concat(p1, '; ', p3) END AS founders, concat('https://', lower(z), '.com/') AS canonical,
concat('© 2020 ', z, ' Labs') AS line, k % 2 = 0 AS confirmed, k % 2 = 0 AS full_name FROM m""")
def page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    wiki = F.concat(lit("{{Infobox company\n| industry = [[Robot|Robots]]\n| founded = {{start date|1999}} in 1999<br/>\n| headquarters = [["), c("city"), lit("]], "), c("state"), lit("\n| former_name = "), c("z"), lit(" Works\n| founders = "),
                    _case(2, F.concat(lit("[["), c("p1"), lit("]], [["), c("p2"), lit(" (engineer)|J]]")), F.concat(c("p1"), lit(" and "), c("p3"))), lit("\n}}\n"))
    page = F.concat(lit("<link rel='canonical' href='https://"), F.lower("z"), lit(".com/'>"))
    told = F.concat(_case(2, F.concat(c("z"), lit(" Labs")), "Other firm"), lit(" builds robots. "))
    box = H.infobox(wiki)
    name = F.concat(c("z"), lit(" Labs"))
    return _made(spark, sf_dir).select(c("k").alias("id"), box["industry"].alias("industry"), box["founded_year"].alias("founded_year"), box["hq"].alias("hq"), box["former_names"].alias("former"), F.array_join(H.infobox_founders(wiki), "; ").alias("founders"),
                                       H.canonical(page).alias("canonical"), H.copyright_line(F.concat(lit("x © 2020 "), name, lit(". y"))).alias("line"), H.confirms_company(name, told).alias("confirmed"), N.full_name_present(name, told).alias("full_name"))


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, CASE WHEN k % 3 = 2 THEN 'Unknown' ELSE 'Venture Capital' END AS industry, CASE WHEN k % 3 = 2 THEN 'Unknown' ELSE concat(city, ', ', code) END AS location, CASE WHEN k % 3 = 2 THEN 'Unknown' ELSE concat(format('{{:,}}', n), ' - ', format('{{:,}}', n + 50)) END AS headcount,
CASE WHEN k % 3 = 2 THEN 'Unknown' ELSE p1 END AS founders, CASE WHEN k % 3 = 2 THEN 'Unknown' ELSE concat(z, ' is a growth equity firm of note') END AS notes, CASE k % 3 WHEN 2 THEN 'scrape-unconfirmed' ELSE 'scrape' END AS source FROM m""")
def page_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    shown = lambda x: F.format_number(x, 0)
    html = F.concat(lit("<html><head><title>Home</title><meta name='description' content='"), c("z"), lit(" is a growth equity firm of note'></head><body><div id='about'>We are based in "), c("city"), lit(", "), c("code"), lit(". Founder: "), c("p1"),
                    lit(" and friends.</div><p>"), shown(c("n")), lit(" - "), shown(c("n") + 50), lit(" employees</p><footer>© 2020</footer></body></html>"))
    company = _case(3, c("z"), F.concat(c("z"), lit(" Labs")), "Quux Widgets")
    return _made(spark, sf_dir).select(c("k").alias("id"), N.page_fields(html, company).alias("f")).select("id", "f.*")


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, CASE k % 4 WHEN 0 THEN p1 WHEN 1 THEN p1 ELSE '' END AS founders, CASE WHEN k % 2 = 0 THEN '' ELSE {_BUCKET.format('(n + 10)')} END AS headcount, CASE WHEN k % 4 = 3 THEN 'Unknown' ELSE p1 END AS person,
CASE WHEN k % 4 = 3 THEN 0 ELSE 1 END AS hits, CASE k % 4 WHEN 3 THEN 0 ELSE 1 END AS windows FROM m""")
def team_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Founders in a team page's lines: the company's own page need not name it, another's must."""
    c, lit = F.col, F.lit
    said = F.concat(_case(4, "Meet the crew", F.concat(lit("Meet the "), c("z"), lit(" crew")), "Meet the crew", "Our offices"), lit(".\n"), _case(4, F.concat(c("p1"), lit(", Co-Founder")), F.concat(c("p1"), lit(", Co-Founder")), F.concat(c("p1"), lit(", Co-Founder")), "and more"), lit(" since then"))
    staff = F.concat(_case(2, "Meet the team. ", "Meet all. "), lit("We are "), F.format_number(c("n") + 10, 0), lit(" - "), F.format_number(c("n") + 10, 0), lit(" people"))
    df = _made(spark, sf_dir).withColumns({"said": said, "staff": staff, "team": c("k") % 4 == 0})
    evidence = X.founder_evidence(c("said"))
    return df.select(c("k").alias("id"), F.array_join(F.transform(X.founder_hits(c("said"), c("z"), c("team")), lambda h: h["value"]), ",").alias("founders"),
                     F.array_join(F.transform(X.headcount_hits(c("staff"), lit(True)), lambda h: h["value"]), ",").alias("headcount"), X.first_person(c("said"), c("z")).alias("person"), F.size(evidence["hits"]).alias("hits"), F.size(evidence["windows"]).alias("windows"))


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, k % 3 <> 2 AS place, k % 2 = 0 AS headcount, k % 3 = 0 AS founders, k % 3 <> 2 AS persons, CASE k % 3 WHEN 0 THEN concat(lower(p1), ',', lower(p2)) WHEN 1 THEN lower(p1) ELSE '' END AS shared, k % 3 = 0 AS industries, k % 2 = 0 AS compatible FROM m""")
def equivalences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    both = lambda *n: F.concat_ws("; ", *n)
    got = _case(3, both("p1", "p2"), c("p1"), c("p3"))
    return _made(spark, sf_dir).select(
        c("k").alias("id"), S.location_equivalent(F.concat_ws(", ", "city", "code"), F.concat(_case(3, c("city"), "Nowhere", "Nowhere"), lit(", "), c("code"), lit(", USA")), F.array(_case(3, "", c("city"), ""))).alias("place"),
        S.headcount_equivalent(lit("51-200"), _case(2, "about 60 to 80", "1,000+")).alias("headcount"), S.founders_equivalent(got, both("p2", "p1")).alias("founders"), S.founders_accurate(got, both("p2", "p1")).alias("persons"),
        F.array_join(S.founder_overlap(got, both("p2", "p1")), ",").alias("shared"), I.equivalent(_case(3, "Venture Capital", "Banking", "Unknown"), _case(3, "Private Equity", "Energy", "Banking")).alias("industries"),
        N.industries_compatible(_case(2, "software", "Robotics"), _case(2, "saas technology", "Oil")).alias("compatible"))


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, CASE k % 4 WHEN 0 THEN concat(upper(left(z, 1)), substr(z, 2), ', TX') WHEN 1 THEN concat(z, ', France') WHEN 2 THEN concat(z, ', CA') END AS value, CASE k % 4 WHEN 0 THEN concat(lower(z), ', texas') WHEN 1 THEN concat(z, ', france') WHEN 2 THEN concat(lower(z), ', california') END AS raw,
CASE WHEN k % 2 = 0 THEN '51–200' ELSE {_BUCKET.format('n')} END AS headcount, k % 3 = 0 AS open FROM m""")
def provider_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit, low = F.col, F.lit, F.lower("z")
    none = lit(None).cast("string")
    hq = P.headquarters(_case(4, low, c("z"), none, none), _case(4, "texas", none, none, none), _case(4, "united states", "france", none, none), _case(4, none, none, F.concat(low, lit(", california, united states")), "Mars"))
    return _made(spark, sf_dir).select(c("k").alias("id"), hq["value"].alias("value"), hq["raw"].alias("raw"), P.headcount(_case(2, "51-200", none), c("n")).alias("headcount"),
                                       P.needs_fallback(_case(3, "-", "Paris", "Paris"), _case(3, "json_ld", "json_ld", "official_about"), lit("high")).alias("open"))


@query(f"WITH m AS ({_MADE}) SELECT count(*) FILTER (WHERE k % 10 <> 0 AND k % 3 <> 0) AS requests, count(*) FILTER (WHERE k % 10 <> 0 AND k % 3 = 0) AS cache_hits, count(*) FILTER (WHERE k % 10 > 6) AS matches, count(*) FILTER (WHERE k % 10 IN (4, 5, 6)) AS rejected, count(*) FILTER (WHERE k % 10 = 1) AS not_found, count(*) FILTER (WHERE k % 10 IN (2, 3)) AS errors FROM m")
def provider_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.counts(provider_validate(spark, sf_dir).withColumn("from_cache", F.col("id") % 3 == 0))


@query(f"""WITH m AS ({_MADE}) SELECT concat('"', z, '","', lower(z), '.com","Fintech","","', city, '","', p1, '","Note on ', z, '"') AS line FROM m""")
def batch_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    rows = _made(spark, sf_dir).select(c("z").alias("company_name"), F.concat(F.lower("z"), lit(".com")).alias("website"), lit("Fintech").alias("industry"), lit(None).cast("string").alias("headcount"), c("city").alias("location"), c("p1").alias("founders"),
                                       F.concat(lit("Note on "), c("z"), lit(" | SPARQL")).alias("notes"))
    return writers.batch_csv_rows(rows)


@query(f"""WITH m AS ({_MADE}), r AS (SELECT k, lower(z) AS domain, CASE k % 4 WHEN 0 THEN 'Venture Capital' WHEN 1 THEN 'Fintech' WHEN 2 THEN 'Unknown' ELSE concat('Robots ', z) END AS industry FROM m), f AS (SELECT industry, min(k) AS k FROM r GROUP BY industry)
SELECT r.k AS id, CASE WHEN r.k = f.k THEN industry ELSE 'Unknown' END AS industry FROM r JOIN f USING (industry)""")
def once_per_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    rows = _made(spark, sf_dir).select(c("k").alias("seq"), F.lower("z").alias("domain"), _case(4, "vc", "fintech", "-", F.concat(lit("robots "), c("z"))).alias("industry"))
    return C.once_per_owner(rows).select(c("seq").alias("id"), "industry")


@query(f"""WITH m AS ({_MADE}) SELECT count(*) AS companies, count(*) FILTER (WHERE k % 3 = 0) AS correct, {{0}} AS accuracy_pct, {{1}} AS industry_coverage_pct, {{2}} AS location_coverage_pct, count(*) FILTER (WHERE k % 2 = 0) AS industry_unknown, count(*) FILTER (WHERE k % 5 = 0) AS location_unknown,
{{3}} AS unknown_pct, {{4}} AS high_pct, {{5}} AS medium_pct, {{6}} AS low_pct, CAST(floor(avg(n) + 0.5) AS BIGINT) AS mean_ms, CAST(sum(k % 7) AS BIGINT) AS timeouts FROM m""".format(*["CASE WHEN {1} > 0 THEN floor({0} / {1} * 1000 + 0.5) / 10 END".format(a, b) for a, b in (
    ("count(*) FILTER (WHERE k % 3 = 0)", "count(*)"), ("count(*) FILTER (WHERE k % 3 = 0 AND k % 2 <> 0)", "count(*) FILTER (WHERE k % 3 = 0)"), ("count(*) FILTER (WHERE k % 3 = 0 AND k % 5 <> 0)", "count(*) FILTER (WHERE k % 3 = 0)"),
    ("(count(*) FILTER (WHERE k % 2 = 0) + count(*) FILTER (WHERE k % 5 = 0))", "(count(*) * 2)"), ("sum(k % 3)", "sum(k % 3 + 2 + k % 4)"), ("sum(2)", "sum(k % 3 + 2 + k % 4)"), ("sum(k % 4)", "sum(k % 3 + 2 + k % 4)"))]))
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = _made(spark, sf_dir).select((c("k") % 3 == 0).alias("correct"), _case(2, "-", c("z")).alias("industry"), _case(5, "Unknown", c("city"), c("city"), c("city"), c("city")).alias("location"), (c("k") % 3).alias("high"), F.lit(2).alias("medium"), (c("k") % 4).alias("low"),
                                       c("n").alias("elapsed_ms"), (c("k") % 7).alias("timeouts"))
    return M.summarize_run(rows, ("industry", "location"))


@query("SELECT p_brand AS company_id, p_partkey AS seq, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 10 DESC, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END DESC, p_partkey) AS INTEGER) AS place FROM part")
def candidates_best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "part").select(c("p_brand").alias("company_id"), c("p_partkey").alias("seq"), (c("p_size") % 10).alias("score"), F.when(c("p_partkey") % 3 == 0, "high").otherwise("low").alias("confidence"))
    return M.best_first(rows).select("company_id", "seq", "place")


@query(f"""WITH m AS ({_MADE}) SELECT k AS company_id, concat('http://', CASE WHEN k % 2 = 0 THEN 'www.' ELSE '' END, lower(z), '.com', CASE WHEN k % 3 = 0 THEN '/' ELSE '' END) AS value, NULL AS cached, CAST(floor((k - 1) / 50) AS BIGINT) AS chunk FROM m WHERE k % 7 = 0
UNION ALL SELECT k, concat('http://', CASE WHEN k % 2 = 0 THEN 'www.' ELSE '' END, lower(z), '.com', CASE WHEN k % 3 = 0 THEN '/' ELSE '' END), z, CAST(floor((k - 1) / 50) AS BIGINT) FROM m WHERE k % 7 <> 0""")
def facts_and_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a site by any spelling of its address, and its provider's answer from the cache: every seventh is too old, and each has an older one."""
    c, lit = F.col, F.lit
    df = _made(spark, sf_dir).select(c("k").alias("company_id"), "k", "z", F.concat(F.lower("z"), lit(".com")).alias("domain"))
    url = F.concat(lit("http://"), F.when(c("k") % 2 == 0, "www.").otherwise(""), c("domain"), F.when(c("k") % 3 == 0, "/").otherwise(""))
    facts = df.select(url.alias("url"), lit("P856").alias("property"), url.alias("value"), c("z").alias("label"))
    got = readers.facts_by_site(df, facts)
    day = lambda s: lit(s).cast("timestamp")
    newest = df.select("domain", F.when(c("k") % 7 == 0, day("2024-01-01")).otherwise(day("2024-05-20")).alias("fetched_at"), c("z").alias("company"))
    older = df.select("domain", day("2024-01-01").alias("fetched_at"), lit("old").alias("company"))
    requests = P.chunks(df.select("company_id", "domain", (c("k") - 1).alias("seq")))
    return P.through_cache(requests, newest.unionByName(older), day("2024-06-01")).join(keyed(got), "company_id").select("company_id", "value", "cached", "chunk")


@query(f"""WITH m AS ({_MADE}) SELECT k AS company_id, CAST(seq AS INTEGER) AS seq, q AS query FROM (SELECT k, unnest(range(4)) AS seq, unnest([concat(z, ' Labs Inc'), concat(z, ' Labs Inc official website'), concat(z, ' Labs Inc company'), concat(z, ' Labs')]) AS q FROM m WHERE k % 2 = 0
UNION ALL SELECT k, unnest(range(5)), unnest([concat(z, ' Labs Inc'), concat(z, ' Labs Inc official website'), concat(z, ' Labs Inc company'), concat(z, ' Labs Inc robots'), concat(z, ' Labs')]) FROM m WHERE k % 2 = 1)""")
def company_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.search_queries(_made(spark, sf_dir).select(F.col("k").alias("company_id"), F.concat("z", F.lit(" Labs Inc")).alias("company"), _case(2, "", "robots").alias("context")))


@query(f"""WITH m AS ({_MADE}) SELECT k AS company_id, CAST(seq AS INTEGER) AS seq, q AS query FROM (SELECT k, unnest(range(3)) AS seq, unnest([concat(z, ' Labs Inc'), concat(z, ' Labs'), z]) AS q FROM m WHERE k % 2 = 0)""")
def lonely_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    m = _made(spark, sf_dir).select(c("k").alias("company_id"), F.concat("z", F.lit(" Labs (Inc)")).alias("company"))
    return readers.shortened_queries(m, m.where("company_id % 2 = 1"))


@query(f"""WITH m AS ({_MADE}), p AS (SELECT *, lower(z) AS l FROM m) SELECT k AS company_id, CAST(seq AS INTEGER) AS seq, d AS domain, CASE WHEN seq = 0 THEN 'wikidata_official' ELSE 'brand_guess' END AS source FROM (
SELECT k, unnest(range(4)) AS seq, unnest([concat('shop.', l, '.com'), concat(l, '.com'), concat(l, 'robotics.com'), concat(l, '.robotics')]) AS d FROM p WHERE k % 2 = 0 UNION ALL SELECT k, 0, concat(l, 'robotics.com') FROM p WHERE k % 2 = 1)""")
def brand_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    m = _made(spark, sf_dir).select(c("k").alias("company_id"), F.concat("z", lit(" Robotics")).alias("company"), F.concat(lit("https://shop."), F.lower("z"), lit(".com")).alias("official_site"))
    return readers.brand_guesses(m.select("company_id", "company"), m.where("company_id % 2 = 0").select("company_id", "official_site")).select("company_id", "seq", "domain", "source")


@query(f"""WITH m AS ({_MADE}) SELECT k AS company_id, concat(p1, ' ', z) AS full_name, 'Co-Founder & CEO' AS title, CASE k % 3 WHEN 0 THEN 'mixed' WHEN 1 THEN 'female' ELSE 'Unknown' END AS team FROM m WHERE k % 4 <> 3""")
def provider_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    m = _made(spark, sf_dir)
    site = F.concat(F.lower("z"), lit(".com"))
    people = m.select(c("k").alias("company_id"), site.alias("domain"), c("z").alias("company"), F.concat_ws("  ", "p1", "z").alias("full_name"), _case(4, "Co-Founder & CEO", "Co-Founder & CEO", "Co-Founder & CEO", "CEO").alias("title"),
                      F.concat(lit("https://www."), site).alias("job_company_website"), lit("x").alias("job_company_name"))
    genders = m.select(c("k").alias("company_id"), S.team_gender(_case(3, F.array(lit("male"), lit("female")), F.array(lit("female")), F.array(lit("male"))), lit("partial")).alias("team"))
    return P.founder_people(people).join(genders, "company_id").select("company_id", "full_name", "title", "team")


# decisions -----------------------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS entity_id,
CASE WHEN k % 10 IN (0, 2, 5, 8) THEN 'accept' WHEN k % 10 IN (4, 6) THEN 'allow_unknown' WHEN k % 10 = 7 THEN 'retry_needed' ELSE 'reject' END AS decision,
CASE k % 10 WHEN 0 THEN 'p31_organization' WHEN 1 THEN 'p31_media' WHEN 2 THEN 'p31_media_with_context' WHEN 3 THEN 'p31_non_organization' WHEN 4 THEN 'no_p31' WHEN 5 THEN 'p31_org_subclass' WHEN 6 THEN 'p31_unlisted' WHEN 7 THEN 'transient'
WHEN 8 THEN 'p31_organization' ELSE 'p31_non_organization' END AS reason,
CASE WHEN k % 10 = 4 THEN 'empty_p31' WHEN k % 10 IN (5, 6, 9) THEN 'subclass' WHEN k % 10 <> 7 THEN 'exact' END AS via, CASE k % 10 WHEN 5 THEN 2 WHEN 9 THEN 1 END AS subclass_depth FROM s""")
def entity_type_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every supplier; the classes above theirs come from the nations and regions: nation to region to organization, and back again."""
    c, lit = F.col, F.lit
    q = lambda start, key: F.concat(lit(start), c(key).cast("string"))
    rows = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), "s_nationkey")
    own = _case(10, F.array(lit("Q43229")), F.array(lit("Q11032")), F.array(lit("Q11032")), F.array(lit("Q5"), lit("Q11032")), F.array().cast("array<string>"), F.array(q("Q9990000", "s_nationkey")), F.array(q("Q9970000", "s_nationkey")),
                F.array(lit("Q5")), F.array(lit("http://x/Q5"), lit("q4830453")), F.array(q("Q9960000", "s_nationkey")))
    entities = rows.select(c("k").alias("entity_id"), own.alias("classes"), (c("k") % 10 == 2).alias("media_context"), (c("k") % 10 == 7).alias("failed"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    edge = lambda child, parent: n.select(child.alias("child"), parent.alias("parent"))
    nation, region, loop, place = q("Q9990000", "n_nationkey"), q("Q9980000", "n_regionkey"), q("Q9970000", "n_nationkey"), q("Q9960000", "n_nationkey")
    edges = readers.stack(edge(nation, region), edge(region, lit("Q43229")), edge(region, nation), edge(loop, F.concat(loop, lit("0000"))), edge(F.concat(loop, lit("0000")), loop), edge(place, lit("Q515")), edge(place, nation))
    return G.classify(entities, edges).select("entity_id", "decision", "reason", "via", "subclass_depth")


@query("""WITH RECURSIVE e AS (SELECT concat('N', n_nationkey) AS child, concat('R', n_regionkey) AS parent FROM nation UNION SELECT concat('R', r_regionkey), 'TOP' FROM region UNION SELECT 'TOP', 'R0'),
w AS (SELECT concat('N', n_nationkey) AS start, parent AS class, 1 AS depth FROM nation JOIN e ON child = concat('N', n_nationkey) UNION ALL SELECT start, parent, depth + 1 FROM w JOIN e ON child = class WHERE depth < 8)
SELECT start, class, min(depth) AS depth FROM w WHERE class <> start GROUP BY ALL""")
def class_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    edges = n.select(name("N", "n_nationkey").alias("child"), name("R", "n_regionkey").alias("parent")).union(r.select(name("R", "r_regionkey"), F.lit("TOP"))).union(spark.createDataFrame([("TOP", "R0")], "child string, parent string"))
    return G.walk(n.select(name("N", "n_nationkey").alias("class")), edges)


@query("""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS company_key, event_id AS seq, ts, event_type = 'error' AS deleted, CAST(event_type <> 'purchase' AS INTEGER) AS origin, concat('u', user_id, '.example.com') AS domain FROM events),
c AS (SELECT company_key, arg_max(domain, (ts, origin, seq)) AS domain, max(ts) AS stamp FROM l WHERE NOT deleted GROUP BY company_key), t AS (SELECT company_key, max(ts) AS deleted_at FROM l WHERE deleted GROUP BY company_key HAVING max(ts) >= TIMESTAMP '2024-06-01' - INTERVAL 365 DAY)
SELECT coalesce(c.company_key, t.company_key) AS company_key, CASE WHEN stamp IS NOT NULL AND (deleted_at IS NULL OR stamp > deleted_at) THEN domain END AS domain, CASE WHEN stamp IS NOT NULL AND (deleted_at IS NULL OR stamp > deleted_at) THEN 'kept' ELSE 'deleted' END AS state FROM c FULL JOIN t ON c.company_key = t.company_key""")
def corrections_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    log = table(spark, sf_dir, "events").select(c("user_id").cast("string").alias("company_key"), F.concat(F.lit("User "), c("user_id")).alias("company_name"), F.concat(F.lit("u"), c("user_id"), F.lit(".example.com")).alias("domain"),
                                                F.lit("manual").alias("source"), c("ts").alias("created_at"), c("ts").alias("updated_at"), (c("event_type") == "error").alias("deleted"), (c("event_type") != "purchase").cast("int").alias("origin"), c("event_id").alias("seq"))
    return K.reconcile(log, F.lit("2024-06-01").cast("timestamp")).select("company_key", "domain", "state")


@query("""WITH h AS (SELECT user_id AS company_id, event_id AS seq, event_type AS value, CASE event_id % 4 WHEN 0 THEN 'official_about' WHEN 1 THEN 'json_ld' WHEN 2 THEN 'search_snippet' ELSE 'press' END AS source, event_id % 5 AS authority FROM events),
s AS (SELECT *, authority * 10 + CASE source WHEN 'official_about' THEN 100 WHEN 'json_ld' THEN 90 WHEN 'search_snippet' THEN 50 ELSE 40 END AS strength FROM h),
g AS (SELECT company_id, lower(value) AS v, max(strength) AS best, count(DISTINCT source) AS sources, min(seq) AS seq, arg_max(source, (strength, -seq)) AS source, arg_max(value, (strength, -seq)) AS value FROM s GROUP BY company_id, lower(value)),
r AS (SELECT *, row_number() OVER w AS k, lead(best) OVER w AS next_best, lead(source) OVER w AS next_source FROM g WINDOW w AS (PARTITION BY company_id ORDER BY best DESC, sources DESC, seq))
SELECT company_id, value, source, best, sources, coalesce(source IN ('official_about', 'json_ld') AND next_source IN ('official_about', 'json_ld') AND best - next_best < 25, FALSE) AS conflict FROM r WHERE k = 1""")
def consensus_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    k = c("event_id") % 4
    hits = table(spark, sf_dir, "events").select(c("user_id").alias("company_id"), c("event_id").alias("seq"), c("event_type").alias("value"),
                                                 F.when(k == 0, "official_about").when(k == 1, "json_ld").when(k == 2, "search_snippet").otherwise("press").alias("source"), (c("event_id") % 5).alias("authority"), F.lit(True).alias("explicit"))
    return S.pick_consensus(hits)


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, CASE k % 10 WHEN 0 THEN 'disabled' WHEN 1 THEN 'not_found' WHEN 2 THEN 'error' WHEN 3 THEN 'error' WHEN 4 THEN 'rejected' WHEN 5 THEN 'rejected' WHEN 6 THEN 'rejected' ELSE 'accepted' END AS match_status,
CASE k % 10 WHEN 0 THEN 'not_configured' WHEN 1 THEN 'not_found' WHEN 2 THEN 'quota' WHEN 3 THEN 'empty_response' WHEN 4 THEN concat('likelihood_', k % 6, '_below_6') WHEN 5 THEN concat('domain_mismatch_req_', lower(z), '.com_got_other.com')
WHEN 6 THEN 'name_mismatch_with_moderate_likelihood' END AS match_reason FROM m""")
def provider_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit, none = F.col, F.lit, F.lit(None).cast("string")
    own = F.concat(F.lower("z"), lit(".com"))
    df = _made(spark, sf_dir).select(
        "k", (c("k") % 10 != 0).alias("enabled"), _case(10, none, 404, 500, 200, 200, 200, 200, 200, 200, 200).cast("int").alias("http_status"), F.when(c("k") % 10 == 2, "quota").alias("error"),
        _case(10, none, none, none, 9, c("k") % 6, 9, 7, 8, 6, 6).cast("int").alias("likelihood"), _case(10, none, none, none, none, own, "other.com", own, F.concat(lit("https://www."), own, lit("/x")), F.concat(lit("shop."), own), "other.com").alias("website"),
        _case(10, none, none, none, none, c("z"), c("z"), "Quux", "Quux", F.concat(F.upper("z"), lit(" Holdings Inc.")), c("z")).alias("provider_name"), F.when(c("k") % 10 == 9, F.array(own)).alias("alternative_domains"),
        own.alias("requested_domain"), c("z").alias("requested_name"), lit(None).cast("array<string>").alias("alternative_names"))
    return P.validate(df).select(c("k").alias("id"), "match_status", "match_reason")


@query("""WITH f AS (SELECT c_custkey AS company_id, CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE c_mktsegment END AS industry, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'Paris, France' END AS location FROM customer),
p AS (SELECT c_custkey AS company_id, 'MACHINERY' AS pi, 'Lyon, France' AS pl FROM customer WHERE c_custkey % 5 <> 0)
SELECT company_id, CASE WHEN industry = 'Unknown' AND pi IS NOT NULL THEN pi ELSE industry END AS industry, CASE WHEN location IS NULL AND pl IS NOT NULL THEN pl ELSE location END AS location,
concat_ws(',', CASE WHEN industry <> 'Unknown' AND lower(industry) <> lower(pi) THEN 'industry' END, CASE WHEN location <> pl THEN 'location' END) AS conflicts FROM f LEFT JOIN p USING (company_id)""")
def provider_fill_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    base = table(spark, sf_dir, "customer")
    fields = base.select(c("c_custkey").alias("company_id"), F.when(c("c_custkey") % 3 == 0, "Unknown").otherwise(c("c_mktsegment")).alias("industry"), F.when(c("c_custkey") % 2 == 1, "Paris, France").alias("location"))
    given = base.select(c("c_custkey").alias("company_id"), F.when(c("c_custkey") % 5 != 0, "accepted").otherwise("rejected").alias("match_status"), F.lit("MACHINERY").alias("industry"), F.lit("Lyon, France").alias("location"))
    return P.fill_unknown(fields, given, ("industry", "location")).select("company_id", "industry", "location", F.array_join("conflicts", ",").alias("conflicts"))


@query(f"""WITH m AS ({_MADE}) SELECT k AS id, CASE k % 6 WHEN 0 THEN 'exact_complete' WHEN 1 THEN 'correct_partial' WHEN 2 THEN 'incorrect' WHEN 3 THEN 'unknown' WHEN 4 THEN 'not_applicable' ELSE 'exact_complete' END AS outcome,
CAST(CASE k % 6 WHEN 2 THEN 0.5 WHEN 3 THEN NULL WHEN 4 THEN 0 ELSE 1 END AS DOUBLE) AS precision, CAST(CASE k % 6 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE 1 END AS DOUBLE) AS recall,
CASE k % 6 WHEN 0 THEN 'complete' WHEN 3 THEN 'none' ELSE 'partial' END AS completeness FROM m""")
def founder_set_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    both = lambda *n: F.concat_ws("; ", *n)
    middle = F.concat(F.substring_index("p1", " ", 1), lit(" M. "), F.substring_index("p1", " ", -1))
    got = _case(6, both("p1", "p2"), c("p1"), both("p1", "p3"), "Unknown", c("p1"), F.concat(lit("José "), F.substring_index("p1", " ", -1)))
    expected = _case(6, F.concat(F.lower("p2"), lit("; "), middle), both("p1", "p2"), both("p1", "p2"), c("p1"), "Unknown", F.concat(lit("Jose "), F.substring_index("p1", " ", -1)))
    infobox, listed = _case(6, both("p1", "p2"), both("p1", "p2"), c("p1"), "", "", both("p1", "p2")), _case(6, both("p2", "p1"), c("p1"), c("p2"), "", c("p1"), both("p1", "p3"))
    df = _made(spark, sf_dir).select("k", got.alias("got"), expected.alias("expected"), infobox.alias("infobox"), listed.alias("listed"))
    return df.select(c("k").alias("id"), S.founder_match(c("got"), c("expected")).alias("m"), S.founder_completeness(c("infobox"), c("listed")).alias("c")).select("id", "m.outcome", "m.precision", "m.recall", "c.completeness")


# reports -------------------------------------------------------------------------------------------------------------
_OUTCOME_SQL = "SELECT doc_id, source, CASE WHEN quality IS NULL THEN 'skip' WHEN n_chars % 7 = 0 THEN 'unknown' WHEN (CASE WHEN n_chars > 400 THEN 1 ELSE 0 END) = quality THEN 'correct' ELSE 'incorrect' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    df = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    got = F.when(c("n_chars") % 7 != 0, (c("n_chars") > 400).cast("int").cast("string"))
    return df.select("doc_id", "source", M.outcome(got, c("quality").cast("string"), got == c("quality").cast("string")).alias("outcome"))


_PCT = "CASE WHEN {1} > 0 THEN floor({0} / {1} * 1000 + 0.5) / 10 END"


@query(f"WITH o AS ({_OUTCOME_SQL}), a AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'incorrect') AS incorrect, count(*) FILTER (WHERE outcome = 'unknown') AS unknown FROM o GROUP BY source) "
       f"SELECT *, {_PCT.format('correct', '(correct + incorrect)')} AS precision_pct, {_PCT.format('(correct + incorrect)', '(correct + incorrect + unknown)')} AS coverage_pct, {_PCT.format('correct', '(correct + incorrect + unknown)')} AS accuracy_pct FROM a")
def precision_and_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summarize(_outcomes(spark, sf_dir), by=["source"])


@query(f"WITH o AS ({_OUTCOME_SQL}), s AS (SELECT CASE outcome WHEN 'correct' THEN 'found' WHEN 'incorrect' THEN 'potential' WHEN 'unknown' THEN 'unverified' ELSE 'pending' END AS status FROM o), a AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'found') AS found, count(*) FILTER (WHERE status = 'potential') AS potential, count(*) FILTER (WHERE status = 'unverified') AS unverified FROM s) SELECT *, {_PCT.format('(found + potential + unverified)', 'total')} AS progress_pct FROM a")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("outcome")
    return M.status_counts(_outcomes(spark, sf_dir).select(F.when(o == "correct", "found").when(o == "incorrect", "potential").when(o == "unknown", "unverified").otherwise("pending").alias("status")))


@query(f"WITH b AS ({_OUTCOME_SQL}), c AS (SELECT doc_id, outcome AS b, CASE WHEN doc_id % 11 = 0 AND outcome = 'unknown' THEN 'correct' WHEN doc_id % 13 = 0 AND outcome = 'unknown' THEN 'incorrect' ELSE outcome END AS a FROM b), d AS (SELECT count(*) AS total, count(*) FILTER (WHERE a = 'correct' AND b <> 'correct') AS gained, count(*) FILTER (WHERE b = 'correct' AND a <> 'correct') AS lost, count(*) FILTER (WHERE a = 'incorrect' AND b = 'unknown') AS new_errors FROM c) SELECT *, CASE WHEN lost > 0 OR new_errors > gained THEN 'do_not_adopt' WHEN gained = 0 THEN 'no_gain' ELSE 'adopt' END AS recommendation FROM d")
def incremental_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _outcomes(spark, sf_dir).withColumnRenamed("doc_id", "company_id")
    u = F.col("outcome") == "unknown"
    after = before.withColumn("outcome", F.when(u & (F.col("company_id") % 11 == 0), "correct").when(u & (F.col("company_id") % 13 == 0), "incorrect").otherwise(F.col("outcome")))
    return M.incremental_gain(before, after)


@query("SELECT count(*) FILTER (WHERE c_custkey % 3 = 0) AS industry, count(*) FILTER (WHERE c_custkey % 4 = 1) AS location FROM customer")
def unknown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "customer").select(F.when(c("c_custkey") % 3 != 0, c("c_mktsegment")).otherwise("Unknown").alias("industry"), F.when(c("c_custkey") % 4 == 1, "needs manual check").otherwise("Paris").alias("location"))
    return M.unknown_counts(rows, ["industry", "location"])


@query("""SELECT concat('"', replace(c_name, '"', '""'), '","', c_mktsegment, '"') AS line FROM customer""")
def csv_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.csv_rows(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@query("""WITH s AS (SELECT user_id, event_id, event_type, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 2 DESC, event_id DESC) AS k FROM s) SELECT user_id, event_type, ts FROM r WHERE k = 1""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return writers.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "ts").select("user_id", "event_type", "ts")


# recorded responses, retries, signals ------------------------------------------------------------------------------------
_SAID = f"SELECT page_id AS id, {_PAGE_HOST} AS host, {_TITLE} AS title, {_H1} AS heading FROM pages"


@query(f"""WITH p AS ({_SAID}), a AS (SELECT id, 'autocomplete' AS kind, host AS domain, coalesce(nullif(title, ''), host) AS name, heading AS note FROM p WHERE id % 7 <> 0 AND id % 11 <> 0 AND host <> ''),
i AS (SELECT id, 'instant' AS kind, host AS domain, coalesce(nullif(heading, ''), 'asked') AS name, CASE WHEN id % 3 = 0 THEN 'official' ELSE 'abstract' END AS note FROM p WHERE id % 11 <> 0 AND host <> '' AND (id % 3 <> 1 OR NOT regexp_matches(host, 'wikipedia[.]org|wikidata[.]org'))
  AND (id % 3 <> 0 OR NOT contains(host, 'wikipedia.org')) AND id % 3 <> 2),
t AS (SELECT id, 'title' AS kind, NULL AS domain, heading AS name, NULL AS note FROM p WHERE id % 11 <> 0 AND id % 3 = 2 AND heading <> ''),
e AS (SELECT id, 'enrich' AS kind, host AS domain, CASE WHEN id % 13 <> 0 AND id % 11 <> 0 THEN title END AS name, CASE WHEN id % 13 = 0 THEN CASE WHEN id % 2 = 0 THEN 'not_found' ELSE 'status_404' END WHEN id % 11 = 0 THEN 'unreadable' ELSE CAST(id % 10 AS VARCHAR) END AS note FROM p WHERE id % 2 = 0 OR id % 11 <> 0),
f AS (SELECT id, 'enrich' AS kind, host AS domain, NULL AS name, 'unreadable' AS note FROM p WHERE id % 2 = 1 AND id % 11 = 0),
b AS (SELECT id, 'bad' AS kind, NULL AS domain, NULL AS name, NULL AS note FROM p CROSS JOIN (VALUES (1), (2), (3), (4)) WHERE id % 11 = 0)
SELECT * FROM a UNION ALL SELECT * FROM i UNION ALL SELECT * FROM t UNION ALL SELECT * FROM e UNION ALL SELECT * FROM f UNION ALL SELECT * FROM b""")
def recorded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as four recorded responses, whose bodies hold its host, title and heading, flat or nested, some cut off, some refused; written, read again and taken apart."""
    c, lit = F.col, F.lit
    p = table(spark, sf_dir, "pages").select(c("page_id").alias("id"), D.host_of(c("url")).alias("host"), H.title(c("html")).alias("title"), H.heading(c("html")).alias("heading"))
    item = F.struct(c("host").alias("domain"), c("title").alias("name"), c("heading").alias("industry"))
    site = F.struct(c("heading").alias("Heading"), F.struct(F.array(F.struct(lit("Founded").alias("label"), lit("1999").alias("value")), F.struct(lit("Website").alias("label"), F.concat(lit("https://"), c("host"), lit("/x")).alias("value"))).alias("content")).alias("Infobox"))
    page = F.struct(c("heading").alias("Heading"), F.concat(lit("https://"), c("host"), lit("/x?y")).alias("AbstractURL"))
    wiki = F.struct(c("heading").alias("Heading"), F.concat(lit("https://en.wikipedia.org/wiki/"), F.replace(F.replace(F.url_encode("heading"), lit("+"), lit("_")), lit("#"), lit("%23"))).alias("AbstractURL"))
    instant = F.when(c("id") % 3 == 0, F.to_json(site)).when(c("id") % 3 == 1, F.to_json(page)).otherwise(F.to_json(wiki))
    gone = c("id") % 13 == 0
    flat = F.struct(c("title").alias("name"), c("host").alias("website"), (c("id") % 10).alias("likelihood"))
    one = F.when(gone, lit('{"error": {"message": "none"}}')).otherwise(F.to_json(flat))
    many = F.to_json(F.array(F.struct(F.when(gone, 404).otherwise(200).alias("status"), (c("id") % 10).alias("likelihood"), F.when(~gone, F.struct(c("title").alias("name"), c("host").alias("website"))).alias("data"))))

    def line(provider: str, seq: int, request, status, body) -> DataFrame:
        cut = F.when(c("id") % 11 == 0, F.substr(body, lit(1), F.length(body) - 1)).otherwise(body)
        return p.select(lit(provider).alias("provider"), c("id").alias("company_id"), lit(seq).cast("long").alias("seq"), lit("asked").alias("company"), request.alias("request"), lit("2024-01-01").cast("timestamp").alias("fetched_at"),
                        status.cast("int").alias("http_status"), lit(5).alias("latency_ms"), cut.alias("body"))

    ok = lit(200)
    lines = readers.stack(line("autocomplete", 0, c("title"), F.when(c("id") % 7 == 0, 429).otherwise(ok), F.to_json(F.array(item, F.struct(lit(None).cast("string").alias("domain"), lit("x").alias("name"), lit("y").alias("industry"))))),
                          line("autocomplete", 1, F.concat(F.lower("title"), lit(" ")), ok, F.to_json(F.array(item))), line("instant", 0, c("title"), ok, instant),
                          line("enrich", 0, c("host"), F.when(gone & (c("id") % 2 == 0), 404).otherwise(ok), F.when(c("id") % 2 == 0, one).otherwise(many)))
    path = f"{shared_dir(spark)}/orgweave/responses-{uuid.uuid4().hex}"
    lines.write.partitionBy("provider").json(path)
    forget(spark, path)
    got = responses.recorded(spark, path)
    none = lit(None).cast("string")
    rows = lambda df, kind, domain, name, note: df.select(c("company_id").alias("id"), lit(kind).alias("kind"), domain.alias("domain"), name.alias("name"), note.alias("note"))
    return readers.stack(rows(responses.autocomplete_rows(got), "autocomplete", c("domain"), c("name"), c("snippet")), rows(responses.instant_rows(got), "instant", c("domain"), c("name"), c("snippet")),
                         rows(responses.instant_titles(got), "title", none, c("title"), none), rows(responses.provider_rows(got), "enrich", c("domain"), c("provider_name"), F.coalesce("error", c("likelihood").cast("string"))),
                         rows(got.where("bad IS NOT NULL"), "bad", none, none, none))


#: Each event is an attempt to look something up for its user and kind of event on its day: the value tells what came of it.
_STATUS = "CASE WHEN value > 60 THEN 503 WHEN value > 35 THEN 429 WHEN value > 30 THEN 403 WHEN value > 20 THEN NULL ELSE 200 END"
_LOOKUPS_SQL = f"""WITH l AS (SELECT concat(user_id, '/', event_type) AS key, event_id AS seq, ts AS "at", {_STATUS} AS status FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at", seq) AS nth, CASE WHEN status = 200 THEN 'done' WHEN status = 429 THEN 'rate_limited' WHEN status = 403 THEN 'http' ELSE 'transient' END AS reason FROM l),
f AS (SELECT * FROM k WHERE nth <= 3), n AS (SELECT key, coalesce(min(nth) FILTER (WHERE reason IN ('done', 'http')), max(nth)) AS nth FROM f GROUP BY key)
SELECT key, CASE WHEN reason = 'done' THEN 'done' WHEN reason = 'http' THEN 'refused' WHEN nth = 3 THEN 'given_up' ELSE 'waiting' END AS state, reason, CAST(nth AS INTEGER) AS attempts, "at" FROM f JOIN n USING (key, nth)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    status = F.when(c("value") > 60, 503).when(c("value") > 35, 429).when(c("value") > 30, 403).when(c("value") > 20, None).otherwise(200)
    return table(spark, sf_dir, "events").select(F.concat_ws("/", c("user_id").cast("string"), "event_type").alias("key"), c("event_id").alias("seq"), c("ts").cast("timestamp").alias("at"), status.cast("int").alias("http_status"))


@query(_LOOKUPS_SQL)
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retries.lookups(_attempts(spark, sf_dir))


def _replayed(log: DataFrame) -> tuple[DataFrame, DataFrame, str, str]:
    """The log as a stream of eight files in an order that has nothing to do with its times, two to a batch, and folders for its store and checkpoint."""
    spark = log.sparkSession
    written = materialize(log.repartition(8, F.xxhash64("seq")), "log")
    folder = f"{shared_dir(spark)}/orgweave/stream-{uuid.uuid4().hex}"
    return written, spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(written.written_to), f"{folder}/store", f"{folder}/checkpoint"


#: How late a replayed log's rows may come: more than the events' whole time.
_REPLAY = "3650 days"


@query(_LOOKUPS_SQL)
def streamed_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over all events, replayed out of order into a keyed store."""
    written, stream, path, checkpoint = _replayed(_attempts(spark, sf_dir))
    sinks.into_store(stream_of_retries.stream_lookups(stream, _REPLAY), path, "key", "updated_at", checkpoint, buckets=16)
    discard(written)
    forget(spark, path)
    return store.read(spark, path).drop("updated_at")


@query("""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS company_key, event_id AS seq, ts, event_type = 'error' AS deleted FROM events),
c AS (SELECT company_key, max(ts) FILTER (WHERE NOT deleted) AS written, max(ts) FILTER (WHERE deleted) AS gone, arg_max(seq, (ts, seq)) FILTER (WHERE NOT deleted) AS seq FROM l GROUP BY company_key)
SELECT company_key, CASE WHEN written IS NOT NULL AND (gone IS NULL OR written > gone) THEN concat('u', seq, '.example.com') END AS domain, greatest(written, gone) AS updated_at,
CASE WHEN written IS NOT NULL AND (gone IS NULL OR written > gone) THEN 'kept' ELSE 'deleted' END AS state FROM c""")
def streamed_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as corrections and deletions, replayed out of order as a stream into a keyed store: what the batch merge gives."""
    c = F.col
    log = table(spark, sf_dir, "events").select(c("user_id").cast("string").alias("company_key"), F.concat(F.lit("User "), c("user_id")).alias("company_name"), F.concat(F.lit("u"), c("event_id"), F.lit(".example.com")).alias("domain"),
                                                c("ts").cast("timestamp").alias("updated_at"), (c("event_type") == "error").alias("deleted"), c("event_id").alias("seq"))
    written, stream, path, checkpoint = _replayed(log)
    sinks.into_store(stream_of_corrections.stream_corrections(stream, _REPLAY), path, "company_key", "updated_at", checkpoint, buckets=16)
    discard(written)
    forget(spark, path)
    return store.read(spark, path).select("company_key", "domain", "updated_at", "state")


_SIGNALS = f"""p AS (SELECT page_id % 40 AS company_id, page_id AS seq, {_PAGE_HOST} AS host, {_TITLE} AS title, {_H1} AS heading, CASE page_id % 3 WHEN 0 THEN 'guess' WHEN 1 THEN 'search' ELSE 'wiki' END AS source FROM pages),
r AS (SELECT company_id, seq, source, array_to_string(string_split(split_part(split_part(host, '#', 1), ':', 1), '.')[-2:], '.') AS domain, title = heading AS exact, least(length(title), 50) AS name_similarity,
  CASE WHEN source = 'wiki' THEN 12 END AS notability, CASE source WHEN 'wiki' THEN 6 WHEN 'search' THEN 5 ELSE 0 END AS multi_source FROM p)"""


@query(f"""WITH {_SIGNALS}, s AS (SELECT company_id, domain, source, min(seq) AS seq FROM r GROUP BY ALL), t AS (SELECT company_id, domain, string_agg(source, ',' ORDER BY seq) AS sources, min(seq) AS seq FROM s GROUP BY ALL),
m AS (SELECT company_id, domain, bool_or(exact) AS exact, max(name_similarity) AS a, max(notability) AS b, max(multi_source) AS c FROM r GROUP BY ALL),
u AS (SELECT *, a + coalesce(b, 0) + c AS points FROM m JOIN t USING (company_id, domain)), v AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY points DESC, seq, domain) AS first FROM u),
w AS (SELECT *, points + CASE WHEN first > 5 THEN 0 WHEN suffix(domain, '.com') THEN 15 + CASE WHEN exact OR a >= 35 THEN 8 ELSE 0 END ELSE -20 END AS total FROM v)
SELECT company_id, domain, sources, CAST(a AS INTEGER) AS name_similarity, CAST(b AS INTEGER) AS notability, CAST(total AS INTEGER) AS total, CAST(row_number() OVER (PARTITION BY company_id ORDER BY total DESC, first) AS INTEGER) AS place FROM w""")
def merged_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as evidence of forty companies' sites: each site's signals at their highest, then a look at whether the five best are live."""
    c = F.col
    pool = table(spark, sf_dir, "pages").select((c("page_id") % 40).alias("company_id"), c("page_id").alias("seq"), D.registrable(c("url")).alias("domain"), H.title(c("html")).alias("title"), H.heading(c("html")).alias("heading"),
                                                F.when(c("page_id") % 3 == 0, "guess").when(c("page_id") % 3 == 1, "search").otherwise("wiki").alias("source"))
    notable, several = F.when(c("source") == "wiki", 12), F.when(c("source") == "wiki", 6).when(c("source") == "search", 5).otherwise(0)
    signals = F.create_map(F.lit("name_similarity"), F.least(F.length("title"), F.lit(50)), F.lit("notability"), notable, F.lit("multi_source"), several)
    rows = pool.select("company_id", "domain", "seq", "source", (c("title") == c("heading")).alias("exact"), signals.alias("signals"))
    live = rows.select("domain", c("domain").endswith(".com").alias("dns_ok")).distinct()
    of = lambda name: F.try_element_at("signals", F.lit(name)).alias(name)
    return C.rank_evidence(C.merge_signals(rows), live).select("company_id", "domain", F.array_join("sources", ",").alias("sources"), of("name_similarity"), of("notability"), "total", "place")


# rules over whole pages and documents ------------------------------------------------------------------------------------
@query(r"""SELECT doc_id, nullif(regexp_extract(lower(coalesce(text, '')), '(?:\[|https?://|\b)(?:https?://)?(?:www\.)?((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24})', 1), '') AS host FROM documents""")
def text_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first address in every document's whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", D.text_host(F.col("text")).alias("host"))


_PAGE_KEY = r"regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(title, '" + T.IDENTITY_FORMS + r"', ' ', 'gi'), '[.,]', ' ', 'g'), '\s+', ' ', 'g'))), '[^a-z0-9 ]+', '', 'g')"


@query(f"""WITH p AS (SELECT page_id, {_PAGE_HOST} AS host, {_TITLE} AS title FROM pages), q AS (SELECT *, string_split(host, '.') AS parts, {_PAGE_KEY} AS plain FROM p),
r AS (SELECT *, replace(plain, ' ', '') AS key, list_filter(string_split(plain, ' '), lambda t: length(t) > 1 AND t NOT IN {T.GENERIC_WORDS}) AS tokens FROM q),
s AS (SELECT page_id, unnest([host, CASE WHEN len(parts) >= 3 AND regexp_matches(parts[1], '{D.PROPERTY_LABELS}') THEN array_to_string(parts[2:], '.') ELSE host END, CASE WHEN length(key) >= 3 THEN concat(key, '.com') END,
  CASE WHEN len(tokens) > 0 THEN concat(tokens[1], '.com') END, CASE WHEN len(tokens) = 2 THEN concat(tokens[1], '.', tokens[2]) END]) AS guess, unnest(range(5)) AS place FROM r WHERE host <> '')
SELECT page_id, string_agg(guess, ',' ORDER BY place) AS guesses FROM (SELECT page_id, guess, min(place) AS place FROM s WHERE guess IS NOT NULL GROUP BY ALL) GROUP BY page_id""")
def page_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page, whose title is taken for its company's name, the hosts that the company may own."""
    c = F.col
    guesses = D.official_guesses(c("url"), H.title(c("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(guesses, ",").alias("guesses")).where("guesses <> ''")


@query(f"""WITH h AS (SELECT DISTINCT {_PAGE_HOST} AS host FROM pages), o AS (SELECT host, unnest([concat(regexp_replace(host, '\\.[^.]*$', ''), '.de'), concat(regexp_replace(host, '\\.[^.]*$', ''), '.com'), concat(regexp_replace(host, '\\.[^.]*$', ''), '.io'), regexp_replace(host, '^[^.]*\\.', '')]) AS other FROM h),
b AS (SELECT DISTINCT *, regexp_replace(split_part(host, '.', 1), '[^a-z0-9]', '', 'g') AS base, regexp_replace(split_part(other, '.', 1), '[^a-z0-9]', '', 'g') AS based FROM o)
SELECT host, other, host = other OR suffix(host, concat('.', other)) OR suffix(other, concat('.', host)) AS same, base <> '' AND base = based AND regexp_matches(other, '\\.[a-z]{{2}}$') AND NOT regexp_matches(other, '\\.(com|org|net|io|co|ai|us)$') AND regexp_matches(host, '\\.(com|org|net|io|ai|edu|gov)$') AS sibling FROM b""")
def host_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the pages' hosts against its name under other endings and the site above it: which are one site, which a country's sibling."""
    c = F.col
    h = table(spark, sf_dir, "pages").select(D.host_of(c("url")).alias("host")).distinct()
    named = [F.concat(F.regexp_replace("host", r"\.[^.]*$", ""), F.lit(e)) for e in (".de", ".com", ".io")]
    pairs = h.select("host", F.explode(F.array_distinct(F.array(*named, F.regexp_replace("host", r"^[^.]*\.", "")))).alias("other"))
    return pairs.select("host", "other", D.same_site(c("host"), c("other")).alias("same"), D.is_regional_sibling(c("other"), c("host")).alias("sibling"))


_WORDS_SQL = r"""trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '[\s\x{A0}\x{2000}-\x{200A}]+', ' ', 'g'))"""


@query(f"""WITH p AS (SELECT page_id, {_TITLE} AS title, lower({_WORDS_SQL}) AS words, regexp_extract(html, '(?is)<link[^>]+rel=["'']canonical["''][^>]+href=["'']([^"'']+)["'']', 1) AS canonical, regexp_extract({_WORDS_SQL}, '©\\s*\\d{{4}}[^.\\n]{{0,60}}') AS line FROM pages),
n AS (SELECT p.*, q.title AS name FROM p JOIN p AS q ON q.page_id = p.page_id - p.page_id % 3), t AS (SELECT *, list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3) AS tokens FROM n)
SELECT page_id, name, canonical, line, len(tokens) > 0 AND len(list_filter(tokens, lambda w: contains(words, w))) >= ceil(len(tokens) * 0.6) AS confirmed FROM t""")
def page_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page confirms a company, which is named as its own title or as that of one of the two pages before it, with its canonical address and copyright line."""
    c = F.col
    p = table(spark, sf_dir, "pages")
    names = p.select(c("page_id").alias("of"), H.title(c("html")).alias("name"))
    rows = p.select("page_id", "html", H.html_text(c("html")).alias("words"), (c("page_id") - c("page_id") % 3).alias("of")).join(names, "of")
    return rows.select("page_id", "name", H.canonical(c("html")).alias("canonical"), H.copyright_line(c("words")).alias("line"), H.confirms_company(c("name"), c("words")).alias("confirmed"))


#: What is said in the middle of each text, of its own number of characters.
_STAFF = ("", " It employs about {0} people. ", " We have 10–{0} employees and staff. ", " Company size: {0}+ ", " Headcount: more than {0}, not counting 12,000 followers. ", " Over {0} customers, 300 employees. ", " A team of 20 - {0} people. ")
_STAFF_SQL = "[" + ", ".join("'" + s + "'" for s in _STAFF) + "]"
_SAID_SQL = f"SELECT doc_id, concat(substr(t, 1, length(t) // 2), replace({_STAFF_SQL}[doc_id % {len(_STAFF)} + 1], '{{0}}', format('{{:,}}', length(t))), substr(t, length(t) // 2 + 1)) AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_STAFF_HITS = " UNION ALL ".join(f"SELECT doc_id, {i} AS k, text, regexp_extract_all(text, '{p}', 0, 'i') AS ms, string_split_regex(text, '(?i){p}') AS gaps, regexp_extract_all(text, '{p}', 1, 'i') AS g1, regexp_extract_all(text, '{p}', 2, 'i') AS g2 FROM d" for i, p in enumerate(X.HEADCOUNT_PATTERNS))


@query(f"""WITH d AS ({_SAID_SQL}), a AS ({_STAFF_HITS}), n AS (SELECT doc_id, k, text, ms, gaps, g1, g2, unnest(range(1, len(ms) + 1)) AS nth FROM a),
s AS (SELECT doc_id, k, nth, ms[nth] AS m, CASE WHEN coalesce(g2[nth], '') <> '' THEN concat(g1[nth], '–', g2[nth]) ELSE g1[nth] END AS raw, list_sum(list_transform(gaps[1:nth], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:nth - 1], lambda g: length(g))), 0) AS start, text FROM n),
w AS (SELECT doc_id, k, nth, start, regexp_extract(raw, '(?i)(?:more than|over)\\s*([\\d,]+)', 1) AS more, regexp_extract(raw, '([\\d,]+)\\+', 1) AS plus, list_transform(regexp_extract_all(raw, '\\d[\\d,]*'), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS ns,
  substr(text, CAST(greatest(start - 40, 0) + 1 AS BIGINT), CAST(start - greatest(start - 40, 0) + length(m) + 30 AS BIGINT)) AS around FROM s),
v AS (SELECT doc_id, k, start, CASE WHEN more <> '' THEN CAST(replace(more, ',', '') AS DOUBLE) + 1 WHEN plus <> '' THEN CAST(replace(plus, ',', '') AS DOUBLE) WHEN len(ns) = 2 THEN floor((ns[1] + ns[2]) / 2 + 0.5) ELSE ns[1] END AS n FROM w WHERE NOT regexp_matches(around, '{X.NOT_HEADCOUNT}', 'i'))
SELECT doc_id, count(*) AS hits, string_agg({_BUCKET.format('n')}, ';' ORDER BY k, start) AS headcounts FROM v GROUP BY doc_id""")
def document_headcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of employees in all whole texts, in whose middle a sentence gives the text's length as one; SQL looks for them with its own matcher and buckets them."""
    c = F.col
    t = F.coalesce("text", F.lit(""))
    half, size = F.floor(F.length("t") / 2).cast("int"), F.format_number(F.length("t"), 0)
    said = F.replace(F.element_at(F.array(*map(F.lit, _STAFF)), (c("doc_id") % len(_STAFF) + 1).cast("int")), F.lit("{0}"), size)
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.concat(F.substr("t", F.lit(1), half), said, F.substr("t", half + 1, F.length("t"))).alias("text"))
    hits = d.select("doc_id", X.headcount_hits(c("text")).alias("h")).where(F.size("h") > 0)
    return hits.select("doc_id", F.size("h").cast("long").alias("hits"), F.array_join(F.transform("h", lambda h: h["value"]), ";").alias("headcounts"))


_ANY_SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_TRIM = "regexp_replace({0}, '^S+|S+$', '', 'g')".replace("S", _ANY_SPACE.replace("{", "{{").replace("}", "}}"))
_WORD_LIST = "list_filter(string_split_regex({0}, 'S+'), lambda v: v <> '')".replace("S", _ANY_SPACE.replace("{", "{{").replace("}", "}}"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), 1) AS nr FROM documents),
c AS (SELECT doc_id, nr, regexp_replace(regexp_replace(regexp_replace({_TRIM.format('line')}, '^{_ANY_SPACE}*[-*•●◦▪▸►]{_ANY_SPACE}+', ''), '^\d+[.)]{_ANY_SPACE}+', ''), '^\[?\d+\]?{_ANY_SPACE}+', '') AS line FROM l),
s AS (SELECT *, list_filter(list_transform(string_split(line, ','), lambda x: {_TRIM.format('x')}), lambda p: p <> '') AS split FROM c WHERE line <> ''),
k AS (SELECT *, NOT contains(line, chr(9)) AND ((len(split) >= 2 AND len(list_filter(split, lambda p: length(p) > 60 OR regexp_matches(p, '(?i)\b(CEO|CTO|Partner|Director|Manager|Analyst)\b'))) = 0 AND NOT regexp_matches(line, '(?i)\b(Inc|LLC|Ltd|Corp|Corporation|LP|LLP|PLC){_ANY_SPACE}*,'))
  OR (len(split) >= 3 AND len(list_filter(split, lambda p: len({_WORD_LIST.format('p')}) > 5)) = 0 AND NOT regexp_matches(line, '(?i)\b(CEO|Partner|Director)\b'))) AS listed FROM s),
d AS (SELECT doc_id, sum(CASE WHEN listed THEN len(split) ELSE 1 END) AS names, md5(string_agg(CASE WHEN listed THEN array_to_string(split, '|') ELSE line END, '|' ORDER BY nr)) AS digest FROM k GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(names, 0) AS BIGINT) AS names, coalesce(digest, md5('')) AS digest FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id""")
def pasted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document as a pasted list: how many names its lines give, and a digest of them in order."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", T.paste_lines(F.col("text")).alias("parts"))
    return d.select("doc_id", F.size("parts").cast("long").alias("names"), F.md5(F.array_join("parts", "|")).alias("digest"))


_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '" + N.PLAIN_FORMS + r"', '', 'g'), '^the\s+', ''), '\s+', ' ', 'g'))"
_LETTERS_ONLY = "regexp_replace({0}, '[^a-z0-9]', '', 'g')"
_TLDS = "(" + ", ".join(f"'{t}'" for t in N.PLAIN_TLDS) + ")"


_FORMS, _ENDINGS = ("", " Inc.", ", LLC", " group"), (".com", ".io", ".zz", ".store.ca")


@query(rf"""WITH n AS (SELECT p.p_partkey AS id, concat(p.p_name, {list(_FORMS)}[p.p_size % 4 + 1]) AS name, r.p_name AS heading, concat(CASE WHEN q.p_size % 5 = 0 THEN split_part(q.p_name, ' ', 2) ELSE replace(q.p_name, ' ', '') END, {list(_ENDINGS)}[q.p_size % 4 + 1]) AS host
  FROM part AS p JOIN part AS q ON q.p_partkey = p.p_partkey - p.p_partkey % 3 JOIN part AS r ON r.p_partkey = p.p_partkey - p.p_partkey % 2),
x AS (SELECT *, {_PLAIN.format('name')} AS plain, {_LETTERS_ONLY.format(_PLAIN.format('heading'))} AS s, string_split(host, '.') AS parts, {_LETTERS_ONLY.format('lower(name)')} AS k, replace(regexp_replace(host, '\.[a-z]{{2,}}$', ''), '.', '') AS h FROM n),
y AS (SELECT *, {_LETTERS_ONLY.format('plain')} AS q, {_LETTERS_ONLY.format(f"CASE WHEN len(parts) > 2 AND parts[-2] NOT IN {_TLDS} THEN parts[-2] ELSE parts[1] END")} AS b, parts[-1] AS t, list_filter({_WORD_LIST.format('plain')}, lambda w: length(w) > 2) AS w,
  list_filter(list_transform({_WORD_LIST.format('lower(name)')}, lambda w: {_LETTERS_ONLY.format('w')}), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'global', 'management', 'capital', 'ventures', 'company')) AS tokens FROM x),
z AS (SELECT *, len(list_filter(w, lambda v: contains(b, {_LETTERS_ONLY.format('v')}))) AS found, s <> '' AND (contains(s, q) OR contains(q, s)) AS suggested FROM y),
c AS (SELECT *, CASE WHEN b = q THEN 100 WHEN contains(q, b) OR contains(b, q) THEN 50 - least(30, abs(length(b) - length(q)) * 2) WHEN suggested THEN 40 WHEN found > 0 AND found = len(w) THEN 70 WHEN found > 0 THEN 25 END AS core FROM z)
SELECT id, plain, length(q) <= 3 OR plain IN {N.AMBIGUOUS} OR (len({_WORD_LIST.format('plain')}) = 1 AND length(plain) <= 6) AS ambiguous,
  CAST(CASE WHEN q = '' OR b = '' OR core IS NULL THEN 0 ELSE core + CASE WHEN t IN {_TLDS} THEN 15 ELSE -40 END + CASE WHEN s <> '' AND s = q THEN 30 WHEN suggested THEN 15 ELSE 0 END END AS BIGINT) AS score,
  CAST(CASE WHEN h = '' OR k = '' THEN 0 ELSE CASE WHEN h = k THEN 100 ELSE 0 END + CASE WHEN contains(h, k) OR contains(k, h) THEN 60 ELSE 0 END + 20 * len(list_filter(tokens, lambda v: contains(h, v))) + CASE WHEN regexp_matches(host, 'news|aircraft|msn|hci\.org|wikipedia') THEN -80 ELSE 0 END END AS BIGINT) AS simple FROM c""")
def name_host_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name, with a legal form, against the host that another part's name makes, under both early scores; a third's name is the suggestion."""
    c, lit = F.col, F.lit
    of = lambda values, size: F.element_at(F.array(*map(lit, values)), (size % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_size").alias("size"))
    base = F.when(c("size") % 5 == 0, F.split_part("name", lit(" "), lit(2))).otherwise(F.replace("name", lit(" "), lit("")))
    hosts = p.select(c("id").alias("host_of"), F.concat(lit("https://www."), base, of(_ENDINGS, c("size")), lit("/")).alias("url"))
    suggested = p.select(c("id").alias("said_by"), c("name").alias("heading"))
    rows = p.withColumn("name", F.concat("name", of(_FORMS, c("size")))).join(hosts, c("host_of") == c("id") - c("id") % 3).join(suggested, c("said_by") == c("id") - c("id") % 2)
    return rows.select("id", N.plain_name(c("name")).alias("plain"), N.is_ambiguous_name(c("name")).alias("ambiguous"), N.domain_score(c("url"), c("name"), c("heading")).cast("long").alias("score"),
                       N.domain_for_name(c("name"), c("url")).cast("long").alias("simple"))


_DECODED = "replace(replace(replace(replace(replace(replace(replace(title, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&')"


@query(rf"""WITH p AS (SELECT page_id, {_TITLE} AS title FROM pages), d AS (SELECT page_id, {_DECODED} AS name FROM p),
b AS (SELECT *, replace(regexp_replace(regexp_replace(name, '\([^)]*\)', ' ', 'g'), '{T.DECISIVE_FORMS}', ' ', 'gi'), '&', ' ') AS bare FROM d),
t AS (SELECT *, list_filter(string_split(regexp_replace(lower(bare), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN {T.DECISIVE_STOP}) AS tokens FROM b),
g AS (SELECT *, coalesce(nullif(list_position(list_transform(tokens, lambda w: w IN {T.GENERIC_ORG_WORDS}), TRUE), 0), len(tokens) + 1) AS generic FROM t)
SELECT page_id, name AS decoded, array_to_string(list_transform(string_split(name, ' '), lambda w: CASE WHEN length(w) <= 3 AND w = lower(w) THEN upper(replace(w, 'ß', 'ss')) ELSE concat(upper(replace(substr(w, 1, 1), 'ß', 'ss')), substr(w, 2)) END), ' ') AS pretty,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '{N.PICKER_FORMS}', '', 'g'), '^the\s+', ''), '\bcompany\b$', ''), '\s+', ' ', 'g')) AS picked,
  regexp_replace(lower(bare), '[^a-z0-9]', '', 'g') AS key, array_to_string(tokens[1:generic - 1], '') AS core_key, CASE WHEN len(tokens) >= 2 THEN array_to_string(list_transform(tokens, lambda w: substr(w, 1, 1)), '') ELSE '' END AS acronym FROM g""")
def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's title as a company's name: without entities, as shown, as searched for, and how it may show up as a host."""
    c = F.col
    rows = table(spark, sf_dir, "pages").select("page_id", T.decode_entities(H.title(c("html"))).alias("name"))
    forms = T.decisive_forms(c("name"))
    return rows.select("page_id", c("name").alias("decoded"), N.pretty_key(c("name")).alias("pretty"), N.picker_query(c("name")).alias("picked"), forms["key"].alias("key"), forms["core_key"].alias("core_key"), forms["acronym"].alias("acronym"))


# plans ---------------------------------------------------------------------------------------------------------------
_BRANDS = ("Vista", "Mercury", "Apex", "Summit", "Pulse")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, value FROM events), n AS (SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM e GROUP BY user_id)
SELECT n.key, n.event_id, e.event_type, e.value FROM n JOIN e USING (event_id)""")
def bucketed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events put into a keyed store in three changes, a later one with few users; the last change touches their buckets alone."""
    c = F.col
    path = f"{shared_dir(spark)}/orgweave/store-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(c("user_id").cast("string").alias("key"), "event_id", "ts", "event_type", "value", c("user_id").alias("u"))
    one = lambda df: df.groupBy("key").agg(F.max_by(F.struct("event_id", "ts", "event_type", "value"), F.struct("ts", "event_id")).alias("r")).select("key", "r.*")
    for part in (c("u") % 3 == 0, (c("u") % 3 == 1) | (c("event_id") % 2 == 0), F.lit(True)):
        store.merge(spark, one(rows.where(part)), path, "key", "ts", buckets=16)
    forget(spark, path)
    return store.read(spark, path).select("key", "event_id", "event_type", "value")


@query("""WITH n AS (SELECT c_custkey AS id, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key, c_acctbal AS b, c_mktsegment AS g FROM customer),
d AS (SELECT concat('customer', substr(s_name, 10)) AS key, concat('s', s_suppkey, '.example.com') AS domain FROM supplier),
o AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 300000), r AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 450000)
SELECT n.id AS company_id, CASE WHEN b > 9000 THEN 'learned' WHEN g = 'BUILDING' AND b > 6000 THEN 'major_firm' WHEN d.key IS NOT NULL THEN 'dictionary' WHEN o.id IS NOT NULL AND r.id IS NULL THEN 'pool' WHEN b > 0 THEN 'fallback' ELSE 'none' END AS stage,
CASE WHEN b > 9000 THEN concat('learned', n.id, '.com') WHEN g = 'BUILDING' AND b > 6000 THEN concat('major', n.id, '.com') WHEN d.key IS NOT NULL THEN d.domain WHEN o.id IS NOT NULL AND r.id IS NULL THEN concat(n.key, '.com') WHEN b > 0 THEN concat(n.key, '.org') END AS domain
FROM n LEFT JOIN d ON n.key = d.key LEFT JOIN o ON o.id = n.id LEFT JOIN r ON r.id = n.id""")
def staged_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer through the stages: balances decide what was learned, segments the major firms, suppliers' numbers the dictionary, orders who has candidates and whose were rejected."""
    c, lit = F.col, F.lit
    n = table(spark, sf_dir, "customer").select(c("c_custkey").alias("company_id"), c("c_name").alias("company"), T.store_key(c("c_name")).alias("key"), c("c_acctbal").alias("b"), c("c_mktsegment").alias("g"))
    entries = lambda df, domain: df.select("key", domain.alias("domain"), c("company_id").alias("entry_seq"))
    numbered = lambda word: F.concat(lit(word), c("company_id").cast("string"), lit(".com"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(lit("customer"), F.substring("s_name", 10, 9)).alias("key"), F.concat(lit("s"), c("s_suppkey").cast("string"), lit(".example.com")).alias("domain"), c("s_suppkey").alias("entry_seq"))
    orders = table(spark, sf_dir, "orders")
    with_orders = lambda above: n.join(keyed(orders.where(c("o_totalprice") > above).select(c("o_custkey").alias("company_id"))), "company_id", "left_semi")
    row = lambda df, end, source: df.select("company_id", lit(0).alias("seq"), F.concat(c("key"), lit(end)).alias("domain"), c("company").alias("name"), lit(source).alias("source"), lit(None).cast("string").alias("snippet"), lit(None).cast("int").alias("prominence"))
    rejected = with_orders(450_000).select("company_id", F.concat(c("key"), lit(".com")).alias("domain"))
    live = spark.createDataFrame([], "domain string, dns_ok boolean")
    out = resolve.resolve_staged(n.select("company_id", "company"), entries(n.where("b > 9000"), numbered("learned")), entries(n.where("g = 'BUILDING' AND b > 6000"), numbered("major")), suppliers,
                                 row(with_orders(300_000), ".com", "autocomplete"), row(n.where("b > 0"), ".org", "search"), rejected, live)
    return out.select("company_id", "stage", "domain")


_EDITED = f"""p AS (SELECT page_id, {_PAGE_HOST} AS host FROM pages), pool AS (SELECT page_id % 100 AS company_id, host FROM p),
e AS (SELECT DISTINCT user_id % 100 AS company_id FROM events WHERE event_type = 'error' AND value > 250), h AS (SELECT DISTINCT host FROM p JOIN events ON events.user_id = p.page_id AND event_type = 'signup' AND value > 250)"""


@query(f"""WITH {_EDITED} SELECT company_id FROM e UNION SELECT company_id FROM pool JOIN h USING (host) WHERE host <> ''""")
def affected_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies whose candidates are pages' hosts; some events edit a company, some change a page."""
    c = F.col
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    pool = pages.select((c("page_id") % 100).alias("company_id"), c("url").alias("domain"))
    edited = events.where("event_type = 'error' AND value > 250").select((c("user_id") % 100).alias("company_id"))
    changed = pages.join(events.where("event_type = 'signup' AND value > 250").select(c("user_id").alias("page_id")), "page_id", "left_semi")
    return refresh.affected_companies(pool, edited, changed)


@query(f"""WITH m AS ({_MADE}) SELECT k AS company_id, CASE k % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN k % 3 = 0 THEN concat(lower(z), 'robotics.com') END AS domain,
CASE WHEN k % 3 = 0 THEN 'high' ELSE 'low' END AS confidence, CASE k % 3 WHEN 0 THEN 'selected' WHEN 1 THEN 'short_common_name_ambiguous' ELSE 'no_candidates' END AS reason FROM m""")
def resolve_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company of every customer: one with a page of its own among its candidates, one of a common name, one with listed sites alone."""
    c, lit = F.col, F.lit
    brand = F.element_at(F.array(*map(lit, _BRANDS)), (c("k") % 5 + 1).cast("int"))
    m = _made(spark, sf_dir).select("k", F.concat(F.lower("z"), lit("robotics.com")).alias("own"), _case(3, F.concat(c("z"), lit(" Robotics")), brand, F.concat(c("z"), lit(" Widgets"))).alias("company"), "z")

    def row(of: int, seq: int, domain, name, source: str, snippet=None) -> DataFrame:
        return m.where(c("k") % 3 == of).select(c("k").alias("company_id"), lit(seq).alias("seq"), domain.alias("domain"), name.alias("name"), lit(source).alias("source"), (lit(None).cast("string") if snippet is None else snippet).alias("snippet"))

    pool = readers.stack(row(0, 0, c("own"), c("company"), "autocomplete", F.concat(c("company"), lit(" official website"))), row(0, 1, c("own"), c("company"), "infobox"), row(0, 2, F.concat(lit("shop."), c("own")), c("z"), "brand_guess"),
                         row(0, 3, lit("linkedin.com"), c("z"), "search"), row(1, 0, F.concat(F.lower("company"), lit(".com")), F.concat(c("company"), lit(" Print")), "autocomplete", lit("business cards")), row(2, 0, lit("facebook.com"), c("company"), "search"))
    site = F.format_string("<html><head><title>%1$s | Official Site</title><meta name='description' content='%1$s is a maker of robots'></head><body><h1>%1$s</h1><p>%1$s builds robots. © 2020 %1$s</p></body></html>", "company")
    pages = m.where(c("k") % 3 == 0).select(c("k").alias("page_id"), F.concat(lit("https://"), c("own"), lit("/")).alias("url"), site.alias("html"))
    out = resolve.resolve_identity(m.select(c("k").alias("company_id"), "company"), pool, pages)
    return out.select("company_id", "status", "domain", "confidence", "reason")


@query(f"""WITH m AS ({_MADE}) SELECT k AS company_id, CASE k % 3 WHEN 0 THEN concat(lower(z), 'capital.com') WHEN 1 THEN concat(lower(z), 'partners.de') END AS domain, CASE WHEN k % 3 = 0 THEN 'name-match' END AS decisive_rule,
CASE k % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS auto_found, CASE k % 3 WHEN 0 THEN 'found' WHEN 1 THEN 'potential' ELSE 'unverified' END AS status FROM m""")
def resolve_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    m = _made(spark, sf_dir).select("k", "z", F.lower("z").alias("low"), F.concat(c("z"), _case(3, " Capital", " Partners", " Quux")).alias("company"))

    def row(of: int, seq: int, domain, name, snippet: str, source: str, prominence: int | None = None) -> DataFrame:
        return m.where(c("k") % 3 == of).select(c("k").alias("company_id"), lit(seq).alias("seq"), domain.alias("domain"), name.alias("name"), lit(snippet).alias("snippet"), lit(source).alias("source"), lit(prominence).cast("int").alias("prominence"))

    at = lambda before, after: F.concat(lit(before), c("low"), lit(after))
    pool = readers.stack(row(0, 0, at("", "capital.com"), c("company"), "private equity", "autocomplete", 40), row(0, 1, at("www.", "capital.com"), c("company"), "private equity", "wikidata", 10), row(0, 2, at("", ".com"), c("z"), "retail shop", "brand_guess"),
                         row(1, 0, at("", "partners.de"), c("company"), "", "brand_guess"), row(1, 1, at("rejected-", ".com"), c("z"), "", "wikidata"))
    rejected = m.where(c("k") % 3 == 1).select(c("k").alias("company_id"), at("rejected-", ".com").alias("domain"))
    live = m.where(c("k") % 3 == 0).select(F.explode(F.array(at("", "capital.com"), at("", ".com"))).alias("domain"), lit(True).alias("dns_ok"))
    return resolve.resolve_pool(m.select(c("k").alias("company_id"), "company"), pool, rejected, live).select("company_id", "domain", "decisive_rule", "auto_found", "status")


@query(f"""WITH m AS ({_MADE}) SELECT k AS company_id, CASE WHEN k % 4 = 3 THEN 'Unknown' ELSE concat(city, ', ', code) END AS headquarters, CASE WHEN k % 4 = 3 THEN 'Unknown' ELSE {_BUCKET.format('n')} END AS headcount,
CASE WHEN k % 4 = 3 THEN 'Unknown' ELSE concat(p1, '; ', p2) END AS founders, CASE k % 4 WHEN 0 THEN 'Semiconductors' WHEN 1 THEN 'Venture Capital' WHEN 2 THEN 'Cybersecurity' ELSE 'Unknown' END AS industry FROM m""")
def enrich_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    m = _made(spark, sf_dir).withColumn("company", F.concat(c("z"), lit(" Labs")))
    kind = _case(4, "fabless semiconductor company", "venture capital firm", "cybersecurity platform", None)
    about = F.concat(c("company"), lit(" is a "), kind, lit(". "), c("company"), lit(" is headquartered in "), c("city"), lit(", "), c("code"), lit(". It employs about "), F.format_number("n", 0), lit(" people."))
    text = lambda seq, source, t: m.where(c("k") % 4 != 3).select(c("k").alias("company_id"), lit(seq).alias("seq"), lit(source).alias("source"), t.alias("text"), lit(4).alias("authority"))
    texts = text(0, "official_about", about).unionByName(text(1, "wikidata", F.concat(c("company"), lit(" was founded by "), c("p1"), lit(" and "), c("p2"))))
    companies = m.select(c("k").alias("company_id"), "company", F.when(c("k") % 4 != 3, F.concat(F.lower("z"), lit("labs.com"))).alias("domain"))
    return resolve.enrich_fields(companies, texts).select("company_id", "headquarters", "headcount", "founders", "industry")
