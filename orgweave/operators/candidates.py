"""Candidates: union of sources, consensus, merge by domain, rejection, deduplication and lookups. DataFrame in, DataFrame out.

Order matters for ties, so every input has a ``seq`` column; results never depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domains import host_of
from ..functions.fields import industry
from ..functions.matching import full_name_present
from ..functions.regex import text, trim
from ..functions.text import UNKNOWN, is_blank, match_key, store_key
from .joins import keyed

# --- fixed values -----------------------------------------------------------------------------------------------
#: How many of a company's candidates are looked up, and what a live host, one of a close name besides, and a dead one are worth.
TOP, LIVE, LIVE_CLOSE, DEAD, CLOSE_NAME = 5, 15, 8, -20, 35
#: Lengths of the pieces by which keys that hold each other are looked for: the shortest doubled so many times less one.
GRAM_SIZES = 4
# ----------------------------------------------------------------------------------------------------------------


def union_sources(*sources: DataFrame) -> DataFrame:
    """(company_id, seq, domain, name, snippet, source, prominence) of all sources, UNION ALL by name; sources keep their order."""
    numbered = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def consensus(candidates: DataFrame) -> DataFrame:
    """(company_id, domain, sources, agreement): the distinct sources that name a domain, sorted."""
    return (candidates.groupBy("company_id", "domain").agg(F.array_sort(F.collect_set("source")).alias("sources"))
            .withColumn("agreement", F.size("sources")))


def merge_by_domain(candidates: DataFrame) -> DataFrame:
    """One row per company and host: sources in order of appearance, the largest prominence, the first telling name (not the host
    itself), the first snippet, and the place of the first appearance. Rows whose domain is no host are left out.

    Rows are first reduced to one for each source, so what is collected for a host is its distinct sources.
    """
    valid = candidates.withColumn("domain", host_of(F.col("domain"))).where(F.col("domain").rlike(r"^[a-z0-9][a-z0-9.-]*\.[a-z]{2,}$"))
    name, snippet = trim(text("name")), trim(text("snippet"))
    telling = (name != "") & (F.lower(name) != F.col("domain"))
    by_place = lambda value: F.struct("seq", value)
    each = valid.groupBy("company_id", "domain", "source").agg(
        F.max("prominence").alias("prominence"), F.min(F.when(telling, by_place(name.alias("v")))).alias("name"), F.min(F.when(snippet != "", by_place(snippet.alias("v")))).alias("snippet"), F.min("seq").alias("seq"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda s: s["source"])
    return each.groupBy("company_id", "domain").agg(ordered.alias("sources"), F.max("prominence").alias("prominence"), F.min("name")["v"].alias("name"), F.min("snippet")["v"].alias("snippet"), F.min("seq").alias("seq"))


def reject_domains(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates whose domain was not rejected for their company."""
    return candidates.join(keyed(rejected.select("company_id", "domain").distinct()), ["company_id", "domain"], "left_anti")


def append_missing(candidates: DataFrame, others: DataFrame) -> DataFrame:
    """``others`` that the pool lacks, behind it."""
    new = others.join(candidates.select("company_id", "domain"), ["company_id", "domain"], "left_anti")
    return candidates.unionByName(new, allowMissingColumns=True)


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by ``order``, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def dedupe_names(names: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """The first row of each match key; a name without a key is dropped. One map-side-combined minimum instead of a window."""
    keyed = names.withColumn("match_key", match_key(F.col(name))).where("match_key <> ''")
    rest = [c for c in keyed.columns if c not in ("match_key", seq)]
    firsts = keyed.groupBy("match_key").agg(F.min(F.struct(seq, *rest)).alias("row"))
    return firsts.select("match_key", "row.*")


def exact_lookup(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Left equi-join of names with dictionary entries (key, domain, entry_seq) on the store key; the first entry wins."""
    entries = dictionary.groupBy("key").agg(F.min_by(F.struct("domain", "entry_seq"), "entry_seq").alias("entry"))
    out = names.withColumn("key", store_key(F.col("name"))).join(keyed(entries), "key", "left")
    return out.select(*names.columns, "key", F.col("entry.domain").alias("domain"), F.col("entry.entry_seq").alias("entry_seq"))


def _grams(key: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.length(key) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - size + 1), lambda i: F.substr(key, i, size))))


def met_by_grams(inner: DataFrame, outer: DataFrame, size: int = 4) -> DataFrame:
    """(inner, outer): pairs of keys (column ``key``, distinct) of which the first, ``size`` characters or more, may stand within the second; no pair that does is left out.

    A key within another has all its grams there, so it is looked for at its rarest alone: the one that the fewest outer keys hold, and where one
    of its grams is in none, nowhere. Beginnings that all keys share are never joined on. Grams are as long as the key allows, doubling from ``size``: of keys
    that are numbers behind one word, a short gram is in a fixed share of all, so that pairs to check would grow with the product of both sides.
    """
    c = F.col
    longest = size * 2 ** (GRAM_SIZES - 1)
    step = lambda key: F.least(F.pow(F.lit(2), F.floor(F.log2(F.length(key) / size))).cast("int") * size, F.lit(longest))
    held = reduce(DataFrame.unionAll, [outer.select(c("key").alias("outer"), F.explode(_grams(c("key"), size << i)).alias("gram")) for i in range(GRAM_SIZES)])
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    long_enough = inner.where(F.length("key") >= size)
    sought = long_enough.select(c("key").alias("inner"), F.explode(_grams(c("key"), step(c("key")))).alias("gram")).join(keyed(often), "gram", "left")
    rarest = sought.groupBy("inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("inner", c("r.gram").alias("gram"))
    return keyed(rarest).join(held, "gram").select("inner", "outer")


def contained_keys(inner: DataFrame, outer: DataFrame, size: int = 4) -> DataFrame:
    """(inner, outer): every pair of keys (column ``key``, distinct) of which the first, ``size`` characters or more, stands within the second."""
    return met_by_grams(inner, outer, size).where(F.contains("outer", "inner"))


def fuzzy_lookup(names: DataFrame, dictionary: DataFrame, least: int = 4) -> DataFrame:
    """Exact match, else the first entry, in dictionary order, that holds the name or is held by it (both of ``least`` characters).

    Containment is looked for by rare grams, in both directions, among distinct keys; names of one key are looked up once.
    """
    c = F.col
    held = names.withColumn("key", store_key(c("name")))
    keys = held.select("key").where("key <> ''").distinct()
    entries = dictionary.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("entry_seq", "domain")).alias("e")).select(c("key").alias("of"), "e.entry_seq", "e.domain")
    of = entries.select(c("of").alias("key"))
    pairs = (contained_keys(keys, of, least).select(c("inner").alias("key"), c("outer").alias("of")).unionAll(contained_keys(of, keys, least).select(c("outer").alias("key"), c("inner").alias("of")))
             .unionAll(keys.select("key", c("key").alias("of"))))
    best = pairs.join(keyed(entries), "of").groupBy("key").agg(F.min(F.struct((c("of") != c("key")).alias("other"), "entry_seq", "domain")).alias("b"))
    return held.join(keyed(best), "key", "left").select(*names.columns, "key", c("b.domain").alias("domain"), c("b.entry_seq").alias("entry_seq"), (~c("b.other")).alias("exact"))


def _endings(host: Column) -> Column:
    """The endings of a host that hold a dot, itself among them."""
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(host), F.lit(1))), lambda i: F.substr(host, i, F.length(host))), lambda e: F.contains(e, F.lit(".")))


def related_hosts(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(found, wanted): distinct pairs of hosts (column ``host``) of which one ends in the other. Each side's endings meet the other side's hosts, so both are equi-joins."""
    c = F.col
    one, other = (df.select(c("host")).where(F.contains("host", F.lit("."))).distinct() for df in (found, wanted))
    longer = one.select(c("host").alias("found"), F.explode(_endings(c("host"))).alias("wanted")).join(other.select(c("host").alias("wanted")), "wanted").select("found", "wanted")
    shorter = other.select(c("host").alias("wanted"), F.explode(_endings(c("host"))).alias("found")).join(one.select(c("host").alias("found")), "found").select("found", "wanted").where("found <> wanted")
    return longer.unionAll(shorter)


def search_snippets(candidates: DataFrame, hits: DataFrame, most: int = 1500) -> DataFrame:
    """(company_id, domain, search_snippets) of candidates (company_id, company, domain): what their company's search hits (company_id, seq, host, title, snippet) say
    of them, in order. A hit is a candidate's if one host ends in the other, or if it names the company in full.

    Hits and candidates meet by their company, which has few of either. A hit without words says nothing.
    """
    c = F.col
    host, said = host_of(c("host")), F.coalesce(F.nullif(text("snippet"), F.lit("")), F.nullif(text("title"), F.lit("")))
    told = hits.select("company_id", "seq", host.alias("found"), said.alias("said"), F.concat_ws(" ", text("title"), text("snippet")).alias("words")).where("said IS NOT NULL")
    pairs = candidates.select("company_id", "company", "domain").distinct().join(told, "company_id")
    near = (c("found") != "") & (c("domain").endswith(c("found")) | c("found").endswith(c("domain")))
    own = pairs.where(near | full_name_present(c("company"), c("words")))
    return own.groupBy("company_id", "domain").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "said"))), lambda h: h["said"]), " · "), 1, most).alias("search_snippets"))


def merge_signals(rows: DataFrame) -> DataFrame:
    """One row per company and domain of rows (company_id, domain, seq, source, exact, signals map<string,int>): each signal's maximum, their sum as ``total``, the distinct
    sources in order of appearance, and whether any row's name was exact.

    Signals are taken apart, maximised map-side and put together again, so what is collected for a domain is its distinct names of signals and sources. A row without
    signals has none to give; a null signal counts as missing.
    """
    c, keys = F.col, ["company_id", "domain"]
    highest = rows.select(*keys, F.explode("signals").alias("signal", "points")).where("points IS NOT NULL").groupBy(*keys, "signal").agg(F.max("points").alias("points"))
    signals = highest.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "points")))).alias("signals"), F.sum("points").cast("int").alias("total"))
    each = rows.groupBy(*keys, "source").agg(F.min("seq").alias("seq"), F.coalesce(F.bool_or("exact"), F.lit(False)).alias("exact"))
    told = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "source"))).alias("s"), F.bool_or("exact").alias("exact"), F.min("seq").alias("seq"))
    both = told.withColumnsRenamed({k: f"_{k}" for k in keys}).join(signals, c("_company_id").eqNullSafe(c("company_id")) & c("_domain").eqNullSafe(c("domain")), "left")
    return both.select(c("_company_id").alias("company_id"), c("_domain").alias("domain"), F.filter(F.transform("s", lambda x: x["source"]), lambda x: x.isNotNull()).alias("sources"), "exact",
                       F.coalesce("signals", F.create_map().cast("map<string,int>")).alias("signals"), F.coalesce("total", F.lit(0)).alias("total"), "seq")


def rank_evidence(merged: DataFrame, live: DataFrame) -> DataFrame:
    """``merged`` with ``place`` among its company's candidates, after the five best were looked up in ``live`` (domain, dns_ok): a live host gains, one that isn't loses.

    Ties go to what appeared first. A company's candidates are few, so each is ranked in one place.
    """
    c = F.col
    at = lambda *order: F.row_number().over(Window.partitionBy("company_id").orderBy(*order, "seq", "domain"))
    known = live.groupBy("domain").agg(F.bool_or("dns_ok").alias("dns_ok"))
    top = merged.withColumn("first", at(c("total").desc())).join(known, "domain", "left").withColumn("dns_ok", F.when(c("first") <= TOP, F.coalesce("dns_ok", F.lit(False))))
    close = c("exact") | (F.coalesce(F.get(F.map_values(F.map_filter("signals", lambda k, _: k == "name_similarity")), F.lit(0)), F.lit(0)) >= CLOSE_NAME)
    dns = F.when(c("dns_ok"), LIVE + F.when(close, LIVE_CLOSE).otherwise(0)).when(~c("dns_ok"), DEAD).otherwise(0)
    return top.withColumn("total", c("total") + dns).withColumn("place", at(c("total").desc(), "first")).drop("first")


def longest_key_per_domain(dictionary: DataFrame) -> DataFrame:
    """Of each domain the longest key; of equally long ones the first."""
    return dictionary.groupBy("domain").agg(F.max_by("key", F.struct(F.length("key"), -F.col("entry_seq"))).alias("key"))


def uniqueness_guard(rows: DataFrame, value: str, owner: str = "domain", seq: str = "seq", least: int = 4) -> DataFrame:
    """A value is kept by the first owner that has it, and blanked for all others; short values are free to repeat.

    The first owners are a map-side-combined minimum that is joined back, so a value that is everywhere is no hot window.
    """
    norm = F.lower(trim(text(value)))
    held = rows.withColumn("_norm", F.when(F.length(norm) >= least, norm))
    firsts = held.where("_norm IS NOT NULL").groupBy("_norm").agg(F.min_by(owner, seq).alias("_first"))
    out = held.join(firsts, "_norm", "left")
    return out.withColumn(value, F.when(F.col("_first").isNull() | (F.col("_first") == F.col(owner)), F.col(value))).drop("_norm", "_first")


def once_per_owner(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """What a batch gave before values could repeat: an industry, in canonical form, stays with the first domain that has it and is Unknown for all others."""
    shown = rows.withColumn("industry", industry(F.col("industry")))
    known = shown.withColumn("industry", F.when(~is_blank(F.col("industry")), F.col("industry")))
    return uniqueness_guard(known, "industry", "domain", seq, least=1).withColumn("industry", F.coalesce("industry", F.lit(UNKNOWN)))
