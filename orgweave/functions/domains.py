"""Hosts and addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import has, let, text, trim
from .text import identity_key, identity_tokens, store_key

# --- fixed values -----------------------------------------------------------------------------------------------
#: First labels that name a property of a site, not its owner: as dropped from a host, and as penalized.
PROPERTY_LABELS = r"^(ir|investors?|www|shop|store|careers|jobs|support|help|community|developers?|docs|blog|news|press|events|games|merch)$"
PENALIZED_LABELS = r"^(ir|investors?|shop|store|careers|jobs|support|help|community|developer|developers|docs|blog|news|press|events|games|casualgames|merch|marketplace)$"
TWO_PART_TLDS = r"\.(co\.uk|com\.au|co\.nz|com\.br|co\.za|org\.uk|com\.mx)$"
#: Sites about companies rather than of them.
JUNK_HOSTS = (
    "linkedin.com", "crunchbase.com", "pitchbook.com", "bloomberg.com", "reuters.com", "wikipedia.org", "wikidata.org", "facebook.com", "twitter.com", "x.com", "youtube.com",
    "instagram.com", "glassdoor.com", "indeed.com", "levels.fyi", "wellfound.com", "angel.co", "medium.com", "substack.com", "msn.com", "mercurynews.com", "forbes.com",
    "techcrunch.com", "businessinsider.com", "nytimes.com", "wsj.com", "ft.com", "yahoo.com", "bing.com", "google.com", "zoominfo.com", "apollo.io", "rocketreach.com", "owler.com",
    "tracxn.com", "cbinsights.com", "mediafire.com", "hci.org")
# ----------------------------------------------------------------------------------------------------------------


def host_of(c: Column) -> Column:
    """The host, lower case, without scheme, ``www.``, path and query; a port or fragment without a path stays."""
    s = F.regexp_replace(F.lower(text(c)), r"[\[\]]", "")
    s = F.regexp_replace(s, r"^(https?://)?(www\.)?", "")
    return trim(F.substring_index(F.substring_index(s, "/", 1), "?", 1))


def labels(host: Column) -> Column:
    return F.split(host, r"\.")


def tld(host: Column) -> Column:
    return F.element_at(labels(host), -1)


def without_property_label(c: Column) -> Column:
    """The host without a leading property label (of three labels or more)."""
    return let(labels(host_of(c)), lambda parts: F.array_join(F.when(
        (F.size(parts) >= 3) & has(F.element_at(parts, 1), PROPERTY_LABELS), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), "."))


def clean_host(c: Column) -> Column:
    """The host without port and characters that hosts can't have."""
    s = F.regexp_replace(F.regexp_replace(F.lower(trim(text(c))), "^https?://", ""), r"^www\.", "")
    s = F.substring_index(F.substring_index(s, "/", 1), "?", 1)
    return F.regexp_replace(F.regexp_replace(s, r":\d+$", ""), "[^a-z0-9.-]", "")


def registrable(c: Column) -> Column:
    """The last two labels, three under a country's second level."""

    def body(parts: Column) -> Column:
        two, three = (F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".") for n in (2, 3))
        deep = has(two, r"^(co|com|org|net|gov|ac)\.[a-z]{2}$") | has(three, r"\.(co|com|org|net)\.[a-z]{2}$")
        return F.when(deep & (F.size(parts) > 2), three).otherwise(two)

    return let(F.filter(labels(clean_host(c)), lambda p: p != ""), body)


def decisive_tld(c: Column) -> Column:
    host = F.regexp_replace(F.lower(text(c)), r"^www\.", "")
    two = F.regexp_extract(host, "(?i)" + TWO_PART_TLDS, 1)
    return F.when(two != "", two).otherwise(tld(host))


def store_domain(c: Column) -> Column:
    s = F.regexp_replace(F.lower(trim(text(c))), r"^(https?://)?(www\.)?", "")
    return F.regexp_replace(F.substring_index(s, "/", 1), "[^a-z0-9.-]", "")


def domain_base(c: Column) -> Column:
    """The first label's letters and digits."""
    return store_key(F.element_at(labels(F.regexp_replace(F.lower(text(c)), r"^www\.", "")), 1))


def text_host(c: Column) -> Column:
    """The host of the first address in a text, bracketed or bare; null without one."""
    s = F.lower(text(c))
    found = F.regexp_extract(s, r"(?:\[|https?://|\b)(?:https?://)?(?:www\.)?((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24})", 1)
    return F.nullif(found, F.lit(""))


def official_guesses(domain: Column, name: Column) -> Column:
    """Hosts a company may own, in order: the host, its owner's, then name and first word as ``.com``, and two words as a domain."""
    host, key, tokens = host_of(domain), identity_key(name), identity_tokens(name)
    one, two = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    made = F.array(host, without_property_label(domain), F.when(F.length(key) >= 3, F.concat(key, F.lit(".com"))), F.concat(one, F.lit(".com")),
                   F.when(F.size(tokens) == 2, F.concat_ws(".", one, two)))
    return F.when(host != "", F.array_distinct(F.array_compact(made))).otherwise(F.array().cast("array<string>"))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one below the other."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def matches_expected(got: Column, expected: Column, alternatives: Column | None = None) -> Column:
    wanted = F.array(expected) if alternatives is None else F.concat(F.array(expected), F.coalesce(alternatives, F.array().cast("array<string>")))
    hosts = F.filter(F.transform(wanted, host_of), lambda h: h != "")
    return let(host_of(got), lambda g: F.exists(hosts, lambda h: same_site(g, h)))


def is_junk_host(host: Column) -> Column:
    """A listed site or a host below one; ``netflix.com`` is not below ``x.com``."""
    return has(host, r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in JUNK_HOSTS) + r")(/|$)")


def is_regional_sibling(rival: Column, best: Column) -> Column:
    """The same first label under a country's domain, where the best is under a generic one."""
    r, b = (F.regexp_replace(F.lower(text(x)), r"^www\.", "") for x in (rival, best))
    return ((domain_base(r) != "") & (domain_base(r) == domain_base(b)) & r.rlike(r"\.[a-z]{2}$") & ~r.rlike(r"\.(com|org|net|io|co|ai|us)$")
            & b.rlike(r"\.(com|org|net|io|ai|edu|gov)$"))
