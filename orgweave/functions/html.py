"""Pages and wiki texts: what their markup says. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import distinct_nocase, every, first, rx, squeeze, sub, text, trim
from .text import page_tokens

_ORGANIZATION = r"Organization|Corporation|LocalBusiness"


def html_text(html: Column) -> Column:
    """The words of a page, without scripts, styles and tags."""
    s = text(html)
    for pattern in (r"(?s)<script.*?</script>", r"(?s)<style.*?</style>", r"<[^>]+>"):
        s = F.regexp_replace(s, "(?i)" + pattern, " ")
    return squeeze(F.replace(F.replace(s, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))


def title(html: Column) -> Column:
    return squeeze(F.regexp_extract(text(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def heading(html: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_extract(text(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " "))


def meta(html: Column, name: str) -> Column:
    """A meta element's content, by ``name`` or ``property``, whichever attribute comes first; empty without one."""
    s = text(html)
    ahead = F.regexp_extract(s, rf"(?is)<meta[^>]+(?:name|property)=[\"']{name}[\"'][^>]+content=[\"']([^\"']*)[\"']", 1)
    behind = F.regexp_extract(s, rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+(?:name|property)=[\"']{name}[\"']", 1)
    return trim(F.coalesce(F.nullif(ahead, F.lit("")), behind))


def canonical(html: Column) -> Column:
    return F.regexp_extract(text(html), r"(?is)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']+)[\"']", 1)


def copyright_line(page_text: Column) -> Column:
    return F.regexp_extract(text(page_text), r"©\s*\d{4}[^.\n]{0,60}", 0)


def page_identity(html: Column) -> Column:
    """struct(title, description, site_name, heading)."""
    description = F.coalesce(F.nullif(meta(html, "description"), F.lit("")), F.nullif(meta(html, "og:description"), F.lit("")), F.lit(""))
    return F.struct(title(html).alias("title"), description.alias("description"), meta(html, "og:site_name").alias("site_name"), heading(html).alias("heading"))


def json_ld_organizations(html: Column) -> Column:
    """The organizations (name, url) of a page's JSON-LD, in order: a node, an array of nodes or a graph. Bad JSON is left out."""
    scripts = F.regexp_extract_all(text(html), F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))

    def nodes(script: Column) -> Column:
        v = F.try_parse_json(script)
        graph = F.try_variant_get(v, "$['@graph']", "array<variant>")
        return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), graph, F.when(v.isNotNull(), F.array(v)))

    def kind(node: Column) -> Column:
        many = F.try_variant_get(node, "$['@type']", "array<string>")
        return F.coalesce(F.array_join(many, " "), F.try_variant_get(node, "$['@type']", "string"), F.lit(""))

    every_node = F.flatten(F.transform(scripts, lambda s: F.coalesce(nodes(s), F.array().cast("array<variant>"))))
    kept = F.filter(every_node, lambda n: kind(n).rlike(rx(_ORGANIZATION)))
    return F.transform(kept, lambda n: F.struct(F.try_variant_get(n, "$.name", "string").alias("name"), F.try_variant_get(n, "$.url", "string").alias("url")))


def token_overlap(name: Column, page: Column) -> Column:
    """struct(tokens, hits): how many of a name's telling words stand in a page's title, description, site name or heading."""
    blob = F.lower(F.concat_ws(" ", page["title"], page["description"], page["site_name"], page["heading"]))
    tokens = page_tokens(name)
    return F.struct(F.size(tokens).alias("tokens"), F.size(F.filter(tokens, lambda t: F.contains(blob, t))).alias("hits"))


def confirms_company(name: Column, page_text: Column) -> Column:
    """Whether at least six tenths of a name's words of three letters or more stand in a page."""
    tokens = F.filter(F.split(F.regexp_replace(F.lower(text(name)), "[^a-z0-9]+", " "), " "), lambda t: F.length(t) >= 3)
    low = F.lower(text(page_text))
    hits = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    return (F.size(tokens) > 0) & (hits >= F.ceil(F.size(tokens) * 0.6))


# wiki text

def infobox_value(raw: Column) -> Column:
    s = text(raw)
    for pattern, to in ((r"\{\{[^}]*\}\}", " "), (r"\[\[(?:[^|\]]+\|)?([^\]]+)\]\]", "$1"), (r"(?s)<ref.*?</ref>", " "), (r"<br\s*/?>", ", "), (r"<[^>]+>", " "), (r"'{2,}", "")):
        s = F.regexp_replace(s, "(?i)" + pattern, to)
    return squeeze(s)


def infobox_field(wikitext: Column, *keys: str) -> Column:
    """The value of the first key that an infobox gives; empty without one."""
    found = []
    for key in keys:
        raw = first(text(wikitext), rf"(?s)\|\s*{key}\s*=\s*(.*?)(?=\n\s*\|\s*[a-zA-Z_][a-zA-Z0-9_]*\s*=|\n\}}\}}|$)")
        found.append(F.when(trim(raw) != "", infobox_value(raw)))
    return F.coalesce(*found, F.lit(""))


def year(c: Column) -> Column:
    return F.regexp_extract(text(c), rx(r"\b(1[89]\d{2}|20[0-2]\d)\b"), 1).try_cast("int")


def infobox(wikitext: Column) -> Column:
    """struct(industry, founded, founded_year, hq, former_names)."""
    founded = infobox_field(wikitext, "founded", "established", "foundation")
    return F.struct(infobox_field(wikitext, "industry", "industries").alias("industry"), founded.alias("founded"), year(founded).alias("founded_year"),
                    infobox_field(wikitext, "headquarters", "hq", "hq_location", "hq_location_city", "location", "location_city").alias("hq"),
                    infobox_field(wikitext, "former_name", "former_names", "native_name", "aka", "also_known_as", "traded_as").alias("former_names"))


def infobox_founders(wikitext: Column) -> Column:
    """The linked names of the founder field, else its plain ones."""
    raw = first(text(wikitext), r"(?s)\|\s*founders?\s*=\s*(.*?)(?=\n\s*\|\s*[a-zA-Z_][a-zA-Z0-9_]*\s*=|\n\}\})")
    linked = F.transform(every(raw, r"\[\[(?!File:|Image:)([^\]|#]+)(?:\|[^\]]+)?\]\]"), lambda n: squeeze(sub(n, r"\s*\([^)]*\)", "")))
    plain = F.filter(F.transform(F.split(infobox_value(raw), rx(r"\s*(?:,|;|\band\b)\s*")), trim), lambda n: n != "")
    return distinct_nocase(F.filter(F.when(F.size(linked) > 0, linked).otherwise(plain), lambda n: n.rlike(r"^\S+\s+\S+")))
