"""Candidate scores: names against hosts, affiliates and entity types, and the three generations of total scores.

The functions add columns. Points are collected as an array of (signal, points) pairs, nulls where a signal does not apply, and
summed at the end, so that a score can always be explained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import text as T
from ..functions.regex import cut, half_up, has, let, text, trim, words

# --- fixed values -----------------------------------------------------------------------------------------------
FINANCE_PHRASES = (
    "investment management", "venture capital", "private equity", "asset management", "financial advisory", "financial advisor", "wealth management", "hedge fund",
    "capital markets", "family office", "broker dealer", "broker-dealer", "investment bank", "investment banking", "fund services", "fund administration", "alternative asset",
    "growth equity", "private credit", "credit fund", "sovereign wealth", "merchant bank", "private bank", "buyout", "fintech", "financial technology", "financial services",
    "payments", "payment processing", "payment platform", "neobank", "robo-advisor", "robo advisor")
FINANCE_WORDS = ("capital", "ventures", "venture", "investment", "investments", "investor", "investors", "equity", "hedge", "wealth", "fintech", "securities", "banking", "bank", "asset",
                 "assets", "advisory", "advisor", "advisors", "fund", "funds", "holdings", "credit", "lending", "brokerage", "broker", "pe", "vc", "payments", "payment", "financing")
UNRELATED_PHRASES = (
    "retail", "grocery", "supermarket", "restaurant", "restaurants", "cafe", "coffee shop", "bakery", "entertainment", "media", "publishing", "newspaper", "magazine", "music",
    "gaming", "video game", "cinema", "film studio", "movie", "television", "fashion", "apparel", "clothing", "cosmetics", "beauty", "food & beverage", "food and beverage", "hotel",
    "hospitality", "travel agency", "sports", "nightlife", "casino", "e-commerce", "ecommerce", "marketplace", "consumer goods", "consumer electronics", "cpg", "toys",
    "grocery store", "fast food", "streaming entertainment", "hospital", "healthcare", "health care", "clinic", "medical center", "biotech", "biotechnology", "therapeutics",
    "pharmaceutical", "medical device", "robotics", "aerospace", "semiconductor")
FINANCE_HOST = r"\b(capital|ventures|venture|invest|advisory|advisor|wealth|asset|fund|equity|fintech|bank|hedge|payment)\b"
FINANCE_HOST_WIDE = r"\b(capital|ventures|venture|invest|advisory|advisor|wealth|assetmgmt|asset|fund|equity|fintech|bank|hedge|payment)\b"
ENTITY_TYPES = (
    ("investment_firm", r"\b(private equity|venture capital|venture firm|buyout|growth equity|investment firm)\b", None),
    ("store", r"\b(official merchandise|online store|shop now|add to cart|checkout)\b|\.shop\b", None),
    ("product", r"\b(game|gaming|xbox|playstation|casual games)\b", r"\b(company|corporation|headquartered)\b"),
    ("careers", r"^.{0,399}$", None), ("print_services", r"\b(printing|business cards|vista ?print)\b", None), ("nonprofit", r"\b(nonprofit|foundation|charity)\b", None),
    ("company", r"\b(is an?|corporation|headquartered|multinational|company that)\b", None))
PURPOSES = (
    ("store_purpose", -55, r"\b(official\s+)?(merchandise|merch store|online store|gift shop)\b"), ("ecommerce_cta", -40, r"\b(add to cart|shop all|buy now)\b"),
    ("investor_relations", -45, r"\b(investor relations|shareholder|stock information)\b"), ("careers_site", -35, r"\b(careers at|we.?re hiring|open roles)\b"),
    ("developer_portal", -30, r"\b(developer portal|api documentation|docs for developers)\b"), ("games_property", -55, r"\b(casual games|xbox games|game studio microsite)\b"),
    ("print_brand", -50, r"\b(vistaprint|online printing|business cards|custom printing)\b"))
AGGREGATORS = (
    "linkedin.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "tiktok.com", "pinterest.com", "reddit.com", "crunchbase.com", "pitchbook.com",
    "zoominfo.com", "dnb.com", "bloomberg.com", "reuters.com", "forbes.com", "glassdoor.com", "indeed.com", "yelp.com", "wikipedia.org", "wikidata.org", "wikimedia.org",
    "medium.com", "owler.com", "rocketreach.co", "signalhire.com", "zippia.com", "trustpilot.com", "mapquest.com", "bbb.org", "manta.com", "bizapedia.com", "opencorporates.com",
    "apollo.io", "leadiq.com", "lusha.com", "google.com", "bing.com", "duckduckgo.com")
FREE_HOSTS = ("wordpress.com", "blogspot.com", "wixsite.com", "weebly.com", "squarespace.com", "godaddysites.com", "sites.google.com", "tumblr.com", "substack.com", "notion.site",
              "github.io", "webflow.io", "myshopify.com")
PARKED = ("hugedomains.com", "buydomains.com", "afternic.com", "sedo.com", "dan.com", "parkingcrew.net", "bodis.com", "domainmarket.com", "squadhelp.com", "brandbucket.com")
INVESTMENT_NAME = r"\b(capital|ventures?|partners|equity)\b"
# ----------------------------------------------------------------------------------------------------------------


def pair(name: str, points: Column | int, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("signal"), (F.lit(points) if isinstance(points, int) else points).cast("int").alias("points")))


def total(signals: Column) -> Column:
    return F.aggregate(signals, F.lit(0), lambda a, s: a + s["points"])


def as_map(signals: Column) -> Column:
    """Points by signal; a signal that applies twice adds up."""
    names = F.array_distinct(F.transform(signals, lambda s: s["signal"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: total(F.filter(signals, lambda s: s["signal"] == n))))


def _holds_any(c: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(c, p))


def finance_affinity(domain: Column, name: Column, snippet: Column, brands: tuple[str, ...] = (), known_domains: tuple[str, ...] = ()) -> Column:
    """``finance``, ``unrelated`` or ``neutral``. Known brands and domains are data of the caller."""
    host = F.regexp_replace(F.lower(text(domain)), r"^www\.", "")
    blob = F.lower(F.concat_ws(" ", text(name), host, text(snippet)))
    spaced = F.replace(host, F.lit("."), F.lit(" "))
    known = F.lit(False)
    if brands:
        known = T.store_key(name).isin(*brands) | F.substring_index(host, ".", 1).isin(*brands)
    if known_domains:
        known = known | host.isin(*known_domains)
    finance = let(blob, lambda b: F.when(_holds_any(b, UNRELATED_PHRASES) & ~_holds_any(b, FINANCE_PHRASES) & ~has(spaced, FINANCE_HOST), "unrelated")
                  .when(_holds_any(b, FINANCE_PHRASES) | has(spaced, FINANCE_HOST_WIDE) | has(b, r"\b(" + "|".join(FINANCE_WORDS) + r")\b"), "finance").otherwise("neutral"))
    return F.when(trim(blob) == "", "neutral").when(known, "finance").otherwise(finance)


def entity_type(blob: Column) -> Column:
    """What a page is about, by the first of seven rules; ``unknown`` for no text."""
    out = F.lit("unknown")
    for name, pattern, veto in reversed(ENTITY_TYPES):
        hit = has(blob, r"\b(careers|we.?re hiring|job openings)\b") & (F.length(blob) < 400) if name == "careers" else has(blob, pattern)
        out = F.when(hit & ~has(blob, veto) if veto else hit, name).otherwise(out)
    return F.when(blob == "", "unknown").otherwise(out)


def affiliate_signals(host: Column, title: Column, description: Column, page_text: Column) -> list[Column]:
    """Penalties of a host that is a property or mirror of a brand rather than its site."""
    parts, head = D.labels(host), F.lower(cut(text(page_text), 1500))
    t, d = F.lower(text(title)), F.lower(text(description))
    deep, sub = F.size(parts) >= 3, F.element_at(parts, 1)
    near = has(F.concat(t, d), r"store|shop|careers|games|printing|investor")
    return [pair("property_subdomain", -55, deep & has(sub, D.PENALIZED_LABELS)), pair("non_apex_host", -25, deep & (sub != "www")),
            pair("commerce_tld", -60, has(host, r"\.shop$|\.store$|(^|\.)shop\.|(^|\.)store\.")),
            pair("affiliate_host_token", -50, has(F.replace(host, F.lit("."), F.lit("")), r"(casualgames|merchandise|merch|fanclub|community|support|careers|jobs|developers?|devportal|events)")),
            *[pair(name, points, has(t, p) | has(d, p) | (has(head, p) & near)) for name, points, p in PURPOSES],
            pair("regional_cctld", -45, has(host, r"\.(co\.[a-z]{2}|com\.[a-z]{2}|com\.br|com\.co|com\.mx|com\.au)$"))]


def _ratio(hits: Column, n: Column) -> Column:
    return F.when(n > 0, hits / n).otherwise(F.lit(0.0))


def score_identity(candidates: DataFrame) -> DataFrame:
    """Add ``score``, ``signals`` (a map), ``host_core``, ``token_coverage``, ``authoritative``, ``entity_type`` and ``risk`` to candidates with evidence.

    Needs ``company, domain, name, source, agreement`` and evidence ``title, description, snippet, page_text, json_ld_name, wikidata_official``
    (nulls where unknown). Columns are added in steps, each a plain projection that the optimizer merges.
    """
    c = F.col
    df = candidates
    df = df.withColumns({"host": D.host_of(c("domain")), "key": T.identity_key(c("company")), "tokens": T.identity_tokens(c("company")), "plain": T.identity_name(c("company")),
                         "t": trim(text("title")), "d": trim(text("description")), "sn": trim(text("snippet")), "body": cut(text("page_text"), 5000), "label": trim(text("name")),
                         "ld": trim(text("json_ld_name")), "agree": F.coalesce(c("agreement"), F.lit(0)), "src": text("source"), "risk": T.ambiguity_risk(c("company"))})
    df = df.withColumns({"labels": D.labels(c("host")), "distinctive": F.filter("tokens", lambda w: (F.length(w) >= 4) & ~w.isin(*T.COMMON_BRANDS)),
                         "first": F.coalesce(F.get("tokens", F.lit(0)), F.lit("")), "is_ai": (F.size("tokens") == 2) & F.coalesce(F.get("tokens", F.lit(1)) == "ai", F.lit(False)),
                         "invest_name": has(text("company"), INVESTMENT_NAME)})
    drop = F.when((F.size("labels") >= 3) & F.coalesce(F.try_element_at("labels", F.lit(-2)).isin("co", "com", "net", "org", "gov", "ac"), F.lit(False)), 2).otherwise(1)
    core = F.array_join(F.slice("labels", F.lit(1), F.greatest(F.size("labels") - drop, F.lit(0))), "")
    df = df.withColumn("host_core", F.coalesce(F.nullif(core, F.lit("")), F.element_at("labels", 1)))
    df = df.withColumn("wanted", F.filter("tokens", lambda w: ~(c("is_ai") & (w == "ai"))))
    inside = lambda w: F.contains(c("host_core"), w) | F.contains(c("host"), w)
    df = df.withColumns({"hits": F.size(F.filter("wanted", inside)), "distinct_hits": F.size(F.filter("distinctive", inside)),
                         "suffix": F.when(c("host_core").startswith(c("key")), F.substr("host_core", F.length("key") + 1)),
                         "glued": F.when(c("host_core").startswith(c("first")), F.substr("host_core", F.length("first") + 1)),
                         "invest_text": has(F.concat_ws(" ", "t", "d", "sn", cut(c("body"), 800)), r"venture|private equity|investment firm|capital firm|early-stage|seed fund"),
                         "entity_type": entity_type(F.lower(trim(F.concat_ws(" ", *[F.nullif(c(x), F.lit("")) for x in ("t", "d", "sn")], F.nullif(cut(c("body"), 2000), F.lit(""))))))})
    df = df.withColumn("token_coverage", _ratio(c("hits"), F.size("wanted")))
    key, host_core, tokens = c("key"), c("host_core"), c("tokens")
    as_tld = (F.size(tokens) == 2) & (F.size("labels") == 2) & F.coalesce((F.get("labels", F.lit(0)) == F.get(tokens, F.lit(0))) & (F.get("labels", F.lit(1)) == F.get(tokens, F.lit(1))), F.lit(False))
    exact, primary = host_core == key, (c("first") != "") & (host_core == c("first")) & (F.size(tokens) >= 2)
    longer = (F.length(key) >= 4) & host_core.startswith(key) & (F.length(host_core) > F.length(key) + 2)
    holds = (F.length(key) >= 4) & F.contains(host_core, key)
    glue = ((F.length("first") >= 4) & (F.length("glued") >= 3) & ~has(c("glued"), r"^(ai|hq|inc|corp|app|io)$") & ~F.exists(tokens, lambda w: (w != c("first")) & F.contains(c("glued"), w)))
    label_tokens, ld_tokens = T.identity_tokens(c("label")), T.identity_tokens(c("ld"))
    overlap = let(label_tokens, lambda l: F.size(F.filter(tokens, lambda w: F.array_contains(l, w))))
    ld_overlap = F.size(F.filter(ld_tokens, lambda w: F.array_contains(tokens, w)))
    plain, tl, dl, sl, hl = c("plain"), F.lower("t"), F.lower("d"), F.lower("sn"), F.lower(cut(c("body"), 1200))
    quoted = F.regexp_replace(plain, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    about = F.regexp_like(dl, F.concat(F.lit(r"\b"), quoted, F.lit(r"\b.*(is an?|is a|provides|builds)"))) | F.regexp_like(dl, F.concat(F.lit(r"(is an?|is a)\b.*\b"), quoted))
    c_line = F.regexp_extract("body", r"©\s*\d{4}[^.\n]{0,60}", 0)
    two = F.when((F.size("labels") >= 3) & (F.length(F.try_element_at("labels", F.lit(-2))) <= 3), F.array_join(F.slice("labels", -2, 2), ".")).otherwise(F.element_at("labels", -1))
    wants = has(text("company"), r"\b(capital|ventures?|partners|equity|private equity|venture)\b")
    first_pass = [
        pair("junkDomain", -120, D.is_junk_host(c("host"))),
        pair("tokenAsTldMatch", F.when(c("invest_text"), 50).otherwise(18), as_tld),
        pair("domainExactKey", 40, exact), pair("primaryTokenDomain", F.when(c("is_ai"), 38).otherwise(10), ~exact & primary),
        pair("brandSuffixNoise", -55, ~exact & ~primary & longer & ~has(c("suffix"), r"^(hq|inc|corp|app)$")), pair("domainContainsKey", 12, ~exact & ~primary & ~longer & holds),
        pair("concatAiDomainPenalty", -45, c("is_ai") & ((host_core == F.concat(c("first"), F.lit("ai"))) | (exact & key.endswith("ai") & (host_core != c("first"))))),
        pair("aiBrandComPreferred", 35, c("is_ai") & (host_core == c("first")) & c("host").endswith(".com")),
        pair("brandSuffixNoise", -50, F.coalesce(glue, F.lit(False))),
        pair("tokenCoverage", half_up(c("token_coverage") * 40), F.lit(True)), pair("incompleteEntityName", -40, (F.size("wanted") >= 2) & (c("token_coverage") < 0.6)),
        pair("missingDistinctiveTokens", -50, (F.size("distinctive") > 0) & (c("distinct_hits") == 0)),
        pair("distinctiveTokenHits", half_up(_ratio(c("distinct_hits"), F.size("distinctive")) * 35), (F.size("distinctive") > 0) & (c("distinct_hits") > 0)),
        pair("genericBrandOnlyDomain", -45, (F.size(tokens) >= 2) & (c("hits") <= 1) & c("first").isin(*T.COMMON_BRANDS) & (host_core == c("first")) & ~c("is_ai")),
        pair("candidateNameExact", 28, (c("label") != "") & (T.identity_key(c("label")) == key)),
        pair("candidateNameOverlap", 18, (c("label") != "") & (T.identity_key(c("label")) != key) & (F.size(tokens) > 0) & (overlap / F.size(tokens) >= 0.7)),
        pair("jsonLdMatch", 30, (c("ld") != "") & ((T.identity_key(c("ld")) == key) | (ld_overlap >= F.greatest(F.lit(1), F.size(tokens) - 1)))),
        pair("titleMentionsCompany", 18, (c("t") != "") & (F.contains(tl, plain) | (T.identity_key(c("t")) == key))), pair("titleOfficial", 12, has(c("t"), r"\bofficial (website|site)\b")),
        pair("aboutLanguage", 22, (c("d") != "") & about), pair("metaMentionsCompany", 8, (c("d") != "") & ~about & F.contains(dl, plain)),
        pair("snippetOfficialWebsite", 20, has(sl, r"\bofficial website\b") & F.contains(sl, plain)), pair("snippetMentionsCompany", 8, (sl != "") & ~has(sl, r"\bofficial website\b") & F.contains(sl, plain)),
        pair("homepageHeadMention", 12, (c("body") != "") & F.contains(hl, plain)),
        pair("copyrightMatch", 15, (c_line != "") & (F.contains(T.identity_key(c_line), F.substring("key", 1, 8)) | F.exists(tokens, lambda w: (F.length(w) > 3) & F.contains(F.lower(c_line), w)))),
        *affiliate_signals(c("host"), c("t"), c("d"), c("body")),
        pair("tldCom", 8, two == "com"), pair("tldAltOk", 4, two.isin("ai", "io", "co", "capital", "vc") | c("host").rlike(r"\.(ai|io)$")),
        pair("tldShop", -70, two.isin("shop", "store")), pair("tldObscureCc", -35, two.isin("cz", "ru", "cn", "tk", "ml", "ga", "cf", "gq", "pw", "cc", "biz", "info")),
        pair("tldUncommon", -12, ~two.isin("com", "ai", "io", "co", "capital", "vc", "shop", "store", "cz", "ru", "cn", "tk", "ml", "ga", "cf", "gq", "pw", "cc", "biz", "info",
                                           "net", "org", "edu", "gov", "us", "uk", "de", "fr", "so", "app", "dev") & ~c("host").rlike(r"\.(ai|io)$")),
        pair("entityTypeMatch", 35, wants & (c("entity_type") == "investment_firm")), pair("entityTypeMismatch", -55, wants & c("entity_type").isin("print_services", "store", "product")),
        pair("entityTypeStorePenalty", -40, ~wants & (c("entity_type") == "store") & ~has(text("company"), r"\b(shop|store|retail)\b")),
        pair("sourceInfobox", 25, c("src") == "infobox"), pair("sourceAutocomplete", 18, c("src") == "autocomplete"), pair("sourceGuess", 1, c("src") == "brand_guess"),
        pair("multiSourceConsensus", 20, c("agree") >= 2), pair("strongConsensus", 25, c("agree") >= 3),
        pair("investTokenTldBoost", 25, c("invest_name") & as_tld & c("invest_text"))]
    df = df.withColumn("pairs", F.array_compact(F.array(*first_pass)))
    named = lambda *names: F.exists("pairs", lambda s: s["signal"].isin(*names))
    df = df.withColumns({"official": c("src").isin("wikidata_official", "wikidata_official_expanded") | F.coalesce(c("wikidata_official"), F.lit(False)),
                         "property": named("property_subdomain", "non_apex_host", "tldShop", "commerce_tld"), "sure": named("domainExactKey") & named("aboutLanguage")})
    df = df.withColumn("authoritative", (c("official") & ~c("property")).cast("int") + (c("src") == "infobox").cast("int") + (c("agree") >= 2).cast("int") + (c("agree") >= 3).cast("int"))
    late = F.array_compact(F.array(pair("wikidataOfficial", 45, c("official") & ~c("property")), pair("wikidataPropertySite", 5, c("official") & c("property")),
                                   pair("ambiguityRiskPenalty", -half_up(c("risk") / 4), (c("risk") >= 40) & (c("authoritative") == 0) & ~c("sure"))))
    df = df.withColumn("pairs", F.concat("pairs", late))
    valid = F.contains("host", F.lit("."))
    return df.select(*candidates.columns, "host", "host_core", "token_coverage", F.when(valid, c("authoritative")).otherwise(0).alias("authoritative"), "entity_type", "risk",
                     F.when(valid, total(c("pairs"))).otherwise(0).alias("score"),
                     F.when(valid, as_map(c("pairs"))).otherwise(F.create_map(F.lit("invalid"), F.lit(0))).alias("signals"))


def name_closeness(company: Column, domain: Column, name: Column) -> Column:
    """struct(score, kind): the first of twelve ways in which a host or name is close to a company's."""
    forms = T.decisive_forms(company)
    host = F.regexp_replace(F.lower(text(domain)), r"^www\.", "")
    base, entity = D.domain_base(domain), T.store_key(F.regexp_replace(text(name), "(?i)" + T.DECISIVE_FORMS, " "))

    def of(x: Column) -> Column:
        f, b, e, h = x["forms"], x["base"], x["entity"], x["host"]
        key, tokens = f["key"], f["tokens"]
        content = F.filter(tokens, lambda w: (F.length(w) > 3) & ~w.isin(*T.GENERIC_ORG_WORDS))
        blob = F.regexp_replace(h, "[^a-z0-9]", "")
        share = let(content, lambda w: _ratio(F.size(F.filter(w, lambda t: F.contains(blob, t) | F.contains(e, t))), F.size(w)))
        steps = (("exact-domain", 100, b == key), ("exact-name", 95, e == key), ("alias-domain", 92, F.array_contains(f["alias_keys"], b)), ("brand-core", 90, b == f["core_key"]),
                 ("acronym-domain", 88, (F.length(f["acronym"]) >= 3) & (b == f["acronym"])), ("brand-prefix", 82, f["core_key"].startswith(b) & (F.length(b) >= 5)),
                 ("brand-token", 80, (F.size(tokens) > 1) & (F.length(b) >= 3) & (b == F.get(tokens, F.lit(0))) & ~b.isin(*T.GENERIC_ORG_WORDS)),
                 ("name-prefix", 78, key.startswith(b) & (F.length(b) >= 6)),
                 ("name-overlap", 70, (e != "") & (e.startswith(key) | key.startswith(e)) & (F.least(F.length(e), F.length(key)) >= 6)),
                 ("all-tokens", 66, share >= 1), ("some-tokens", 40, share >= 0.5), ("weak-tokens", 25, share > 0))
        out = F.struct(F.lit(0).alias("score"), F.lit("none").alias("kind"))
        for kind, score, when in reversed(steps):
            guard = (b != "") if score in (100, 92, 90, 88, 82, 80, 78) else (e != "") if score == 95 else F.lit(True)
            out = F.when(guard & F.coalesce(when, F.lit(False)), F.struct(F.lit(score).alias("score"), F.lit(kind).alias("kind"))).otherwise(out)
        return F.when(key == "", F.struct(F.lit(0).alias("score"), F.lit("none").alias("kind"))).otherwise(out)

    return let(F.struct(forms.alias("forms"), base.alias("base"), entity.alias("entity"), host.alias("host")), of)


def closeness_tier(score: Column) -> Column:
    return F.when(score >= 92, 3).when(score >= 78, 2).when(score >= 40, 1).otherwise(0)


def is_junk_candidate(domain: Column, closeness: Column, dns_ok: Column, content_mention: Column) -> Column:
    """Directories, parked and free hosts, dead ones, and pages that don't name the company; a candidate of the closest tier is never junk."""
    host = F.regexp_replace(F.lower(text(domain)), r"^www\.", "")

    def of(h: Column) -> Column:
        parts = D.labels(h)
        last = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
        free = F.exists(F.array(*map(F.lit, FREE_HOSTS)), lambda s: (h == s) | h.endswith(F.concat(F.lit("."), s)))
        bad = h.isin(*AGGREGATORS) | last.isin(*AGGREGATORS, *PARKED) | free | dns_ok.eqNullSafe(False) | (content_mention.eqNullSafe(False) & (closeness < 60))
        return (h == "") | ((closeness_tier(closeness) < 3) & bad)

    return let(host, of)


def name_domain_similarity(company: Column, domain: Column, name: Column) -> Column:
    """struct(score 0 to 50, exact_name) of the pool ranking."""
    raw = F.lower(trim(text(company)))
    tokens = F.filter(F.transform(words(raw), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: (w != "") & ~w.isin("of", "the", "and", "a", "an", "for", "in", "on", "at", "to"))
    packed = F.struct(raw.alias("raw"), T.store_key(company).alias("q"), F.lower(text(name)).alias("name"), T.store_key(name).alias("n"), F.lower(text(domain)).alias("host"),
                      T.store_key(F.element_at(D.labels(F.lower(text(domain))), 1)).alias("b"), tokens.alias("tokens"))

    def of(x: Column) -> Column:
        q, n, b, host, raw_ = x["q"], x["n"], x["b"], x["host"], x["raw"]
        acronym = F.when(F.size(x["tokens"]) >= 2, F.array_join(F.transform(x["tokens"], lambda w: F.substring(w, 1, 1)), "")).otherwise("")
        content = F.filter(x["tokens"], lambda w: F.length(w) > 2)

        def scored(y: Column) -> Column:
            a, words_ = y["a"], y["content"]
            same, short = (x["name"] == raw_) | (n == q), (a != "") & ((n == a) | (x["name"] == a))
            by_name = (F.when(same, 40).when(short, 38).when(F.contains(n, q) | F.contains(q, n), 22)
                       .otherwise(F.least(F.lit(18), F.size(F.filter(words_, lambda w: F.contains(x["name"], w) | F.contains(b, w))) * 6)))
            by_host = (F.when((b == q) | ((a != "") & (b == a)), 35).when((F.length(q) >= 4) & (b.startswith(q) | q.startswith(b)), 18)
                       .when((F.length(q) >= 4) & (F.contains(b, q) | F.contains(q, b)), 10).when((F.length(a) >= 2) & (F.contains(b, a) | F.contains(a, b)), 20).otherwise(0))
            foreign = ((same | short) & (F.size(words_) >= 2) & ~F.exists(words_, lambda w: F.contains(b, w) | F.contains(host, w)) & ~((F.length(a) >= 2) & F.contains(b, a)) & (b != q))
            us, abroad = host.rlike(r"\.gov$"), host.rlike(r"\.gov\.[a-z]{2}$")
            by_tld = F.when(us, 10).when(D.tld(host).isin("com", "org", "edu", "gov", "net", "io", "co", "us", "uk", "ai"), 4).otherwise(-8)
            by_gov = F.when(abroad & ~has(raw_, r"\b(philippines|ghana|thailand|zimbabwe)\b"), -18).otherwise(0)
            core = F.when(foreign, F.least(by_name + by_host, F.lit(6))).otherwise(by_name + by_host)
            return F.struct(F.greatest(F.lit(0), F.least(F.lit(50), core + by_tld + by_gov)).alias("score"), ((same | short) & ~foreign).alias("exact_name"))

        return let(F.struct(acronym.alias("a"), content.alias("content")), scored)

    return let(packed, of)
