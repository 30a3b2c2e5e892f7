"""First-generation names and scores, encyclopedia matches, and ordered guesses from free text. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import extract as X
from . import fields as L
from . import html as H
from .domains import host_of
from .regex import cut, distinct_nocase, every, first, has, let, rx, squeeze, sub, text, trim, words
from .text import UNKNOWN, is_blank, name_core, store_key

# --- fixed values -----------------------------------------------------------------------------------------------
PLAIN_FORMS = r"[,.]?\s*\b(inc|llc|co|corp|corporation|ltd|limited|gmbh|sa|plc|pvt)\b\.?"
PICKER_FORMS = (r"[,.]?\s*\b(inc|llc|co|corp|corporation|ltd|limited|gmbh|sa|as|ab|oy|bv|nv|pvt|plc|holdings|group|associates|global|international|advisors|management|consulting|services|solutions|systems|"
                r"technologies|networks|labs|digital|media|design|creative|agency|studio|studios|collective|cooperative|coop|ventures|ventures\s+capital|capital|partners)\b")
PLAIN_TLDS = ("com", "co", "io", "net", "org", "edu", "gov", "ai", "me", "us", "ca", "uk", "so", "app", "dev")
AMBIGUOUS = ("unity", "oracle", "pulse", "apex", "summit", "vertex", "nova", "atlas", "pioneer", "horizon", "beacon", "spark", "forge", "harbor", "bridge", "delta", "alpha", "prime")
WEIGHTS = {"industry": 2.0, "location": 1.5, "founded": 1.0}
REJECT_WEIGHT = 3.0
FAMILIES = ("software|saas|technology|internet|computer|electronics|semiconductor|gpu", "venture|capital|private.?equity|investment|asset management", "health|bio|pharma|medical|therapeutics",
            "energy|oil|gas|renewable|climate", "bank|fintech|payment|financial")
GUESSES = (("private equity|buyout|alternative asset", "Private Equity"), (r"venture capital|\bvc\b|seed fund", "Venture Capital"), (r"asset management|investment management|investments\b", "Investment Management"),
           ("investment bank|capital markets", "Investment Banking"), ("fintech|payments|banking", "Financial Services"), ("biotech|therapeutics|life sciences", "Biotechnology"),
           ("robotics|aerospace|hardware", "Hardware / Robotics"), ("software|saas|platform|api", "Software"), ("university|college|education", "Education"), ("foundation|nonprofit|church", "Nonprofit / Foundation"))
INFERRED = (("venture capital|growth equity|seed fund|early-stage", "Venture Capital"), ("investment bank|advisory firm|mergers and acquisitions", "Investment Banking"), ("payments?|fintech|financial infrastructure", "Financial Technology"),
            ("artificial intelligence|machine learning|language model", "Artificial Intelligence"), ("higher education|university|ivy league", "Higher Education"), ("e-?commerce|online retail", "E-Commerce / Retail"),
            ("saas|software|productivity|workspace", "Software / SaaS"), ("healthcare|biotech|therapeutics|clinical", "Healthcare / Biotech"), ("legal services|law firm|attorneys?", "Legal Services"),
            ("marketing agency|creative studio|brand campaigns", "Marketing & Creative"))
PAGE_INDUSTRIES = (("venture capital|growth equity|private equity|seed (?:and|&) early-stage", "Venture Capital"), ("fund administration|fund administrator", "Fund Administration"),
                   ("outsourced chief investment|OCIO", "OCIO / Investment Management"), ("asset management|investment management|investment firm", "Investment Management"),
                   ("fintech|payments? infrastructure|financial technology", "Financial Technology"), ("artificial intelligence|machine learning|language model", "Artificial Intelligence"),
                   ("higher education|research university|ivy league", "Higher Education"), (r"software as a service|\bSaaS\b|productivity software", "Software / SaaS"), ("e-?commerce|online retail", "E-Commerce / Retail"),
                   ("healthcare|biotech|therapeutics|clinical", "Healthcare / Biotech"), ("legal services|law firm", "Legal Services"))
PAGE_PLACE = r"\b(?:based in|headquartered in|headquarters(?:\s+in)?|located in)\s+([A-Z][a-zA-Z .'-]+(?:,\s*[A-Z]{2})?)"
PAGE_PAIR = r"\b([A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)?),\s*([A-Z]{2})\b(?:\s+\d{5})?"
#: Not from within a number: what matches there matches from its beginning, and each part of a long list of numbers would be read to the list's end.
PAGE_STAFF = r"\b(?!\d{3}(?<=\b\d{1,3},\d{3}))(\d{1,3}(?:,\d{3})*\+?\s*[-\x{2013}to]+\s*\d{1,3}(?:,\d{3})*\+?|\d{1,3}(?:,\d{3})*\+)\s*(?:employees|people|team members|professionals)\b"
CONTEXTS = ((r"private equity|\bpe\b|buyout", "investment_firm|private_equity"), (r"venture capital|\bvc\b|seed fund", "investment_firm|venture"), ("fintech|payments|neobank", "company|fintech"),
            ("software|saas|enterprise", "company"), ("biotech|biotechnology|pharma", "company"), ("consumer|retail|apparel", "company|store|retail"))
# ----------------------------------------------------------------------------------------------------------------


def plain_name(c: Column) -> Column:
    return trim(sub(sub(sub(F.lower(trim(text(c))), PLAIN_FORMS, ""), r"^the\s+", ""), r"\s+", " "))


def plain_key(c: Column) -> Column:
    return F.regexp_replace(plain_name(c), "[^a-z0-9]", "")


def picker_query(c: Column) -> Column:
    """A name without general words, for a search."""
    return squeeze(sub(sub(sub(F.lower(trim(text(c))), PICKER_FORMS, ""), r"^the\s+", ""), r"\bcompany\b$", ""))


def pretty_key(c: Column) -> Column:
    """Lower-case words of up to three letters in capitals, others with a capital first letter."""
    raised = lambda w: F.when((F.length(w) <= 3) & (w == F.lower(w)), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(F.transform(F.split(text(c), " "), raised), " ")


def is_placeholder(c: Column) -> Column:
    return has(trim(text(c)), "^$|^-$|^unknown$")


def is_non_entity(c: Column) -> Column:
    return has(text(c), r"\(\s*moderator\s*\)") | has(trim(text(c)), "^private fund$")


def is_ambiguous_name(c: Column) -> Column:
    """Short names, single short words and common ones."""
    return let(plain_name(c), lambda n: (F.length(F.regexp_replace(n, "[^a-z0-9]", "")) <= 3) | n.isin(*AMBIGUOUS) | ((F.size(words(n)) == 1) & (F.length(n) <= 6)))


def plain_base(c: Column) -> Column:
    """The label that names a host's owner, at best effort."""

    def body(parts: Column) -> Column:
        inner = F.try_element_at(parts, F.lit(-2))
        return F.regexp_replace(F.when((F.size(parts) > 2) & ~inner.isin(*PLAIN_TLDS), inner).otherwise(F.element_at(parts, 1)), "[^a-z0-9]", "")

    return let(F.split(host_of(c), r"\."), body)


def domain_score(domain: Column, company: Column, suggestion: Column) -> Column:
    """The first generation's score of a host for a name and a suggested name."""
    packed = F.struct(plain_key(company).alias("q"), plain_base(domain).alias("b"), plain_key(suggestion).alias("s"), F.element_at(F.split(host_of(domain), r"\."), -1).alias("t"),
                      F.filter(words(plain_name(company)), lambda w: F.length(w) > 2).alias("w"))

    def body(x: Column) -> Column:
        q, b, s = x["q"], x["b"], x["s"]
        found = F.size(F.filter(x["w"], lambda w: F.contains(b, F.regexp_replace(w, "[^a-z0-9]", ""))))
        suggested = (s != "") & (F.contains(s, q) | F.contains(q, s))
        core = (F.when(b == q, 100).when(F.contains(q, b) | F.contains(b, q), 50 - F.least(F.lit(30), F.abs(F.length(b) - F.length(q)) * 2)).when(suggested, 40)
                .when((found > 0) & (found == F.size(x["w"])), 70).when(found > 0, 25))
        extra = F.when(x["t"].isin(*PLAIN_TLDS), 15).otherwise(-40) + F.when((s != "") & (s == q), 30).when(suggested, 15).otherwise(0)
        return F.when((q == "") | (b == "") | core.isNull(), 0).otherwise(core + extra)

    return let(packed, body)


def domain_for_name(company: Column, domain: Column) -> Column:
    """The evaluation's simpler score."""
    host = F.replace(F.regexp_replace(host_of(domain), r"\.[a-z]{2,}$", ""), F.lit("."), F.lit(""))
    tokens = F.filter(F.transform(words(F.lower(text(company))), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: (F.length(w) > 2) & ~w.rlike("^(the|and|global|management|capital|ventures|company)$"))
    packed = F.struct(host.alias("h"), store_key(company).alias("k"), tokens.alias("w"), host_of(domain).alias("d"))

    def body(x: Column) -> Column:
        h, k = x["h"], x["k"]
        points = (F.when(h == k, 100).otherwise(0) + F.when(F.contains(h, k) | F.contains(k, h), 60).otherwise(0) + F.size(F.filter(x["w"], lambda w: F.contains(h, w))) * 20
                  + F.when(x["d"].rlike(r"news|aircraft|msn|hci\.org|wikipedia"), -80).otherwise(0))
        return F.when((h == "") | (k == ""), 0).otherwise(points)

    return let(packed, body)


def prominence(title: Column, description: Column, has_site: Column, has_employees: Column) -> Column:
    """A light measure of an encyclopedia entity's weight."""
    return (F.when(has(text(description), r"\b(company|firm|organization|foundation|bank|agency|government|university)\b"), 20).otherwise(0) + F.when(has_site, 25).otherwise(0)
            + F.when(has_employees, 15).otherwise(0) + F.when(F.length(store_key(title)) > 4, 10).otherwise(0))


def wiki_title_score(title: Column, company: Column) -> Column:
    """How well an encyclopedia's title fits a name; -100 for works and disambiguation pages."""
    name = squeeze(sub(F.regexp_replace(F.lower(text(company)), "[.,]", " "), r"\b(inc|llc|corp|corporation|ltd|co|plc|pbc|group)\b", " "))
    packed = F.struct(F.lower(text(title)).alias("t"), squeeze(sub(F.lower(text(title)), r"\s*\(.*?\)\s*", " ")).alias("core"), name.alias("n"))

    def body(x: Column) -> Column:
        t, core, n = x["t"], x["core"], x["n"]
        tokens = F.filter(F.split(n, " "), lambda w: F.length(w) > 2)
        points = (F.when(core == n, 50).otherwise(0) + F.when((t == n) | t.startswith(F.concat(n, F.lit(" "))) | t.startswith(F.concat(n, F.lit(","))), 25).otherwise(0)
                  + F.when(t.rlike(r"\((?:company|firm|business|bank|organization|organisation)\)"), 20).otherwise(0) + F.when((F.length(n) >= 4) & (F.contains(t, n) | F.contains(core, n)), 15).otherwise(0)
                  + F.when((F.size(tokens) >= 2) & F.forall(tokens, lambda w: F.contains(t, w)), 12).otherwise(0))
        return F.when((t == "") | (F.length(n) < 2), 0).when(has(t, r"\(disambiguation\)|\balbum\b|\bfilm\b|\bsong\b|\btv series\b|\blist of\b"), -100).otherwise(points)

    return let(packed, body)


def name_match_kind(title: Column, company: Column, aliases: Column) -> Column:
    """exact, near-exact, weak or none."""
    cores = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), name_core)
    packed = F.struct(name_core(title).alias("t"), name_core(company).alias("n"), wiki_title_score(title, company).alias("s"), text(title).alias("raw"), cores.alias("a"))

    def body(x: Column) -> Column:
        t, n, s = x["t"], x["n"], x["s"]
        near = t.startswith(F.concat(n, F.lit(" "))) | n.startswith(F.concat(t, F.lit(" "))) | (s >= 50) | has(x["raw"], r"\((?:company|firm|business|bank|organization|organisation)\)")
        return F.when((t == "") | (n == "") | (s < 0), "none").when((t == n) | F.array_contains(x["a"], t), "exact").when(near, "near-exact").when(s >= 25, "weak").otherwise("none")

    return let(packed, body)


def industries_compatible(a: Column, b: Column) -> Column:
    """Missing ones are compatible with all; else the same label, a common longer word, or one family."""
    tokens = lambda c: F.filter(F.split(F.lower(text(c)), "[^a-z0-9]+"), lambda w: F.length(w) > 3)
    family = F.lit(False)
    for pattern in FAMILIES:
        family = family | (text(a).rlike(pattern) & text(b).rlike(pattern))
    return is_blank(a) | (text(b) == "") | (L.industry(a) == L.industry(b)) | F.arrays_overlap(tokens(a), tokens(b)) | family


def locations_compatible(a: Column, b: Column) -> Column:
    tokens = lambda c: F.filter(F.split(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) > 2) & ~w.isin("the", "and", "united", "states", "usa", "city"))
    near = let(F.struct(F.lower(L.location(a)).alias("a"), F.lower(L.location(b)).alias("b")), lambda p: F.contains(p["a"], p["b"]) | F.contains(p["b"], p["a"]))
    return is_blank(a) | (text(b) == "") | near | F.arrays_overlap(tokens(a), tokens(b))


def mismatch_weight(mismatches: Column) -> Column:
    return F.aggregate(mismatches, F.lit(0.0), lambda total, m: total + F.coalesce(L.lookup(m, {k: str(v) for k, v in WEIGHTS.items()}).cast("double"), F.lit(0.0)))


def judge_wiki_page(title: Column, company: Column, aliases: Column, industry: Column, infobox_industry: Column, place: Column, infobox_place: Column, year: Column, infobox_year: Column) -> Column:
    """struct(ok, kind, score, mismatches, weight): whether an encyclopedia page is about the company; its name must match exactly or nearly so, and what differs must weigh under three."""
    found = F.array_compact(F.array(F.when(~industries_compatible(industry, infobox_industry), "industry"), F.when(F.coalesce(year != infobox_year, F.lit(False)), "founded"),
                                    F.when(~locations_compatible(place, infobox_place), "location")))
    packed = F.struct(name_match_kind(title, company, aliases).alias("kind"), wiki_title_score(title, company).alias("score"), found.alias("mismatches"), mismatch_weight(found).alias("weight"))

    def body(x: Column) -> Column:
        named = x["kind"].isin("exact", "near-exact")
        ok = named & (x["weight"] < REJECT_WEIGHT)
        return F.struct(ok.alias("ok"), x["kind"].alias("kind"), F.when(ok, x["score"] + F.greatest(F.lit(0.0), 20 - x["weight"] * 4)).otherwise(x["score"].cast("double")).alias("score"),
                        F.when(named, x["mismatches"]).otherwise(F.array(F.lit("name"))).alias("mismatches"), x["weight"].alias("weight"))

    return let(packed, body)


def _first_label(blob: Column, rules: tuple) -> Column:
    out = F.lit(UNKNOWN)
    for pattern, label in reversed(rules):
        out = F.when(has(blob, pattern), label).otherwise(out)
    return out


def guess_industry(name: Column, domain: Column, page: Column) -> Column:
    return F.coalesce(L.entity_industry(name, domain), _first_label(F.lower(F.concat_ws(" ", text(name), text(domain), text(page))), GUESSES))


def infer_industry(c: Column) -> Column:
    return _first_label(F.lower(text(c)), INFERRED)


def infer_location(c: Column) -> Column:
    """``City, ST`` anywhere, else one of the best-known cities with what follows it."""
    s, pair = text(c), r"\b([A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)?),\s*([A-Z]{2})\b"
    known = r"\b(San Francisco|New York|London|Paris|Berlin|Toronto|Austin|Seattle|Boston|Chicago|Los Angeles|Mountain View|Cupertino|Redmond|Menlo Park)\b[, ]+([A-Z]{2}|CA|NY|TX|WA|MA|IL|UK|France)?"
    city = first(s, known, 1)
    return (F.when(has(s, pair, False), F.concat_ws(", ", first(s, pair, 1, False), first(s, pair, 2, False)))
            .when(city != "", F.concat_ws(", ", city, F.nullif(first(s, known, 2), F.lit("")))).otherwise(UNKNOWN))


def founders_unknown_status(contacts: Column, errors: Column) -> Column:
    return F.when(~is_blank(contacts), None).when(F.size(F.coalesce(errors, F.array().cast("array<string>"))) > 0, "unknown_pipeline_error").otherwise("unknown_no_data")


def explicit_founders(c: Column) -> Column:
    """Names after ``founded by`` and before ``is a founder``, as a canonical list."""
    name = r"[A-Z][a-z]+(?:\s+[A-Z][a-z.'-]+)"
    by = every(text(c), rf"(?:[Ff]ounded by|[Cc]o-founded by)\s+({name}{{0,3}}(?:\s+(?:and|&|,)\s+{name}{{0,3}}){{0,4}})", 1, False)
    are = every(text(c), rf"({name}{{1,3}})\s+(?:is|was)\s+(?:a\s+|the\s+)?(?:co-)?founder\b", 1, False)
    return L.founders(F.array_join(F.concat(by, are), "; "))


def founder_bios(c: Column) -> Column:
    """Names with a founder's title beside them; executives' titles alone don't count."""
    pairs = every(text(c), r"[A-Z][a-z]+(?:\s+[A-Z][a-z.'-]+){1,3}\s*[,;:\x{2013}\x{2014}\-]\s*[^\n|]{2,80}", 0, False)
    titled = F.filter(pairs, lambda p: has(F.regexp_replace(p, rx(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z.'-]+){1,3}\s*[,;:\x{2013}\x{2014}\-]\s*", False), ""), r"\b(?:co-?founders?|founders?|founding\s+(?:partner|member))\b"))
    names = F.transform(titled, lambda p: first(p, r"^([A-Z][a-z]+(?:\s+[A-Z][a-z.'-]+){1,3})", 1, False))
    return L.founders(F.array_join(distinct_nocase(F.filter(names, lambda n: ~has(n, L.EXECUTIVE) & ~has(n, r"^(Our|The|Meet|Team|About|Leadership|Company|Board|Staff|People|Home|Contact)\b"))), "; "))


def full_name_present(company: Column, c: Column) -> Column:
    """Whether a text holds the whole name, with any marks between its words."""
    from .text import identity_name, identity_tokens

    flex = F.array_join(F.transform(identity_tokens(company), lambda w: w), r"[\s\-.,&]*")
    return let(F.struct(identity_name(company).alias("n"), flex.alias("f"), F.lower(text(c)).alias("b")),
               lambda x: (F.length(x["n"]) >= 3) & (F.contains(x["b"], x["n"]) | ((x["f"] != "") & F.regexp_like(x["b"], x["f"]))))


def context_aligns(context: Column, evidence: Column, kind: Column) -> Column:
    """Whether evidence or the kind of entity fits a given industry: one of six families, or half of its longer words."""
    ctx, blob = F.lower(text(context)), F.lower(text(evidence))
    family = F.lit(False)
    for pattern, kinds in CONTEXTS:
        family = family | (has(ctx, pattern) & (has(blob, pattern) | has(text(kind), kinds)))
    tokens = F.filter(words(ctx), lambda w: F.length(w) > 3)
    share = let(tokens, lambda t: (F.size(t) > 0) & (F.size(F.filter(t, lambda w: F.contains(blob, w))) * 2 >= F.size(t)))
    return (ctx != "") & (family | share)


def corpus_fields(c: Column) -> Column:
    """struct(location, headcount, founders, notes) from a search corpus: the first phrase of each kind; texts under 20 characters say nothing."""
    s = text(c)
    pair = r"\b(?:based in|headquartered in|headquarters in|HQ(?:\s+in)?)\s+([A-Z][a-zA-Z .'-]{1,40}?),\s*([A-Z]{2}|[A-Z][a-zA-Z][a-zA-Z .'-]{1,24})\b"
    place = F.when(has(s, pair, False), F.concat_ws(", ", trim(first(s, pair, 1, False)), trim(F.regexp_replace(first(s, pair, 2, False), r"\..*$", ""))))
    range_ = first(s, r"\b(?:(?:company size|employees?|team size|headcount)\s*[:=]?\s*)?(\d{1,3}(?:,\d{3})*\s*[–-]\s*\d{1,3}(?:,\d{3})*|\d{1,3}(?:,\d{3})*\+|more than\s+\d{1,3}(?:,\d{3})*)\s*(?:employees|people|team members)?\b")
    person = r"[A-Z][a-z]+(?:\s+[A-Z][a-z.'-]+){1,3}"
    by = first(s, rf"(?:(?:[Ff]ounded by|[Cc]o-founded by|[Ee]stablished by|[Ll]aunched by|[Ss]tarted by)\s+)({person}(?:\s+(?:and|&)\s+{person})?)", 1, False)
    sentence = first(s, r"([A-Z][^.]{40,180}\.)", 1, False)
    shown = F.when(has(sentence, r"wikipedia|duckduckgo|may refer to|disambiguation|launching soon|open menu|sign up to be"), "").otherwise(L.notes(sentence))
    out = F.struct(F.when(place.isNotNull(), L.location(place)).otherwise(UNKNOWN).alias("location"), F.when(range_ != "", L.headcount(range_)).otherwise(UNKNOWN).alias("headcount"),
                   L.founders(by).alias("founders"), shown.alias("notes"))
    none = F.struct(F.lit(UNKNOWN).alias("location"), F.lit(UNKNOWN).alias("headcount"), F.lit(UNKNOWN).alias("founders"), F.lit("").alias("notes"))
    return F.when(F.length(s) < 20, none).otherwise(out)


def page_fields(html: Column, company: Column) -> Column:
    """struct(industry, headcount, location, founders, notes, source) of a whole page: title, description, site name, the about part (all behind its mark), the footer and the body, in
    this order, each to its end; a page without any of the company's longer words says nothing. The note is a short description, else an excerpt of the about part."""
    s, none = text(html), F.lit(UNKNOWN)
    description = F.coalesce(F.nullif(H.meta(html, "description"), F.lit("")), H.meta(html, "og:description"))
    about = H.html_text(F.regexp_extract(s, r"""(?is)id=["']about["'].*|class=["'](?=[^"']*["'])[^"']*about.*""", 0))
    footer = H.html_text(F.regexp_extract(s, r"(?is)(<footer.*</footer>)|<footer", 1))  # one that is not closed is none, and looked for once

    def made(x: Column) -> Column:
        corpus = F.concat_ws(". ", H.title(html), x["description"], H.meta(html, "og:site_name"), x["about"], footer, H.html_text(html))
        return F.struct(corpus.alias("corpus"), x["description"].alias("description"), x["about"].alias("about"))

    def body(x: Column) -> Column:
        corpus = x["corpus"]
        near = trim(first(corpus, PAGE_PLACE, 1, False))
        pair = F.concat_ws(", ", first(corpus, PAGE_PAIR, 1, False), first(corpus, PAGE_PAIR, 2, False))
        place = F.when(F.length(near) > 3, near).when(F.length(pair) > 3, pair).otherwise(none)
        staff = squeeze(first(corpus, PAGE_STAFF))
        notes = F.when((F.length(x["description"]) > 20) & (F.length(x["description"]) < 280), x["description"]).when(F.length(x["about"]) > 40, trim(cut(x["about"], 180))).otherwise(none)
        tokens = F.filter(words(F.lower(text(company))), lambda t: F.length(t) > 2)
        low = F.lower(corpus)
        said = (F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(low, F.regexp_replace(t, "[^a-z0-9]", "")))
        shown = F.struct(_first_label(corpus, PAGE_INDUSTRIES).alias("industry"), F.when(staff != "", staff).otherwise(none).alias("headcount"), place.alias("location"), X.first_person(corpus, company).alias("founders"),
                         notes.alias("notes"), F.lit("scrape").alias("source"))
        silent = lambda source: F.struct(*[none.alias(n) for n in ("industry", "headcount", "location", "founders", "notes")], F.lit(source).alias("source"))
        return F.when(s == "", silent("none")).when(said, shown).otherwise(silent("scrape-unconfirmed"))

    return let(F.struct(description.alias("description"), about.alias("about")), lambda x: let(made(x), body))
