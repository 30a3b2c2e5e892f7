"""Canonical forms of the enriched fields: industry, location, headcount, founders, notes. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import cut, distinct_nocase, first, half_up, has, let, rx, squeeze, sub, text, trim, words
from .text import UNKNOWN, is_blank

# --- fixed values -----------------------------------------------------------------------------------------------
#: The first expression that an industry's text holds gives its label.
TAXONOMY = (
    (r"\b(semiconductor|chipmaker|chip design|invents the GPU|GPU (?:chip|company|maker)|foundry)\b", "Semiconductors"),
    (r"\b(cybersecurity|cyber security|information security)\b", "Cybersecurity"),
    (r"\b(enterprise software|b2b software|\bSaaS\b|productivity software|cloud software|developer tools)\b", "Enterprise Software"),
    (r"\b(fintech|financial technology|payments? infrastructure|neobank|corporate cards)\b", "Fintech"),
    (r"\b(biotech|biotechnology|therapeutics|genomics|gene sequencing)\b", "Biotechnology"),
    (r"\b(healthcare|health care|medical device|hospital system|clinical)\b", "Healthcare"),
    (r"\b(e-?commerce|online retail|direct[- ]to[- ]consumer|marketplace)\b", "E-Commerce"),
    (r"\b(consumer electronics|apparel|footwear|eyewear|consumer brand|consumer goods)\b", "Consumer"),
    (r"\b(streaming|media company|entertainment company|publishing)\b", "Media & Entertainment"),
    (r"\b(gaming|video game|game studio)\b", "Gaming"),
    (r"\b(renewable energy|clean energy|solar|wind power|climate tech)\b", "Renewable Energy"),
    (r"\b(oil\s*(?:&|and)\s*gas|petroleum|upstream energy)\b", "Oil & Gas"),
    (r"\b(electric utility|power generation|energy company)\b", "Energy"),
    (r"\b(aerospace|defense contractor|space systems|autonomous defense)\b", "Aerospace & Defense"),
    (r"\b(industrial|manufacturing|automation|robotics)\b", "Industrial Technology"),
    (r"\b(automotive|electric vehicle|\bEV\b|mobility)\b", "Automotive"),
    (r"\b(venture capital|\bVC firm\b|early[- ]stage (?:venture|investor)|seed (?:and|&) early)\b", "Venture Capital"),
    (r"\b(private equity|\bPE firm\b|buyout)\b", "Private Equity"),
    (r"\b(investment bank|investment banking|M&A advisory)\b", "Investment Banking"),
    (r"\b(asset management|investment management|wealth management)\b", "Asset Management"),
    (r"\b(hedge fund)\b", "Hedge Fund"),
    (r"\b(real estate|reit|property investment)\b", "Real Estate"),
    (r"\b(professional services|consulting|advisory firm)\b", "Professional Services"),
    (r"\b(higher education|research university|\buniversity\b|\bcollege\b)\b", "Education"),
    (r"\b(government|public agency|municipal|federal agency)\b", "Government"),
    (r"\b(nonprofit|non-profit|foundation|charity)\b", "Nonprofit / Foundation"),
    (r"\b(legal services|law firm)\b", "Legal Services"),
    (r"\b(banking|commercial bank|retail bank)\b", "Banking"),
    (r"\b(artificial intelligence (?:company|lab|research)|AI (?:company|lab|research|safety)|generative AI (?:company|lab))\b", "Artificial Intelligence"),
    (r"\b(technology company|software company)\b", "Technology"),
)
INDUSTRY_ALIASES = {"vc": "Venture Capital", "v.c.": "Venture Capital", "pe": "Private Equity", "saas": "Enterprise Software", "software / saas": "Enterprise Software",
                    "software & cloud": "Enterprise Software", "financial technology": "Fintech", "healthcare / biotech": "Healthcare", "e-commerce / retail": "E-Commerce",
                    "media / entertainment": "Media & Entertainment", "aerospace": "Aerospace & Defense", "climate tech vc": "Venture Capital", "deep tech vc": "Venture Capital"}
CITY_ALIASES = {"nyc": "New York, NY", "new york city": "New York, NY", "new york": "New York, NY", "sf": "San Francisco, CA", "san fran": "San Francisco, CA",
                "san francisco": "San Francisco, CA", "la": "Los Angeles, CA", "los angeles": "Los Angeles, CA", "silicon valley": "Palo Alto, CA", "brooklyn": "Brooklyn, NY",
                "palo alto": "Palo Alto, CA", "menlo park": "Menlo Park, CA", "sao paulo": "São Paulo, Brazil", "são paulo": "São Paulo, Brazil"}
#: Upper ends and labels; the dash is U+2013.
HEADCOUNT_BUCKETS = ((10, "1–10"), (50, "11–50"), (200, "51–200"), (500, "201–500"), (1000, "501–1,000"), (5000, "1,001–5,000"), (10000, "5,001–10,000"), (None, "10,001+"))
US_STATES = {"alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL",
             "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
             "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
             "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
             "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
             "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC"}
SUBNATIONAL = ("aichi", "osaka", "hokkaido", "kanagawa", "california", "texas", "washington", "massachusetts", "new york", "florida", "illinois", "bavaria", "england", "scotland",
               "wales", "ontario", "quebec")
SOLO_CITIES = ("new york", "san francisco", "london", "tokyo", "singapore", "paris", "berlin", "stockholm", "munich", "cupertino", "redmond", "seattle", "boston", "chicago")
PIPELINE_NOTES = (r"Verifying selected domain\.?\.?\.?|Queueing\.?\.?\.?|Re-running enrichment\.?\.?\.?|Enriching confirmed|Select the correct website|Pick a candidate|Select or enter a domain"
                  r"|Ambiguous matches|Candidates:|Possible matches|Could not verify|Could not fetch|Could not resolve|Domain does not resolve|Page content does not match|AI search error|Score \d+"
                  r"|confirm required|Low confidence|Auto-selected \([^)]+\)|scrape failed|SPARQL|DNS|HTTP \d{3}|retry|timeout|allorigins|corsproxy|codetabs|enrichSource|confidenceScore|resolveMethod|major firm")
FOUNDER_TITLES_PAREN = r"\s*\((?:Founder|Co-Founder|CEO|CTO|CFO|Partner|Managing Partner|MD)[^)]*\)"
FOUNDER_TITLES = r",?\s*(?:Founder|Co-Founder|CEO|Chief Executive Officer|Managing Partner|Managing Director|General Partner|Chairman|President)\b"
EXECUTIVE = r"\b(CEO|Chief Executive|President|Chairman|Chairwoman|Managing Partner|General Partner|Managing Director|Partner|CTO|CFO|COO|Chief Technology|Chief Financial)\b"
GENDER_IDS = {"Q6581097": "male", "Q6581072": "female"}
# ----------------------------------------------------------------------------------------------------------------


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def title_words(c: Column) -> Column:
    """The first letter of every ASCII word in upper case; the rest stays."""
    parts = F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    raised = lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(w)
    return F.array_join(F.transform(parts, raised), "")


def industry(raw: Column) -> Column:

    def body(s: Column) -> Column:
        label = F.lit(None).cast("string")
        for pattern, name in reversed(TAXONOMY):
            label = F.when(has(s, pattern), name).otherwise(label)
        shown = F.when(F.length(s) <= 40, F.regexp_replace(title_words(s), rx(r"\bVc\b", False), "VC")).otherwise(cut(s, 60))
        return F.when(is_blank(s), UNKNOWN).otherwise(F.coalesce(label, lookup(F.lower(s), INDUSTRY_ALIASES), shown))

    return let(squeeze(text(raw)), body)


def location(raw: Column) -> Column:

    def body(s: Column) -> Column:
        bare = s
        for ending, to in ((r",\s*United States of America$", ""), (r",\s*United States$", ""), (r",\s*USA$", ""), (r",\s*US$", ""), (r",\s*United Kingdom$", ", UK")):
            bare = sub(bare, ending, to)
        return F.when(is_blank(s), UNKNOWN).otherwise(F.coalesce(lookup(F.lower(s), CITY_ALIASES), cut(bare, 55)))

    return let(squeeze(text(raw)), body)


def headcount_bucket(n: Column) -> Column:

    def body(v: Column) -> Column:
        out = F.lit(HEADCOUNT_BUCKETS[-1][1])
        for top, label in reversed(HEADCOUNT_BUCKETS[:-1]):
            out = F.when(v <= top, label).otherwise(out)
        return F.when(v.isNotNull(), out)

    return let(n, body)


def _number(c: Column) -> Column:
    return F.regexp_replace(c, "[,+]", "").try_cast("double")


def headcount(raw: Column) -> Column:
    """One of eight buckets, or the text itself where it holds no number.

    ``more than N`` counts as N + 1, ``N+`` as N, a range as its rounded middle.
    """

    def body(s: Column) -> Column:
        more = F.regexp_extract(s, r"(?i)(?:more than|over)\s*([\d,]+)", 1)
        plus = F.regexp_extract(s, r"([\d,]+)\+", 1)
        open_ended = F.when(more != "", _number(more) + 1).when(plus != "", _number(plus))
        span = r"(\d{1,3}(?:,\d{3})*|\d{1,9})\s*[–-]\s*(\d{1,3}(?:,\d{3})*|\d{1,9})"
        alone = "^" + span + r"\+?$"
        middles = [half_up((_number(first(s, p, 1)) + _number(first(s, p, 2))) / 2) for p in (alone, span)]
        whole = _number(first(s, r"^(\d{1,3}(?:,\d{3})+|\d{1,9})\+?$"))
        found = headcount_bucket(F.coalesce(open_ended, middles[0], whole, middles[1]))
        return F.when(is_blank(raw), UNKNOWN).otherwise(F.coalesce(found, cut(s, 40)))

    return let(sub(F.regexp_replace(squeeze(text(raw)), "-", "–"), r"\bto\b", "–"), body)


def founders(raw: Column) -> Column:
    """Names of two words or more, without titles, distinct, joined by semicolons."""
    s = sub(sub(trim(text(raw)), FOUNDER_TITLES_PAREN, ""), FOUNDER_TITLES, "")
    s = sub(sub(s, r"\s+and\s+", "; "), r"\s*,\s*", "; ")
    names = F.filter(F.transform(F.split(s, ";"), trim), lambda n: (n != "") & (F.size(words(n)) >= 2) & (F.length(n) < 60) & ~has(n, r"^(the|our|team|company)\b"))
    return let(F.array_join(let(names, distinct_nocase), "; "), lambda joined: F.when(
        has(trim(text(raw)), "^not_applicable$"), "not_applicable").when(is_blank(raw) | (joined == ""), UNKNOWN).otherwise(joined))


def notes(raw: Column) -> Column:
    """A note without the parts that only report on the pipeline; empty if nothing is left."""
    s = sub(trim(text(raw)), PIPELINE_NOTES, " ")
    parts = F.filter(F.transform(F.split(s, rx(r"\s*[·|]\s*")), trim), lambda p: (
        (p != "") & ~has(p, r"^(verifying|queueing|searching|enriching|pending)") & ~(has(p, r"score\s*\d+") & (F.length(p) < 40))
        & ~has(p, r"verifying selected domain|sparql|confidence\s*0\.\d+") & ~has(p, r"may refer to|disambiguation|launching soon|open menu")))
    out = trim(sub(sub(F.array_join(parts, " · "), r"\s{2,}", " "), r"^[\s·]+|[\s·]+$", ""))
    return let(out, lambda n: F.when(trim(text(raw)).isin("", "-") | is_blank(n), "").otherwise(cut(n, 320)))


def finalize(industry_: Column, location_: Column, headcount_: Column, founders_: Column, notes_: Column) -> list[Column]:
    """The five fields in canonical form."""
    return [industry(industry_).alias("industry"), location(location_).alias("location"), headcount(headcount_).alias("headcount"),
            founders(founders_).alias("founders"), notes(notes_).alias("notes")]


def hq(raw: Column) -> Column:
    """``City, ST`` or ``City, Country`` from a phrase, else null: a place that can't be told apart is none."""
    s = squeeze(text(raw))
    for pattern in (r"^(?:our\s+)?(?:global\s+|corporate\s+|world\s+)?headquarters(?:\s+are|\s+is)?(?:\s+located)?(?:\s+in)?\s+", r"^(?:is\s+)?(?:based|headquartered)\s+in\s+",
                    r"^of\s+", r"\s+and\s+(?:has|have)\s+offices?\b.*$"):
        s = sub(s, pattern, "")
    s = trim(s)
    for ending, to in ((r",\s*United States of America$", ""), (r",\s*United States$", ""), (r",\s*USA$", ""), (r",\s*U\.S\.A\.?$", ""), (r",\s*US$", ""),
                       (r",\s*United Kingdom$", ", UK"), (r",\s*England$", ", UK"), (r"\.$", "")):
        s = sub(s, ending, to)
    word = r"[A-Za-z][A-Za-z .'-]+"
    triple, pair = rf"^({word}),\s*{word},\s*({word})$", rf"^({word}),\s*({word})$"
    two = let(s, lambda v: F.when(has(v, triple), F.concat_ws(", ", trim(first(v, triple, 1)), trim(first(v, triple, 2)))).otherwise(v))

    def of_pair(p: Column) -> Column:
        city, region = p["city"], p["region"]
        low, code = F.lower(region), lookup(F.lower(region), US_STATES)
        prose = has(city, r"^(of|in|the|our|located)\b")
        shown = F.when(region.rlike("^[A-Za-z]{4,}$"), F.concat(F.upper(F.substring(region, 1, 1)), F.lower(F.substr(region, F.lit(2))))).otherwise(region)
        state = F.when(F.upper(region).isin(*US_STATES.values()) & ~prose & (F.size(words(city)) <= 4), F.concat_ws(", ", city, F.upper(region)))
        country = (F.when(prose | ~F.length(region).between(2, 32), None).when(code.isNotNull(), F.concat_ws(", ", city, code))
                   .when(low.isin(*SUBNATIONAL), None).otherwise(F.concat_ws(", ", city, shown)))
        return F.when(F.length(region) == 2, state).otherwise(country)

    def body(v: Column) -> Column:
        bad = (is_blank(v) | has(v, r"\b(employees?|founded|venture|equity|software|platform|inc|llc|located in|headquarters|of microsoft|lo\b)\b") | ~F.length(v).between(3, 55))
        parts = F.struct(trim(first(v, pair, 1)).alias("city"), trim(first(v, pair, 2)).alias("region"))
        return F.when(bad, None).when(has(v, pair), let(parts, of_pair)).when(F.lower(v).isin(*SOLO_CITIES), location(v))

    return let(location(two), body)


def gender(entity: Column, label: Column | None = None) -> Column:
    """From an entity id, else from a supplied label; never from a name."""
    from .text import qid

    known = lookup(qid(entity), GENDER_IDS)
    if label is None:
        return known
    word = F.lower(trim(text(label)))
    return F.coalesce(known, F.when(word.isin("m", "male", "man"), "male").when(word.isin("f", "female", "woman"), "female"))


def is_executive_only(c: Column) -> Column:
    return has(text(c), EXECUTIVE) & ~has(text(c), r"\b(co-?founder|founder)\b")


def field_record(value: Column, source: Column, confidence: Column, as_of: Column, evidence: Column | None = None, reason: Column | None = None) -> Column:
    """A value with where it is from; a blank one is ``Unknown`` with the reason."""
    blank = is_blank(value)
    return F.struct(F.when(blank, UNKNOWN).otherwise(value).alias("value"), source.alias("source"), confidence.alias("confidence"),
                    (evidence if evidence is not None else F.lit(None).cast("string")).alias("evidence"), as_of.alias("fetched_at"),
                    F.when(blank, F.coalesce(reason if reason is not None else F.lit(None).cast("string"), F.lit("no_reliable_source_found"))).alias("unknown_reason"))


def entity_industry(name: Column, domain: Column) -> Column:
    """Foundation, education or government by name and domain, else null."""
    n, d = F.lower(text(name)), F.lower(text(domain))
    return (F.when(has(n, r"\b(foundation|endowment|trust|charit(?:y|able))\b"), "Nonprofit / Foundation")
            .when(has(n, r"\b(university|college|institute of technology|school)\b") | d.endswith(".edu"), "Education")
            .when(has(n, r"\b(department|comptroller|treasurer|authority|commission|government|state of|city of|county of)\b") | d.rlike(r"\.gov(\.[a-z]{2})?$"), "Government"))
