"""Facts in prose, with the words around them as evidence. Column expressions; matches' offsets come from the pieces between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import EXECUTIVE, founders, headcount, hq
from .regex import cut, every, first, has, let, rx, squeeze, sub, text, trim, words
from .scan import scanned
from .text import UNKNOWN, is_blank

# --- fixed values -----------------------------------------------------------------------------------------------
_CITY, _REGION, _END = r"([A-Z][a-zA-Z '-]{1,40}?)", r"([A-Z][a-zA-Z'-]{1,24})", r"([A-Z]{2}(?![a-zA-Z])|[A-Z][a-zA-Z'-]{2,24})"
_HQ = r"\b(?:global\s+|corporate\s+|world\s+)?headquarters(?:\s+are|\s+is|\s+in)?\s+(?:located\s+)?(?:in\s+)?"
HQ_PATTERNS = (
    rf"{_HQ}{_CITY},\s*{_REGION},\s*{_REGION}\b", rf"\bheadquartered\s+in\s+{_CITY},\s*{_REGION},\s*{_REGION}\b", rf"{_HQ}{_CITY},\s*{_END}\b",
    rf"\bheadquartered\s+in\s+{_CITY},\s*{_END}\b", rf"\b(?:is\s+)?based\s+in\s+{_CITY},\s*{_END}\b", rf"\bHQ(?:\s+in)?\s*[:\-]?\s*{_CITY},\s*{_END}\b",
    r"\bheadquartered\s+in\s+(New York(?: City)?|San Francisco|Los Angeles|London|Boston|Chicago|Seattle|Austin|Palo Alto|Menlo Park|Mountain View|Cupertino|Santa Clara|Redmond|Tokyo|Singapore|Berlin|Paris|São Paulo|Sao Paulo)\b()",
)
NOT_HQ = (r"\b(office in|offices in|office location|branch in|portfolio compan|invests in|investment in|incorporated in|incorporation|delaware|registered in|remote[- ]first|distributed team"
          r"|founder (?:lives|based)|born in)\b")
HEADCOUNT_PATTERNS = (
    r"\b(?:approximately|about|over|more than)?\s*(\d{1,3}(?:,\d{3})*)\s*[–-]\s*(\d{1,3}(?:,\d{3})*)\+?\s*(?:employees|people|team members|staff)\b",
    r"\b(?:company size|employees?|headcount|team size)\s*[:=]?\s*(\d{1,3}(?:,\d{3})*\s*[–-]\s*\d{1,3}(?:,\d{3})*\+?|\d{1,3}(?:,\d{3})*\+|more than\s+\d{1,3}(?:,\d{3})*)\b()",
    r"\b(\d{1,3}(?:,\d{3})*)\+?\s*employees\b()", r"\bemploys\s+(?:approximately\s+|about\s+|over\s+)?(\d{1,3}(?:,\d{3})*)\b()",
)
_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z.'-]+)"
FOUNDER_PATTERNS = (
    rf"(?:[Ff]ounded by|[Cc]o-founded by|[Ee]stablished by|[Ss]tarted by|[Ll]aunched by)\s+({_NAME}{{0,3}}(?:\s+(?:and|&|,)\s+{_NAME}{{0,3}}){{0,4}})()",
    rf"({_NAME}{{1,3}})\s+(?:and|&)\s+({_NAME}{{1,3}})\s+(?:co-)?founded\b", rf"({_NAME}{{1,3}})\s+(?:is|was)\s+(?:a\s+|the\s+)?(?:co-)?founder\b()",
    rf"(?:[Ff]ounders?|[Cc]o-[Ff]ounders?)\s*[:\-]\s*({_NAME}{{1,3}}(?:\s*(?:,|;|and|&)\s*{_NAME}{{1,3}}){{0,5}})()",
)
FOUNDER_LINE = (r"(?:^|[\n.]\s*)([A-Z][a-z]+(?:\s+[A-Z][a-z'-]+){1,3})\s*[,;:\x{2013}\x{2014}\-]\s*((?:Co-)?Founder)\b",)
NOT_A_NAME = r"^(Our|The|Meet|Team|About|Leadership)\b"
TEAM_PAGE, COUNTED_STAFF = r"\b(our team|meet the team|leadership team)\b", r"\b\d{2,}\s*employees\b"
#: Where a page's first person of a founder's kind stands, and what is no person's name.
PERSON_PATTERNS = (r"(?:[Ff]ounded by|[Cc]o-founded by|[Ff]ounder[:\s]+|[Cc]o-[Ff]ounder[:\s]+)([A-Z][a-z]+(?:\s+[A-Z][a-z.'-]+){1,3})",
                   r"([A-Z][a-z]+(?:\s+[A-Z][a-z.'-]+){1,3})\s*,?\s*(?:Founder|Co-Founder|CEO|Chief Executive Officer|Managing Partner|Managing Director)\b")
NO_PERSON, TITLE_IN_NAME = r"^(The|Our|This|With|And|Or|For|From|About|Meet|Team|Company|Board)\b|^(and|or)\b", r"\b(?:CEO|CTO|CFO|Founder)\b"
FOUNDER_WORDS = (r"\b(founded by|co-founded by|founder|co-founder|ceo)\b",)
#: One of these stands in every match, in small letters.
HQ_NEEDS, HEADCOUNT_NEEDS, FOUNDER_NEEDS, LINE_NEEDS = ("headquarter", "based", "hq"), ("employ", "people", "team", "staff", "company size", "headcount"), ("found", "established by", "started by", "launched by"), ("founder",)
#: What ends the name of another organization, and a founder's word.
ORGANIZATION_TAIL, FOUNDER_WORD = r"\s+(?:Read|Inc|LLC|Ltd|Corp|Corporation|Company|the|story|case)\b.*$", r"\bfounder\b"
HQ_EXPLICIT = r"\b(headquarters|headquartered|hq\b|corporate headquarters|global headquarters|based in)\b"
IS_HQ = r"\bheadquarters|headquartered\b"
NOT_HEADCOUNT = r"\bfollowers|portfolio companies|customers|users\b"
FOUNDING = r"\b(founded|founder|co-founded|co-founder|established by|started by)\b"
FOREIGN_FOUNDER = r"\b(?:Co-)?Founders?(?:\s+and\s+(?:CEO|CTO|President)|\s+&\s+(?:CEO|CTO|President))?\s*(?:,|of|at)\s+([A-Z][A-Za-z0-9&.'-]{1,40}(?:\s+[A-Z][A-Za-z0-9&.']{1,30}){0,3})"
# ----------------------------------------------------------------------------------------------------------------


def _three(pattern: str) -> str:
    """The pattern with three groups; missing ones capture the empty text."""
    plain = pattern.replace(r"\(", "")
    return pattern + "()" * (3 - (plain.count("(") - plain.count("(?")))


def matches(c: Column, patterns: tuple[str, ...], before: int, after: int, ignore_case: bool = True) -> Column:
    """Every match of each pattern in turn, as structs (start, match, g1, g2, g3, window): its 0-based place and the characters around it.

    The patterns are data of one expression, so a plan doesn't grow with their number; one that a text doesn't hold is only looked for once. It is for
    lambda functions, which can't call ``scan.scanned``; that finds the same in one pass.
    """
    s = text(c)  # the callers pass plain columns, so that repeating them costs nothing

    def of(p: Column) -> Column:
        groups = [F.regexp_extract_all(s, p, F.lit(i)) for i in range(4)]
        found = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("match", "g1", "g2", "g3"))])
        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
        steps = F.zip_with(F.slice(F.split(s, p, -1), F.lit(1), F.size(groups[0])), groups[0], lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))
        starts = F.aggregate(steps, zero, lambda a, x: F.struct((a["at"] + x["gap"] + x["size"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["gap"])).alias("starts")), lambda a: a["starts"])

        def one(m: Column, at: Column) -> Column:
            left = F.greatest(at - before, F.lit(0))
            return F.struct(at.alias("start"), m["match"].alias("match"), m["g1"].alias("g1"), m["g2"].alias("g2"), m["g3"].alias("g3"), F.substr(s, left + 1, at + F.length(m["match"]) + after - left).alias("window"))

        return F.when(F.regexp_like(s, p), F.zip_with(found, starts, one))

    return F.flatten(F.array_compact(F.transform(F.array(*[F.lit(rx(_three(p), ignore_case)) for p in patterns]), of)))


def _hits(values: Column, value, evidence: int, extra=None) -> Column:
    return F.filter(F.transform(values, lambda h: F.struct(value(h).alias("value"), cut(trim(h["window"]), evidence).alias("evidence"),
                                                          (extra(h) if extra else F.lit(True)).alias("explicit"))), lambda h: h["value"].isNotNull())


def hq_hits(c: Column) -> Column:
    """Headquarters named in a text: structs (value, evidence, explicit), patterns in order; offices and portfolios are no headquarters."""

    def value(h: Column) -> Column:
        veto = has(h["window"], NOT_HQ) & ~has(h["window"], IS_HQ)
        last = F.coalesce(F.nullif(h["g3"], F.lit("")), F.nullif(h["g2"], F.lit("")))
        return F.when(~veto, hq(F.concat_ws(", ", trim(h["g1"]), trim(last))))

    return _hits(scanned(c, HQ_PATTERNS, 60, 40, needs=HQ_NEEDS), value, 220, lambda h: has(h["window"], HQ_EXPLICIT))


def headcount_hits(c: Column, team: Column | None = None) -> Column:
    """Numbers of employees in a text, as buckets; followers, customers and portfolios are none.

    Where ``team`` holds, a page that presents its team without a number of employees says nothing of all of them.
    """

    def value(h: Column) -> Column:
        raw = F.when(h["g2"] != "", F.concat_ws("–", h["g1"], h["g2"])).otherwise(h["g1"])
        return let(headcount(raw), lambda bucket: F.when(~has(h["window"], NOT_HEADCOUNT) & ~is_blank(bucket), bucket))

    hits = _hits(scanned(c, HEADCOUNT_PATTERNS, 40, 30, needs=HEADCOUNT_NEEDS), value, 200)
    return hits if team is None else F.filter(hits, lambda _: ~(team & has(text(c), TEAM_PAGE) & ~has(text(c), COUNTED_STAFF)))


def is_foreign_founder(window: Column, company: Column) -> Column:
    """Whether the words around a founder name another organization."""
    org = first(text(window), FOREIGN_FOUNDER, 1, False)
    found = F.lower(trim(sub(org, ORGANIZATION_TAIL, "")))
    name = F.lower(trim(text(company)))
    tokens = F.filter(F.split(name, " "), lambda t: F.length(t) > 2)

    def same(org: Column) -> Column:
        return (F.contains(org, name) | F.contains(name, org) | ((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(org, t)))
                | F.coalesce(F.element_at(F.split(org, " "), 1) == F.get(tokens, F.lit(0)), F.lit(False)))

    return let(found, lambda org: (F.length(org) >= 2) & ((name == "") | ~same(org)))


def in_sentence(c: Column, start: Column, match: Column, company: Column) -> Column:
    """Whether the sentence around a match names the company, whole or by all its longer words."""
    s, name = text(c), F.lower(text(company))
    head = F.substring_index(F.substr(s, F.lit(1), start), ".", -1)
    tail = F.substring_index(F.substr(s, start + F.length(match) + 1), ".", 1)
    sentence = F.lower(F.concat(head, match, tail))
    tokens = F.filter(F.split(name, " "), lambda t: F.length(t) > 2)
    return (name == "") | F.contains(sentence, name) | ((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(sentence, t)))


def founder_line_hits(c: Column, company: Column, team: Column) -> Column:
    """Founders in lines such as ``Name, Co-Founder``: the company stands nearby, which ``team`` pages of its own may leave out."""
    name = F.lower(text(company))
    tokens = F.filter(words(name), lambda t: F.length(t) > 2)

    def value(h: Column) -> Column:
        from_ = F.greatest(h["start"] - 160, F.lit(0))
        near = F.lower(F.substr(text(c), from_ + 1, h["start"] + F.length(h["match"]) + 40 - from_))
        close = lambda n: (name == "") | F.contains(n, name) | ((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(n, t)))
        ok = ~has(h["g1"], NOT_A_NAME) & ~is_foreign_founder(h["window"], company) & (team | let(near, close))
        return let(founders(h["g1"]), lambda names: F.when(ok & ~is_blank(names), names))

    return _hits(scanned(c, FOUNDER_LINE, 20, 60, needs=LINE_NEEDS), value, 200)


def first_person(c: Column, company: Column) -> Column:
    """The first founder or head that a page names, Unknown without one; the company's own name is none."""
    name = F.lower(text(company))

    def person(n: Column) -> Column:
        low = F.lower(n)
        return (F.size(words(n)) >= 2) & (F.length(n) < 60) & ~has(n, NO_PERSON) & ~has(n, TITLE_IN_NAME) & ~F.contains(name, low) & ~((name != "") & F.contains(low, name))

    named = F.transform(F.concat(*[every(text(c), p, 1, False) for p in PERSON_PATTERNS]), trim)
    return F.coalesce(F.get(F.filter(named, person), F.lit(0)), F.lit(UNKNOWN))


def founder_evidence(c: Column) -> Column:
    """struct(hits, windows): the first twelve raw hits and the first eight windows around a founder's words, for an audit."""
    hits = F.transform(F.slice(matches(c, PERSON_PATTERNS, 0, 0, False), 1, 12), lambda h: F.struct(cut(h["match"], 120).alias("match"), trim(h["g1"]).alias("captured")))
    around = F.transform(F.slice(matches(c, FOUNDER_WORDS, 40, 80), 1, 8), lambda h: squeeze(F.substr(h["window"], F.lit(1), F.least(h["start"], F.lit(40)) + 80)))
    return F.struct(hits.alias("hits"), around.alias("windows"))


def founder_hits(c: Column, company: Column, team: Column | None = None) -> Column:
    """Founders that a text names for a company: those of other organizations, executives without founding, and the company's own name are left out.

    Behind those of its sentences come those of its lines.
    """

    def value(h: Column) -> Column:
        two = (h["g2"] != "") & ~has(h["match"], "founded by")
        raw = F.when(two, F.concat_ws("; ", h["g1"], h["g2"])).otherwise(h["g1"])
        name = F.lower(text(company))
        return let(founders(raw), lambda names: F.when(has(h["window"], FOUNDING) & ~is_foreign_founder(h["window"], company) & ~is_blank(names)
              & ~((name != "") & F.contains(F.lower(names), name)) & ~(has(raw, EXECUTIVE) & ~has(h["window"], FOUNDER_WORD)) & in_sentence(c, h["start"], h["match"], company), names))

    return F.concat(_hits(scanned(c, FOUNDER_PATTERNS, 50, 80, False, FOUNDER_NEEDS), value, 240), founder_line_hits(c, company, F.lit(False) if team is None else team))
