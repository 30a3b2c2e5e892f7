"""Industry classification by evidence: rules with strong, positive and negative expressions, each with its least score."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import EDGE, cut, rx, text, trim
from ..functions.text import UNKNOWN, is_blank

# --- fixed values: (label, strong, positive, negative, least score); ``\b`` on both sides of every expression -----
RULES = (
    ("Semiconductors", (r"semiconductor(?:s)?\s+company", "fabless semiconductor", "chip(?:maker| designer| design company)", "integrated circuits?",
                        "designs? (?:and|&) (?:sells?|manufactures?) (?:GPUs?|processors?|chips?)", "invents the GPU", "GPU (?:chip|company|manufacturer|maker)",
                        "develops graphics processing units", r"graphics processing units?\s*\(GPUs?\)"),
     ("semiconductor", "fabless", "wafer fab", "integrated circuit", "chip design", "processors?", "graphics processing units?"),
     ("observability", "cloud monitoring", "monitoring as a service", "SaaS", "software (?:platform|company|product)", "cybersecurity", "e-?commerce", "marketplace", "data cloud",
      "infrastructure software"), 4),
    ("Cybersecurity", ("cybersecurity (?:company|platform|firm)", "endpoint (?:security|protection)", "cloud security (?:platform|company)", "threat intelligence (?:platform|company)"),
     ("cybersecurity", "information security", "endpoint security", "threat detection"), ("semiconductor company", "e-?commerce platform"), 3),
    ("Enterprise Software", ("enterprise software", "SaaS (?:platform|company|provider)", "software[- ]as[- ]a[- ]service", "workflow automation platform", "business software platform",
                             "observability platform", "monitoring (?:and security )?platform", "monitoring as a service", "cloud monitoring", "data (?:cloud|analytics platform)",
                             "analytics platform", "software company that (?:builds|provides|develops)", "enterprise workflows?", "AI Platform", "IT service management"),
     ("enterprise software", "SaaS", "B2B software", "software (?:platform|company)", "cloud platform", "observability", "data analytics", "enterprise workflows?"),
     ("semiconductor company", r"oil\s*(?:&|and)\s*gas company"), 3),
    ("Fintech", ("fintech (?:company|platform)", "financial technology", "financial (?:services|infrastructure) platform", "corporate (?:cards?|spend)",
                 "payments? (?:platform|infrastructure|company)", "accept payments", "neobank"),
     ("fintech", "payments?", "banking for startups", "expense management", "money movement"), ("investment bank", "venture capital firm"), 3),
    ("Biotechnology", ("biotechnology (?:company|firm)", "biotech (?:company|firm)", "gene sequencing", "genomics (?:company|platform)", "mRNA (?:therapeutics|vaccine|company)",
                       "life sciences? (?:company|tools)"), ("biotech", "biotechnology", "genomics", "therapeutics", "sequencing"), ("SaaS", "e-?commerce"), 3),
    ("Healthcare", ("healthcare (?:company|system|provider)", "medical device company"), ("healthcare", "health care", "medical device", "clinical"), ("biotechnology company",), 3),
    ("E-Commerce", ("e-?commerce (?:platform|company)", "online (?:retail|marketplace)", "commerce platform"), ("e-?commerce", "marketplace", "online store", "merchants?"), ("semiconductor",), 3),
    ("Consumer", ("consumer (?:electronics|brand|goods) company", "apparel (?:company|brand)", "eyewear (?:brand|company)", "iPhone, iPad", "footwear (?:and|&) apparel",
                  "athletic (?:apparel|footwear)"), ("consumer electronics", "apparel", "footwear", "eyewear", "consumer brand", "iPhone", "Just Do It"), (), 3),
    ("Media & Entertainment", ("streaming (?:service|platform|company)", "media (?:and|&) entertainment"), ("streaming", "entertainment company", "media company"), (), 3),
    ("Renewable Energy", ("renewable energy (?:company|provider)", "clean energy company"), ("renewable energy", "clean energy", "solar", "wind power"), (r"oil\s*(?:&|and)\s*gas",), 3),
    ("Oil & Gas", (r"oil\s*(?:&|and)\s*gas (?:company|producer|major)", "petroleum company"), (r"oil\s*(?:&|and)\s*gas", "petroleum", "upstream", "exploration and production"),
     ("renewable energy company", "SaaS"), 3),
    ("Energy", ("energy (?:company|infrastructure|technology)", "electric utility", "power (?:generation|infrastructure)", "energy transition"),
     ("power generation", "electric utility", "energy infrastructure"), ("SaaS", "e-?commerce"), 3),
    ("Aerospace & Defense", ("aerospace (?:and|&) defense", "defense (?:contractor|technology|company)", "autonomous (?:defense|weapons) (?:company|systems)"),
     ("aerospace", "defense contractor", "military technology"), ("e-?commerce",), 3),
    ("Automotive", ("electric vehicle (?:company|maker|manufacturer)", "automaker", "automotive (?:company|manufacturer)"), ("electric vehicle", "automaker", "automotive", "EV manufacturer"), (), 3),
    ("Industrial Technology", ("industrial (?:technology|automation) company", "manufacturing technology", "innovation in industry, infrastructure",
                               "global technology leader driving innovation in industry", "manufacturer of construction and mining equipment", "construction and mining equipment"),
     ("industrial automation", "manufacturing", "industrial technology", "industry, infrastructure and mobility", "construction and mining"), ("SaaS platform",), 3),
    ("Venture Capital", ("venture capital (?:firm|company|fund)", "early[- ]stage (?:venture|investor)", "VC firm", "venture firm", "product-obsessed venture"),
     ("venture capital", "seed (?:and|&) early[- ]stage", "venture firm"), ("private equity firm", "SaaS company"), 3),
    ("Private Equity", ("private equity (?:firm|company)", "buyout firm", "global investment firm", "alternative assets"), ("private equity", "buyout", "investment firm"), ("venture capital firm",), 3),
    ("Investment Banking", ("investment bank(?:ing)?", "M&A advisory"), ("investment bank", "investment banking"), (), 3),
    ("Asset Management", ("asset management (?:firm|company)", "investment management firm"), ("asset management", "investment management", "wealth management"), (), 3),
    ("Banking", ("commercial bank", "retail bank", "banking company"), ("commercial bank", "retail banking", "banking"), ("fintech", "venture capital"), 3),
    ("Artificial Intelligence", ("artificial intelligence (?:company|lab|research)", "AI (?:company|lab|research|safety) (?:company|lab)?", "generative AI (?:company|lab)",
                                 "large language model(?:s)?"), ("artificial intelligence company", "AI lab", "AI research"), ("observability", "e-?commerce platform", "semiconductor company"), 4),
    ("Cloud Infrastructure", ("cloud infrastructure (?:company|provider)", "content delivery network", "CDN", "web application firewall", "edge network", "DDoS protection"),
     ("cloud infrastructure", "CDN", "edge computing", "DDoS protection"), ("observability", "cloud monitoring", "monitoring (?:and security )?platform", "monitoring as a service",
                                                                             "semiconductor company"), 3),
)
#: Taken only where no other rule applies and a strong expression is found.
FALLBACK = ("Technology", ("technology company",), ("technology company",), ("enterprise workflows?", "AI Platform", "SaaS", "software company that"), 2)
EQUIVALENT = (("venture capital", "private equity", "investment management", "asset management"), ("enterprise software", "technology", "cloud infrastructure"),
              ("biotechnology", "healthcare"), ("energy", "renewable energy"), ("fintech", "banking"))
PARTS, PRIMARY, WHOLE, LEAST = 6, 4000, 12000, 20
# ----------------------------------------------------------------------------------------------------------------


def _whole(pattern: str) -> str:
    """A rule's expression between word edges. All begin with a word's character, and nearly all end with one: a simple look is enough there."""
    after = EDGE if pattern.endswith(r"\)") else "(?![a-z0-9_])"
    return "(?<![a-z0-9_])(?:" + rx(pattern.lower(), False) + ")" + after


def _literal(pattern: str) -> str:
    """The longest part that every match of a rule's expression holds, lower case."""
    plain = pattern
    for optional in (r"\\[()]", r"\(\?:[^()]*\)[?*+]?", r"\[[^\]]*\][?*+]?", r"\\s[?*+]?", r".[?*]"):
        plain = re.sub(optional, "\0", plain)
    return max(plain.split("\0"), key=len).lower()


def _expressions(rules: tuple, kinds: tuple[int, ...]) -> Column:
    """The rules' expressions of the given kinds (1 strong, 2 positive, 3 negative) as array<struct<rule, kind, literal, pattern>>."""
    rows = [{"rule": i, "kind": k, "literal": _literal(p), "pattern": _whole(p)} for i, rule in enumerate(rules) for k in kinds for p in rule[k]]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule:int,kind:int,literal:string,pattern:string>>")  # one literal; the optimizer parses it once


def _held(c: Column, expressions: Column, only: Column | None = None) -> Column:
    """The (rule, kind) of every expression that a lower-case text holds; an expression is tried only where its literal stands in the text."""
    found = F.filter(expressions, lambda e: (F.lit(True) if only is None else F.array_contains(only, e["rule"])) & F.contains(c, e["literal"]) & F.regexp_like(c, e["pattern"]))
    return F.transform(found, lambda e: F.struct(e["rule"], e["kind"]))


def _number(held: Column, rule: Column, kind: int) -> Column:
    return F.size(F.filter(held, lambda h: (h["rule"] == rule) & (h["kind"] == kind)))


def classify(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Add ``industry``, ``industry_confidence``, ``industry_score`` and ``industry_source`` for an array of evidence texts, most telling first.

    The first six parts, 4000 characters, count; negative expressions in the first 12000 characters of all weigh against a rule without a strong
    hit, and one among the counted parts rules it out. Of equal scores the first rule's wins; keyword hits alone are not enough.
    """
    c = F.col
    clean = F.filter(F.transform(F.col(parts), lambda p: trim(text(p))), lambda p: p != "")
    df = df.withColumns({"_primary": cut(F.array_join(F.slice(clean, 1, PARTS), " · "), PRIMARY), "_full": F.lower(cut(F.array_join(F.transform(F.col(parts), text), " "), WHOLE))})
    rules = (*RULES, FALLBACK)
    df = df.withColumn("_low", F.lower("_primary"))  # a column of its own: an expression would be made anew for each rule
    df = df.withColumn("_held", F.when(F.length("_primary") >= LEAST, _held(c("_low"), _expressions(rules, (1, 2, 3)))))
    # a rule without a strong hit and without a negative one is weighed against the whole text as well
    at = F.array_distinct(F.transform(F.filter("_held", lambda h: (h["kind"] < 3) & (h["rule"] < len(RULES))), lambda h: h["rule"]))
    df = df.withColumn("_at", at)
    df = df.withColumn("_weak", F.filter("_at", lambda r: (_number(c("_held"), r, 1) == 0) & (_number(c("_held"), r, 3) == 0)))
    df = df.withColumn("_against", F.when(F.size("_weak") > 0, _held(c("_full"), _expressions(rules, (3,)), c("_weak"))).otherwise(F.array().cast("array<struct<rule:int,kind:int>>")))
    least = F.array(*[F.lit(r[4]) for r in rules])
    labels = F.array(*[F.lit(r[0]) for r in rules])

    def scored(r: Column) -> Column:
        strong, against = _number(c("_held"), r, 1), _number(c("_against"), r, 3)
        score = strong * 4 + _number(c("_held"), r, 2) * 2 - against * 3
        open_ = (strong > 0) | (_number(c("_held"), r, 3) == 0)
        return F.when(open_ & (score >= F.get(least, r)), F.struct(score.alias("score"), (-r).alias("order"), F.get(labels, r).alias("label"), strong.alias("strong"), F.get(least, r).alias("least")))

    # the fallback is not ruled out by negatives; it needs a strong hit
    fallback = F.when(_number(c("_held"), F.lit(len(RULES)), 1) > 0, F.struct(F.lit(6).alias("score"), F.lit(-99).alias("order"), F.lit(FALLBACK[0]).alias("label"), F.lit(1).alias("strong"), F.lit(FALLBACK[4]).alias("least")))
    df = df.withColumn("_best", F.coalesce(F.array_max(F.array_compact(F.transform("_at", scored))), fallback))
    sure, ample = c("_best.strong") > 0, c("_best.score") >= c("_best.least") + 2
    confidence = F.when(sure & ample, "high").when(sure | ample, "medium").otherwise("low")
    return (df.withColumn("industry_confidence", F.coalesce(F.when(c("_best").isNotNull(), confidence), F.lit("low")))
            .withColumn("industry", F.when(c("industry_confidence") != "low", c("_best.label")).otherwise(UNKNOWN))
            .withColumn("industry_score", F.coalesce(c("_best.score"), F.lit(0)))
            .withColumn("industry_source", F.when(F.length("_primary") < LEAST, "none").when(c("_best").isNull(), "insufficient_signal").when(c("industry_confidence") == "low", "weak_keyword_rejected")
                        .when(sure, "explicit_description").otherwise("multi_signal"))
            .drop("_primary", "_low", "_full", "_held", "_at", "_weak", "_against", "_best"))


def equivalent(got: Column, expected: Column) -> Column:
    """Equal, one within the other, or of one family of labels; unknown is equivalent to nothing."""
    a, b = F.lower(trim(text(got))), F.lower(trim(text(expected)))
    family = F.lit(False)
    for group in EQUIVALENT:
        family = family | (a.isin(*group) & b.isin(*group))
    return ~is_blank(got) & ~is_blank(expected) & ((a == b) | F.contains(a, b) | F.contains(b, a) | family)
