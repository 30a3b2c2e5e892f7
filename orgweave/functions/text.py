"""Names: blank values, legal forms, match keys, tokens and variants. Every function is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import distinct_nocase, every, has, let, rx, squeeze, sub, text, trim, words

UNKNOWN = "Unknown"

# --- fixed values -----------------------------------------------------------------------------------------------
#: Legal forms that match keys ignore.
LEGAL_FORMS = r"\b(inc\.?|incorporated|llc|l\.l\.c\.?|llp|l\.l\.p\.?|lp|l\.p\.?|plc|ltd\.?|limited|corp\.?|corporation|co\.?|company|holdings?|group|gmbh|ag|sa|nv|bv|pvt\.?|pte\.?|spa|srl)\b"
#: The narrower set of identity keys.
IDENTITY_FORMS = r"\b(inc\.?|incorporated|llc|l\.l\.c\.?|llp|lp|plc|ltd\.?|limited|corp\.?|corporation|co\.?|company|holdings?|gmbh)\b"
#: The set of the decisive comparison.
DECISIVE_FORMS = r"\b(inc|incorporated|llc|l\.l\.c|llp|lp|plc|ltd|limited|co|corp|corporation|company|gmbh|ag|sa|nv|bv|pvt|pte|spa|srl)\b"
COMMON_BRANDS = ("vista", "mercury", "scale", "ramp", "insight", "apex", "summit", "horizon", "pulse", "human", "capital", "chapter", "one", "next", "first", "prime", "alpha",
                 "meta", "unity", "vertex", "nexus", "orbit", "forge", "spark", "bolt", "wave", "core")
GENERIC_WORDS = ("the", "and", "of", "for", "global", "management", "company", "group", "inc", "llc", "corp", "corporation", "holdings", "international", "technologies", "technology")
GENERIC_ORG_WORDS = (
    "capital", "partners", "partner", "management", "advisors", "advisor", "advisory", "group", "holdings", "holding", "associates", "investments", "investment", "ventures",
    "venture", "fund", "funds", "asset", "assets", "wealth", "securities", "foundation", "endowment", "trust", "system", "systems", "university", "college", "institute",
    "office", "board", "retirement", "global", "international", "financial", "finance", "equity", "credit", "services", "service", "solutions", "company", "llc", "inc",
    "ltd", "limited", "corp", "corporation", "llp", "lp", "state", "city", "county", "public", "employees", "employee", "teachers", "teacher", "municipal", "federal",
    "national", "regional", "department", "authority", "agency", "commission", "association", "council", "district")
DECISIVE_STOP = ("the", "of", "and", "for", "a", "an", "at", "in", "on", "to")
PAGE_STOP = ("the", "and", "of", "a", "an", "for", "in", "on", "at", "to", "inc", "llc", "ltd", "corp", "co", "plc", "gmbh", "lp", "llp")
# ----------------------------------------------------------------------------------------------------------------


def is_blank(c: Column) -> Column:
    """Null, empty, a dash, ``unknown``, ``not_applicable``, or a note that someone must look."""
    return has(trim(text(c)), r"^$|^-$|^unknown$|^needs manual|^needs verification|^not_applicable$")


def normalized(c: Column) -> Column:
    return F.lower(squeeze(text(c)))


def prefer(a: Column, b: Column) -> Column:
    """The first that is not blank, else ``Unknown``."""
    return F.coalesce(F.when(~is_blank(a), a), F.when(~is_blank(b), b), F.lit(UNKNOWN))


def strip_legal(c: Column) -> Column:
    return squeeze(F.regexp_replace(sub(text(c), LEGAL_FORMS, " "), "[.,]", " "))


def match_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_legal(c)), "[^a-z0-9]+", "")


def name_core(c: Column) -> Column:
    """Lower case, without punctuation, legal forms and parentheses; spaces stay."""
    s = F.regexp_replace(F.lower(text(c)), "[.,]", " ")
    return squeeze(sub(sub(s, LEGAL_FORMS, " "), r"\s*\(.*?\)\s*", " "))


def identity_name(c: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(sub(text(c), IDENTITY_FORMS, " "), "[.,]", " ")))


def identity_key(c: Column) -> Column:
    return F.regexp_replace(identity_name(c), "[^a-z0-9]+", "")


def identity_tokens(c: Column) -> Column:
    parts = F.transform(words(identity_name(c)), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.filter(parts, lambda w: (F.length(w) > 1) & ~w.isin(*GENERIC_WORDS))


def distinctive_tokens(c: Column) -> Column:
    return F.filter(identity_tokens(c), lambda w: (F.length(w) >= 4) & ~w.isin(*COMMON_BRANDS))


def store_key(c: Column) -> Column:
    """Lower-case letters and digits alone; legal forms stay."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]", "")


def page_tokens(c: Column) -> Column:
    """Words of three characters or more that tell a name apart; else the whole name, squeezed together."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*PAGE_STOP))
    joined = store_key(c)
    return F.when(F.size(parts) > 0, F.array_distinct(parts)).when(joined != "", F.array(joined)).otherwise(F.array().cast("array<string>"))


def ambiguity_risk(c: Column, candidates: Column | int = 0) -> Column:
    """0 to 100: how likely others bear the name. A name without tokens counts as made of common brands."""
    n = candidates if isinstance(candidates, Column) else F.lit(candidates)
    return let(identity_tokens(c), lambda tokens: F.least(F.lit(100), F.when(F.size(tokens) <= 1, 35).otherwise(0) + F.when(F.size(tokens) == 2, 15).otherwise(0)
              + F.when(F.forall(tokens, lambda t: t.isin(*COMMON_BRANDS) | (F.length(t) <= 4)), 25).otherwise(0)
              + F.when(F.length(identity_key(c)) <= 6, 15).otherwise(0) + F.when(n >= 4, 10).otherwise(0) + F.when(n >= 6, 10).otherwise(0)))


def name_variants(c: Column, extras: Column | None = None) -> Column:
    """Aliases in parentheses, the name without them, then ``extras``; distinct, without the name itself."""
    s = text(c)
    bare = squeeze(sub(s, r"\s*\([^)]*\)\s*", " "))
    found = F.concat(every(s, r"\(([^)]{2,60})\)"), F.array(bare), F.coalesce(extras, F.array().cast("array<string>")) if extras is not None else F.array().cast("array<string>"))
    usable = F.filter(F.transform(found, lambda v: squeeze(text(v))), lambda v: (F.length(v) >= 2) & (F.lower(v) != F.lower(trim(s))))
    return distinct_nocase(usable)


def decisive_forms(c: Column) -> Column:
    """struct(key, core_key, acronym, alias_keys, tokens): how a name may show up as a host.

    The core key joins the words before the first generic one.
    """
    s = text(c)
    bare = F.regexp_replace(sub(F.regexp_replace(s, r"\([^)]*\)", " "), DECISIVE_FORMS, " "), "&", " ")
    aliases = F.filter(F.transform(every(s, r"\(([^)]{2,40})\)"), store_key), lambda a: F.length(a) >= 3)

    def forms(tokens: Column) -> Column:
        generic = F.array_position(F.transform(tokens, lambda w: w.isin(*GENERIC_ORG_WORDS).cast("int")), 1).cast("int")
        core = F.slice(tokens, F.lit(1), F.when(generic > 0, generic - 1).otherwise(F.size(tokens)))
        acronym = F.when(F.size(tokens) >= 2, F.array_join(F.transform(tokens, lambda w: F.substring(w, 1, 1)), "")).otherwise("")
        return F.struct(store_key(bare).alias("key"), F.array_join(core, "").alias("core_key"), acronym.alias("acronym"), aliases.alias("alias_keys"), tokens.alias("tokens"))

    return let(F.filter(F.split(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(*DECISIVE_STOP)), forms)


def fold_accents(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(c, "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöøōőùúûüūůűýÿžźżšśşťţřłđ", "aaaaaaaaacccdeeeeeeeeiiiiiinnnoooooooouuuuuuuyyzzzsssttrld")


def person_key(c: Column) -> Column:
    """First and last name, lower case, without accents and dots."""
    return let(words(fold_accents(F.lower(F.regexp_replace(text(c), "[.]", "")))), lambda parts: F.when(
        F.size(parts) >= 2, F.concat_ws(" ", F.element_at(parts, 1), F.element_at(parts, -1))).otherwise(F.array_join(parts, " ")))


def founder_keys(c: Column) -> Column:
    """The set of names of two words or more in a list joined by semicolons."""
    keys = F.transform(F.split(text(c), ";"), lambda n: F.trim(F.regexp_replace(F.lower(n), "[^a-z0-9]+", " ")))
    return F.array_distinct(F.filter(keys, lambda k: F.size(F.split(k, " ")) >= 2))


def qid(c: Column) -> Column:
    """The entity id in a text or address; empty without one."""
    n = F.regexp_extract(text(c), r"(?i)Q(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("Q"), n)).otherwise("")


def decode_entities(c: Column) -> Column:
    out = text(c)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def paste_lines(raw: Column) -> Column:
    """Names in a pasted text, in order: bullets and numbers go, rows with tabs stay whole, comma lists are parted.

    A line is a list if it has two parts or more, all short and without titles, and no legal form before a comma; or three parts or
    more of at most five words.
    """
    s = F.regexp_replace(text(raw), "\r\n?", "\n")
    marks = ((r"^\s*[-*•●◦▪▸►]\s+", ""), (r"^\d+[.)]\s+", ""), (r"^\[?\d+\]?\s+", ""))

    def cleaned(line: Column) -> Column:
        out = trim(line)
        for pattern, to in marks:
            out = F.regexp_replace(out, rx(pattern), to)
        return out

    def parts(line: Column) -> Column:
        split = F.filter(F.transform(F.split(line, ","), trim), lambda p: p != "")
        titles = r"\b(CEO|CTO|Partner|Director|Manager|Analyst)\b"
        hard = ((F.size(split) >= 2) & F.forall(split, lambda p: (F.length(p) <= 60) & ~has(p, titles))
                & ~has(line, r"\b(Inc|LLC|Ltd|Corp|Corporation|LP|LLP|PLC)\s*,"))
        soft = (F.size(split) >= 3) & F.forall(split, lambda p: F.size(words(p)) <= 5) & ~has(line, r"\b(CEO|Partner|Director)\b")
        return F.when(F.contains(line, F.lit("\t")) | ~(hard | soft), F.array(line)).otherwise(split)

    lines = F.filter(F.transform(F.split(s, "\n"), cleaned), lambda x: x != "")  # each line is bound by the lambda below
    return F.flatten(F.transform(lines, parts))


def parse_company(raw: Column) -> Column:
    """``Name | context`` as struct(name, context)."""
    parts = F.split(text(raw), rx(r"\s*\|\s*"))
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.struct(trim(F.element_at(parts, 1)).alias("name"), F.nullif(trim(rest), F.lit("")).alias("context"))
