"""Consensus of several sources' values, founder lists, and the field resolvers with their reasons to abstain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import HEADCOUNT_BUCKETS, headcount, location
from ..functions.regex import distinct_nocase, let, text, trim
from ..functions.text import UNKNOWN, founder_keys, is_blank, person_key
from .provider import AUTHORITY

# --- fixed values -----------------------------------------------------------------------------------------------
OTHER_AUTHORITY, CONFLICT_GAP, FOUNDER_LEAST = 20, 25, 50
OFFICIAL = ("official_about", "official_contact", "official_page", "json_ld")
# ----------------------------------------------------------------------------------------------------------------


def authority_rank(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in AUTHORITY.items() for x in p]), source), F.lit(OTHER_AUTHORITY))


def pick_consensus(hits: DataFrame, require_explicit: bool | Column = False, keys: tuple[str, ...] = ("company_id",)) -> DataFrame:
    """(*keys, value, source, best, sources, conflict) of hits (*keys, seq, value, source, explicit, authority).

    Values are one if they are equal but for case; the best has the highest authority, then the most sources, then came first. With
    ``require_explicit`` (a condition on the keys) only explicit hits count, if there are any. Two official values of near authority are a conflict.
    Both readings of a value, of all hits and of the explicit ones, come from one aggregation.
    """
    c = F.col
    wants = F.lit(require_explicit) if isinstance(require_explicit, bool) else require_explicit
    strength = c("authority") * 10 + authority_rank(c("source"))
    stated = F.coalesce(c("explicit"), F.lit(True)) | c("source").isin("wikidata", "json_ld")

    def reading(ok: Column) -> Column:
        only = lambda x: F.when(ok, x)
        return F.struct(F.max(only(c("_s"))).alias("best"), F.size(F.collect_set(only(c("source")))).alias("sources"), F.min(only(c("seq"))).alias("seq"),
                        F.max_by(only(F.struct("value", "source")), only(F.struct("_s", -c("seq")))).alias("hit"))

    groups = hits.withColumns({"_v": F.lower(trim(text("value"))), "_s": strength, "_x": stated}).groupBy(*keys, "_v").agg(reading(F.lit(True)).alias("all"), reading(c("_x")).alias("stated"))
    within = Window.partitionBy(*keys)
    any_ = F.max(c("stated.best").isNotNull()).over(within)
    groups = groups.withColumn("_any", any_ & wants).withColumn("r", F.when(c("_any"), c("stated")).otherwise(c("all"))).where("r.best IS NOT NULL").select(*keys, "r.*")
    order = within.orderBy(F.desc("best"), F.desc("sources"), "seq")
    placed = groups.withColumns({"rank": F.row_number().over(order), "next_best": F.lead("best").over(order), "next_source": F.lead("hit.source").over(order)})
    conflict = c("hit.source").isin(*OFFICIAL) & c("next_source").isin(*OFFICIAL) & (c("best") - c("next_best") < CONFLICT_GAP)
    return placed.where("rank = 1").select(*keys, c("hit.value").alias("value"), c("hit.source").alias("source"), "best", "sources", F.coalesce(conflict, F.lit(False)).alias("conflict"))


def confidence(source: Column, explicit: Column) -> Column:
    rank = authority_rank(source)
    return F.when((rank >= 80) & explicit, "high").when((rank >= 50) | explicit, "medium").otherwise("low")


#: Of each resolved field the reasons to abstain: nothing found, and sources that disagree.
REASONS = {"hq": ("no_reliable_hq", "conflicting_sources"), "headcount": ("no_reliable_headcount", "conflicting_ranges")}


def resolve_fields(companies: DataFrame, hits: DataFrame) -> DataFrame:
    """(company_id, hq, headcount): each a struct(value, source, confidence, unknown_reason) of hits (company_id, kind, seq, ...).

    The consensus, or the reason to abstain: companies without a resolved identity abstain, conflicting official values too, and low confidence is never shown.
    """
    c = F.col
    best = pick_consensus(hits, c("kind") == "hq", ("company_id", "kind"))
    found = best.groupBy("company_id").agg(*[F.max(F.when(c("kind") == k, F.struct("value", "source", "conflict"))).alias(k) for k in REASONS])
    df = companies.select("company_id", "domain").join(found, "company_id", "left")

    def resolved(kind: str) -> Column:
        none, conflict = REASONS[kind]
        value, source = c(f"{kind}.value"), c(f"{kind}.source")
        sure = confidence(source, F.lit(True))
        reason = F.when(c("domain").isNull(), "identity_not_resolved").when(value.isNull(), none).when(c(f"{kind}.conflict"), conflict)
        if kind == "headcount":
            reason = F.when(reason.isNotNull(), reason).when(~value.isin(*[label for _, label in HEADCOUNT_BUCKETS]), "unbucketable_headcount")
        reason = F.when(reason.isNotNull(), reason).when(sure == "low", "low_confidence_only")
        return F.struct(F.when(reason.isNull(), value).otherwise(UNKNOWN).alias("value"), F.when(reason.isNull(), source).otherwise("none").alias("source"),
                        F.when(reason.isNull(), sure).otherwise("low").alias("confidence"), reason.alias("unknown_reason"))

    return df.select("company_id", *[resolved(k).alias(k) for k in REASONS])


def score_founders(hits: DataFrame) -> DataFrame:
    """(company_id, founders, score) of hits (company_id, seq, value, source, authority) whose values are lists of names.

    A name's points are summed over its hits; names of 50 points or more stay, in order. Knowledge-base names stand alone where pages share none of them.
    """
    c = F.col
    names = hits.select("company_id", "seq", "source", "authority", F.posexplode(F.filter(F.transform(F.split("value", ";"), trim), lambda n: ~is_blank(n))).alias("place", "name"))
    scored = (names.withColumns({"k": person_key(c("name")), "points": authority_rank(c("source")) + c("authority") * 5}).groupBy("company_id", "k")
              .agg(F.sum("points").alias("score"), F.min_by("name", F.struct("seq", "place")).alias("name"), F.min(F.struct("seq", "place")).alias("at"),
                   F.max(c("source") == "wikidata").alias("wiki"), F.max(c("source") != "wikidata").alias("page")))
    lists = (scored.where(c("score") >= FOUNDER_LEAST).groupBy("company_id")
             .agg(F.array_sort(F.collect_list(F.struct("at", "name", "wiki", "page", "score"))).alias("all")))
    apart = F.exists("all", lambda n: n["wiki"]) & F.exists("all", lambda n: n["page"]) & ~F.exists("all", lambda n: n["wiki"] & n["page"])
    kept = F.when(apart, F.filter("all", lambda n: n["wiki"])).otherwise(c("all"))
    return lists.select("company_id", F.array_join(F.transform(kept, lambda n: n["name"]), "; ").alias("founders"), F.array_max(F.transform(kept, lambda n: n["score"])).alias("score"))


def founder_completeness(infobox: Column, listed: Column) -> Column:
    """struct(completeness, reason) of the infobox's names against the knowledge base's."""
    a, b = founder_keys(infobox), founder_keys(listed)
    both = F.size(F.array_intersect(a, b))

    def made(level: str, reason: str | None) -> Column:
        return F.struct(F.lit(level).alias("completeness"), F.lit(reason).cast("string").alias("reason"))

    return (F.when(F.size(b) == 0, F.when(F.size(a) == 0, made("none", "infobox_empty")).otherwise(made("none", "p112_empty"))).when(F.size(a) == 0, made("partial", "infobox_empty"))
            .when(both == 0, made("partial", "no_overlap")).when((F.size(a) != F.size(b)) | (both < F.size(a)), made("partial", "count_mismatch")).otherwise(made("complete", None)))


def founder_match(got: Column, expected: Column) -> Column:
    """struct(outcome, precision, recall) of one founder list against another, by first and last name."""
    keys = lambda c: F.array_distinct(F.filter(F.transform(F.split(text(c), ";"), lambda n: person_key(trim(n))), lambda k: k != ""))
    g, e = keys(got), keys(expected)
    both = F.size(F.array_intersect(g, e))
    precision, recall = both / F.size(g), both / F.size(e)
    outcome = (F.when(is_blank(expected), "not_applicable").when(is_blank(got), "unknown").when((both == F.size(g)) & (both == F.size(e)), "exact_complete")
               .when(both == F.size(g), "correct_partial").otherwise("incorrect"))
    return F.struct(outcome.alias("outcome"), F.when(~is_blank(got), precision).alias("precision"), F.when(~is_blank(expected), recall).alias("recall"))


def _targets(expected: Column, alternatives: Column | None) -> Column:
    some = F.array(expected) if alternatives is None else F.concat(F.array(expected), F.coalesce(alternatives, F.array().cast("array<string>")))
    return F.filter(some, lambda t: text(t) != "")


def location_equivalent(got: Column, expected: Column, alternatives: Column | None = None) -> Column:
    """Equal in canonical form, case aside, or one within the other; a blank place is equivalent to nothing."""
    places = F.transform(_targets(expected, alternatives), lambda t: F.lower(location(t)))
    return ~is_blank(got) & let(F.lower(location(got)), lambda g: F.exists(places, lambda t: F.contains(g, t) | F.contains(t, g)))


def headcount_equivalent(got: Column, expected: Column, alternatives: Column | None = None) -> Column:
    """The same bucket; a blank number is equivalent to nothing."""
    return ~is_blank(got) & F.array_contains(F.transform(_targets(expected, alternatives), headcount), headcount(got))


def founders_equivalent(got: Column, expected: Column) -> Column:
    return founder_match(got, expected)["outcome"] == "exact_complete"


def founders_accurate(got: Column, expected: Column) -> Column:
    """Whether every person named is right, though some may lack."""
    return founder_match(got, expected)["outcome"].isin("exact_complete", "correct_partial")


def founder_overlap(a: Column, b: Column) -> Column:
    """The persons of both lists, by their keys, sorted: an intersection."""
    return F.array_sort(F.array_intersect(founder_keys(a), founder_keys(b)))


def team_gender(genders: Column, completeness: Column) -> Column:
    """A founding team's composition from supplied genders: an incomplete team of men alone is unknown."""
    any_f, any_m = F.exists(genders, lambda g: g == "female"), F.exists(genders, lambda g: g == "male")
    open_ = (F.size(genders) == 0) | F.exists(genders, lambda g: g.isNull() | ~g.isin("female", "male"))
    return (F.when(any_f & any_m, "mixed").when(any_f, "female").when(any_m & ~open_ & (completeness == "complete"), "male").otherwise(UNKNOWN))


def merge_site_founders(json_ld: Column, explicit: Column, bios: Column) -> Column:
    """Names of structured data and of explicit sentences; those of short biographies only if both are empty."""
    lists = [F.filter(F.transform(F.split(text(c), ";"), trim), lambda n: n != "") for c in (json_ld, explicit, bios)]
    first = F.concat(lists[0], lists[1])
    return F.array_join(distinct_nocase(F.when(F.size(first) > 0, first).otherwise(lists[2])), "; ")
