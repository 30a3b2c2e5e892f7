"""Whole plans: from company names and lookup tables to identities and fields. They are chains of operators that the optimizer sees whole, but for
tables that are read several times and for levels of a walk, which are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import extract as X
from ..functions import matching as N
from ..functions import text as T
from ..functions.regex import cut, has, text
from ..operators import candidates as C
from ..operators import consensus as S
from ..operators import guard, industry, provider, scoring, selection
from ..operators.joins import keyed
from ..sources.readers import deep_site_evidence, page_evidence, usable_titles
from ..sources.shared import materialize


def encyclopedia_candidates(titles: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates from encyclopedia titles: title to entity to guard to official site, all equi-joins; rejected entities give none."""
    judged = guard.classify(entities.withColumn("media_context", F.lit(False)), edges).where(F.col("decision").isin("accept", "allow_unknown"))
    found = usable_titles(titles).join(judged.where("official_site IS NOT NULL"), "entity_id")
    return found.select("company_id", "seq", F.col("official_site").alias("domain"), F.coalesce("label", "title").alias("name"), F.col("description").alias("snippet"), F.lit("wikipedia").alias("source"),
                        F.lit(None).cast("int").alias("prominence"))


def resolve_pool(companies: DataFrame, pool: DataFrame, rejected: DataFrame, liveness: DataFrame, finance_filter: bool = False) -> DataFrame:
    """The second generation: merge, reject, rank with liveness, decide. One row per company, also for those without candidates."""
    merged = C.reject_domains(C.merge_by_domain(pool), rejected).join(liveness, "domain", "left").join(companies.select("company_id", "company"), "company_id")
    decided = selection.decide_pool(selection.rank_pool(merged, finance_filter), finance_filter)
    return companies.select("company_id", "company").join(decided.drop("company"), "company_id", "left").withColumn("status", F.coalesce("status", F.lit("unverified")))


def resolve_known(companies: DataFrame, learned: DataFrame, major: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(company_id, company, domain, source): learned corrections, then major firms, then the dictionary; the first that knows a name answers."""
    c = F.col
    names = companies.withColumnRenamed("company", "name")
    df = C.exact_lookup(names, learned).select("company_id", "name", c("domain").alias("learned"))
    df = df.join(keyed(C.exact_lookup(names, major).select("company_id", c("domain").alias("major"))), "company_id")
    df = df.join(keyed(C.fuzzy_lookup(names, dictionary).select("company_id", c("domain").alias("dictionary"))), "company_id")
    source = F.when(c("learned").isNotNull(), "learned").when(c("major").isNotNull(), "major_firm").when(c("dictionary").isNotNull(), "dictionary")
    return df.select("company_id", c("name").alias("company"), F.coalesce("learned", "major", "dictionary").alias("domain"), source.alias("source"))


# --- fixed values -----------------------------------------------------------------------------------------------
#: A regulator whose namesakes abroad have hosts of the same beginning; its own host goes first, and a person must choose.
REGULATOR, REGULATOR_HOST, REGULATOR_FAMILY = "securities and exchange", "sec.gov", r"^sec\.gov(\.[a-z]{2})?$"
# ----------------------------------------------------------------------------------------------------------------


def _regulator_first(decided: DataFrame, ranked: DataFrame) -> DataFrame:
    """Companies named as the regulator with two of its family among their candidates are ambiguous, with its own host in front."""
    c = F.col
    named = has(text("company"), REGULATOR)
    family = ranked.where(named & (c("domain").rlike(f"(?i){REGULATOR_FAMILY}") | (has(text("name"), REGULATOR) & c("domain").rlike(r"(?i)\.gov"))))
    found = family.groupBy("company_id").agg(F.count(F.lit(1)).alias("kin"), F.min(F.when(c("domain") == REGULATOR_HOST, c("total_score"))).alias("own_score")).where("kin >= 2")
    df = decided.join(keyed(found), "company_id", "left")
    kin, own = c("kin").isNotNull(), c("own_score").isNotNull()
    return df.withColumns({"ambiguous": kin | c("ambiguous"), "decisive_rule": F.when(~kin, c("decisive_rule")), "auto_found": ~kin & c("auto_found"), "domain": F.when(own, REGULATOR_HOST).otherwise(c("domain")),
                           "score": F.when(own, c("own_score")).otherwise(c("score")), "confidence": F.when(kin, "low").otherwise(c("confidence")), "status": F.when(kin, "potential").otherwise(c("status"))}).drop("kin", "own_score")


def resolve_staged(companies: DataFrame, learned: DataFrame, major: DataFrame, dictionary: DataFrame, pool: DataFrame, fallback: DataFrame, rejected: DataFrame, liveness: DataFrame,
                   unfinished: DataFrame | None = None, finance_filter: bool = False) -> DataFrame:
    """The whole second generation in one call: (company_id, company, stage, domain, score, confidence, ambiguous, decisive_rule, status).

    A company goes only through what it needs. What is learned answers first, then major firms, then the dictionary; the rest have their pool of candidates ranked,
    those whose pool is empty, also after rejections, their ``fallback`` candidates, and what is left is ``none``. Companies in ``unfinished`` (company_id) had a lookup that
    failed, so nothing is sure of them. Each step is an anti- or semi-join with what is still open.
    """
    c = F.col
    known = materialize(resolve_known(companies, learned, major, dictionary), "known")
    open_ = known.where("source IS NULL").select("company_id", "company")
    some = lambda rows: C.reject_domains(C.merge_by_domain(rows), rejected)
    first = materialize(some(pool.join(keyed(open_.select("company_id")), "company_id", "left_semi")), "pool")
    lonely = open_.select("company_id").join(keyed(first), "company_id", "left_anti")
    both = first.withColumn("stage", F.lit("pool")).unionByName(some(fallback.join(keyed(lonely), "company_id", "left_semi")).withColumn("stage", F.lit("fallback")))
    merged = both.join(keyed(liveness), "domain", "left").join(keyed(open_), "company_id")
    ranked = materialize(selection.rank_pool(merged, finance_filter), "ranked")
    decided = _regulator_first(selection.decide_pool(ranked.drop("stage"), finance_filter), ranked).drop("company")
    stages = ranked.groupBy("company_id").agg(F.min("stage").alias("stage"))
    late = open_.join(keyed(decided), "company_id", "left").join(keyed(stages), "company_id", "left")
    if unfinished is not None:
        late = late.join(unfinished.select("company_id").distinct().withColumn("unsure", F.lit(True)), "company_id", "left")
        late = late.withColumns({"decisive_rule": F.when(c("unsure").isNull(), c("decisive_rule")), "confidence": F.when(c("unsure"), "low").otherwise(c("confidence")),
                                 "status": F.when(c("unsure") & (c("status") == "found"), "potential").otherwise(c("status"))})
    shown = late.select("company_id", "company", F.coalesce("stage", F.lit("none")).alias("stage"), "domain", F.coalesce("score", F.lit(0)).alias("score"), F.when(c("domain").isNull(), "none").otherwise(c("confidence")).alias("confidence"),
                        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), "decisive_rule", F.coalesce("status", F.lit("unverified")).alias("status"))
    lit = F.lit
    sure = known.where("source IS NOT NULL").select("company_id", "company", c("source").alias("stage"), "domain", lit(100).alias("score"), lit("high").alias("confidence"),
                                                    ((c("source") == "major_firm") & has(c("company"), REGULATOR)).alias("ambiguous"), lit(None).cast("string").alias("decisive_rule"), lit("found").alias("status"))
    return sure.unionByName(shown)


def resolve_identity(companies: DataFrame, pool: DataFrame, pages: DataFrame) -> DataFrame:
    """The third generation: consensus and page evidence joined to each candidate by its host, scores, page-stage adjustments, selection."""
    return selection.select_identity(scored_candidates(companies, pool, pages), 72)


def resolve_in_two_stages(companies: DataFrame, pool: DataFrame, pages: DataFrame, hits: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """``resolve_identity``, and the second stage for those that are ambiguous after it: only their candidates' sites are looked through more deeply, and only their
    search hits (company_id, seq, host, title, snippet) are read. ``context`` (company_id, context) says what kind of company is meant."""
    c = F.col
    scored = materialize(scored_candidates(companies, pool, pages), "scored")
    decided = materialize(selection.select_identity(scored, 72), "decided")
    open_ = materialize(scored.join(decided.where("status = 'ambiguous'").select("company_id"), "company_id", "left_semi").select("company_id", "company", "host").distinct(), "open")
    hosts = open_.select(c("host").alias("_host")).distinct()
    near = pages.join(hosts, D.host_of(c("url")) == c("_host"), "left_semi")
    front = page_evidence(near).groupBy("host").agg(F.min(F.struct("page_id", c("title").alias("deep_title"), c("description").alias("deep_description"))).alias("f")).select("host", "f.deep_title", "f.deep_description")
    deep = deep_site_evidence(near).select("host", c("text").alias("deep_text"), c("text").alias("about_text"), c("json_ld_name").alias("deep_json_ld"))
    told = C.search_snippets(open_.withColumnRenamed("host", "domain"), hits.join(open_.select("company_id").distinct(), "company_id", "left_semi")).withColumnRenamed("domain", "host")
    given = open_.select("company_id").distinct().withColumn("context", F.lit(None).cast("string")) if context is None else context.select("company_id", "context")
    evidence = (open_.drop("company").join(front, "host", "left").join(deep, "host", "left").join(told, ["company_id", "host"], "left").join(given, "company_id", "left")
                .withColumn("supporting_sources", F.array().cast("array<string>")))
    return second_stage(decided, scored, evidence)


def scored_candidates(companies: DataFrame, pool: DataFrame, pages: DataFrame) -> DataFrame:
    """Each candidate with its consensus, its page's evidence, its signals and its score."""
    c = F.col
    agreed = C.consensus(pool.withColumn("domain", D.host_of(c("domain")))).select("company_id", "domain", "agreement")
    evidence = page_evidence(pages).groupBy("host").agg(F.min(F.struct("page_id", "title", "description", "page_text", "json_ld_name")).alias("e"))
    one = C.first_per(pool.withColumn("domain", D.host_of(c("domain"))), ["company_id", "domain"], ["seq"])
    df = one.join(companies.select("company_id", "company"), "company_id").join(agreed, ["company_id", "domain"], "left").join(evidence, c("domain") == c("host"), "left")
    df = df.withColumn("shown", c("host").isNotNull()).select("company_id", "company", "seq", "domain", "name", "source", "agreement", "snippet", "shown", "e.title", "e.description", "e.page_text", "e.json_ld_name",
                                                            F.lit(None).cast("boolean").alias("wikidata_official"))
    scored = scoring.score_identity(df)
    named = F.map_contains_key("signals", F.lit("titleMentionsCompany")) | F.map_contains_key("signals", F.lit("homepageHeadMention"))
    adjust = (F.when((c("source") == "brand_guess") & ~c("shown"), -50).otherwise(0)
              + F.when(F.map_contains_key("signals", F.lit("domainExactKey")) & c("domain").endswith(".com") & c("shown") & named, 22).otherwise(0))
    return scored.withColumn("score", c("score") + adjust)


def stage_two_signals(rows: DataFrame) -> DataFrame:
    """Add ``more``: what a deeper look adds or takes. The full name in the site's words, its description and its about page, structured data,
    the kind of entity, the given industry, and independent sources."""
    c = F.col
    join = lambda sep, *names: F.concat_ws(sep, *[F.nullif(text(n), F.lit("")) for n in names])
    df = rows.withColumns({"everything": join(" \n ", "deep_title", "deep_description", "deep_text", "about_text", "deep_json_ld", "search_snippets", "snippet", "page_text"),
                           "told": join(" ", "deep_description", "search_snippets", "snippet"), "wants": has(text("company"), r"\b(capital|ventures?|partners|equity|private equity|venture)\b"),
                           "kind": scoring.entity_type(F.lower(join(" ", "deep_title", "deep_description", "search_snippets", "deep_text"))),
                           "sources": F.array_compact(F.concat(F.array("source"), F.coalesce("supporting_sources", F.array().cast("array<string>"))))})
    family = lambda x: F.when(x.rlike("wikidata"), "wikidata").when(x.rlike("search|instant_answer|infobox"), "search").when(x.rlike("brand_guess"), "guess").when(x.rlike("page|about|deep"), "homepage").otherwise(x)
    df = df.withColumns({"full": N.full_name_present(c("company"), c("everything")), "in_told": N.full_name_present(c("company"), c("told")), "in_about": N.full_name_present(c("company"), c("about_text")),
                         "same_ld": (text("deep_json_ld") != "") & (T.identity_key(c("deep_json_ld")) == T.identity_key(c("company"))), "aligned": N.context_aligns(c("context"), c("everything"), c("kind")),
                         "independent": F.size(F.array_remove(F.array_distinct(F.transform("sources", family)), "guess"))})
    pairs = [scoring.pair("fullNameConfirmed", 40, c("full")),
             scoring.pair("descriptionFullName", 28, c("in_told") & has(c("told"), "is an?|private equity|venture capital|company that|headquartered")), scoring.pair("deepAboutConfirm", 22, c("in_about")),
             scoring.pair("stage2JsonLdExact", 20, c("same_ld")), scoring.pair("stage2EntityTypeMatch", 30, c("wants") & (c("kind") == "investment_firm")),
             scoring.pair("stage2EntityTypeMismatch", -40, c("wants") & c("kind").isin("print_services", "store", "product")), scoring.pair("contextIndustryAlign", 35, c("aligned")),
             scoring.pair("stage2Consensus", 30, c("independent") >= 3), scoring.pair("stage2DualSourceFullName", 18, (c("independent") == 2) & c("full"))]
    return df.withColumn("more", F.array_compact(F.array(*pairs)))


#: Signals of the second stage that count as new evidence.
MEANINGFUL = ("fullNameConfirmed", "deepAboutConfirm", "descriptionFullName", "stage2Consensus", "stage2DualSourceFullName", "stage2EntityTypeMatch", "contextIndustryAlign", "stage2JsonLdExact")


def second_stage(decided: DataFrame, scored: DataFrame, evidence: DataFrame) -> DataFrame:
    """Ambiguous companies once more, with what a deeper look has found; all other rows stay as they are.

    ``scored`` are the candidates of ``score_identity``; ``evidence`` has (company_id, host, deep_title, deep_description, deep_text, about_text, deep_json_ld,
    search_snippets, supporting_sources, context). Thresholds are the first stage's. A short common name without context needs its full name and a consensus,
    and no company is resolved without new evidence.
    """
    c = F.col
    # a filter on a decision would otherwise be pushed down into the expressions that make it, each time as a whole
    decided = materialize(decided, "decided")
    again = decided.where("status = 'ambiguous'").select("company_id")
    # few companies get here; their candidates are written once, as they are read three times
    open_ = materialize(scored.join(again, "company_id", "left_semi").join(evidence, ["company_id", "host"], "left"), "ambiguous")
    df = materialize(stage_two_signals(open_), "second-look")
    held = lambda *names: F.exists("more", lambda s: s["signal"].isin(*names))
    df = df.withColumns({"score": c("score") + scoring.total(c("more")), "signals": F.map_concat("signals", scoring.as_map(c("more"))), "entity_type": c("kind"),
                         "authoritative": c("authoritative") + held("stage2Consensus").cast("int") + (held("fullNameConfirmed") & held("deepAboutConfirm")).cast("int"),
                         "fresh": held(*MEANINGFUL), "sure": held("fullNameConfirmed") & (held("stage2Consensus") | F.map_contains_key("signals", F.lit("strongConsensus")) | F.map_contains_key("signals", F.lit("wikidataOfficial")))})
    redone = materialize(selection.select_identity(df.select(*scored.columns), 72), "redone")
    best = df.select("company_id", c("host").alias("domain"), "fresh", "sure", (text("context") == "").alias("bare"))
    redone = redone.join(best, ["company_id", "domain"], "left")
    redone = redone.withColumn("tokens", T.identity_tokens(c("company")))
    short = (c("risk") >= 50) & (F.size("tokens") <= 2) & F.forall("tokens", lambda w: w.isin(*T.COMMON_BRANDS) | (F.length(w) <= 5)) & c("bare")
    blocked = F.when(c("status") != "resolved", None).when(short & ~c("sure"), "stage2_short_name_still_ambiguous").when(~c("fresh"), "stage2_no_new_evidence")
    redone = redone.withColumn("blocked", blocked)
    redone = redone.withColumns({"reason": F.coalesce("blocked", "reason"), "status": F.when(c("blocked").isNotNull(), "ambiguous").otherwise(c("status")),
                                 "confidence": F.when(c("blocked").isNotNull(), "low").otherwise(c("confidence")), "domain": F.when(c("blocked").isNull(), c("domain"))})
    return decided.where("status <> 'ambiguous'").unionByName(redone.select(*decided.columns))


def facts(companies: DataFrame, texts: DataFrame) -> DataFrame:
    """(company_id, kind, seq, source, authority, value, explicit): headquarters, headcounts and founders that texts (company_id, seq, source, text, authority) name."""
    c = F.col
    df = texts.join(companies.select("company_id", "company"), "company_id")
    team = F.contains(F.lower(text("source")), F.lit("team"))
    told = {"hq": X.hq_hits(c("text")), "headcount": X.headcount_hits(c("text"), team), "founders": X.founder_hits(c("text"), c("company"), team)}
    named = lambda kind: lambda h: F.struct(F.lit(kind).alias("kind"), h["value"].alias("value"), h["explicit"].alias("explicit"))
    every = F.concat(*[F.transform(hits, named(kind)) for kind, hits in told.items()])
    rows = df.select("company_id", (c("seq").cast("long") * 1_000_000).alias("base"), "source", "authority", F.posexplode(every).alias("i", "h"))
    return rows.select("company_id", "h.kind", (c("base") + c("i")).alias("seq"), "source", "authority", "h.value", "h.explicit")


def evidence_parts(texts: DataFrame) -> DataFrame:
    """(company_id, parts): a company's texts in order, as far as a classification can reach: those that begin within its characters, and the first that say anything.

    So what is collected for a company is a few times those characters at most, however many texts it has.
    """
    c = F.col
    by_seq = Window.partitionBy("company_id").orderBy("seq")
    # every text takes a character at least, so that many places are enough; Spark cuts to them before it shuffles
    some = texts.select("company_id", "seq", cut(c("text"), industry.WHOLE).alias("text")).withColumn("place", F.row_number().over(by_seq)).where(c("place") <= industry.WHOLE)
    before, says = by_seq.rowsBetween(Window.unboundedPreceding, -1), F.length(F.trim(text("text"))) > 0
    some = some.withColumns({"behind": F.coalesce(F.sum(F.length(text("text")) + 1).over(before), F.lit(0)), "told": F.coalesce(F.count_if(says).over(before), F.lit(0))})
    some = some.where((c("behind") < industry.WHOLE) | (says & (c("told") < industry.PARTS)))
    return some.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda t: t["text"]).alias("parts"))


def enrich_fields(companies: DataFrame, texts: DataFrame) -> DataFrame:
    """(company_id, industry, headquarters, headcount, founders, ...) of resolved companies (company_id, company, domain) and texts (company_id, seq, source, text, authority).

    Facts are drawn from the texts once and written, as they are read for two purposes.
    """
    c = F.col
    found = materialize(facts(companies, texts), "facts")
    fields = S.resolve_fields(companies, found.where("kind <> 'founders'")).select(
        "company_id", c("hq.value").alias("headquarters"), c("hq.unknown_reason").alias("headquarters_reason"), c("headcount.value").alias("headcount"), c("headcount.unknown_reason").alias("headcount_reason"))
    founders = S.score_founders(found.where("kind = 'founders'")).select("company_id", "founders")
    kinds = industry.classify(evidence_parts(texts)).select("company_id", "industry", "industry_confidence")
    out = companies.select("company_id", "company", "domain").join(fields, "company_id", "left").join(founders, "company_id", "left").join(kinds, "company_id", "left")
    return out.withColumns({"founders": F.coalesce("founders", F.lit(T.UNKNOWN)), "industry": F.coalesce("industry", F.lit(T.UNKNOWN))})


def enrich_with_provider(fields: DataFrame, responses: DataFrame) -> DataFrame:
    """Fields with unknown ones filled from validated provider matches; companies without anything unknown are not looked at."""
    names = ("industry", "location", "headcount", "founders")
    open_ = fields.where(F.greatest(*[T.is_blank(F.col(n)).cast("int") for n in names]) > 0).select("company_id")
    return provider.fill_unknown(fields, provider.validate(responses.join(open_, "company_id", "left_semi")), names)


def compound_mismatch(rows: DataFrame) -> DataFrame:
    """Rows (company, domain, industry) whose host only joins the name with more words, or whose kind of entity contradicts the industry."""
    c = F.col
    key, base = T.store_key(c("company")), D.domain_base(c("domain"))
    compound = (F.length(key) >= 4) & base.startswith(key) & (F.length(base) >= F.length(key) + 4)
    kind = has(text("company"), r"\b(university|college|foundation|school)\b") & ~text("industry").isin("Education", "Nonprofit / Foundation", T.UNKNOWN, "")
    return rows.withColumns({"compound_mismatch": compound, "entity_mismatch": kind})
