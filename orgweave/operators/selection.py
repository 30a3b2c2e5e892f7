"""Selection: ranked candidates to one decision per company, with explicit abstention.

Decisions that look at several candidates of a company take them as one sorted array per company (a pool has a few dozen at most, it is
cut to ``POOL`` by rank before it is collected), and each rule is a filter on that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import text as T
from ..functions.regex import half_up, has, text
from .scoring import INVESTMENT_NAME, closeness_tier, finance_affinity, is_junk_candidate, name_closeness, name_domain_similarity

# --- fixed values -----------------------------------------------------------------------------------------------
RESOLVE_MIN, MARGIN, NEAR = 70, 18, 25
CONFIDENT, AUTO_FOUND, AMBIGUITY_GAP = 70, 80, 12
TRUSTED_TLDS = ("com", "org", "net", "io", "ai", "co", "app", "dev", "so", "capital", "vc", "edu", "gov")
DECISIVE_TLDS = ("com", "org", "net", "edu", "gov", "io", "co", "ai", "us", "uk", "capital", "fund", "finance", "ventures", "investments", "com.au", "co.uk", "org.uk")
COMMON_TLDS = ("com", "org", "edu", "gov", "net", "io", "co", "ai", "us", "uk", "health", "tech", "bio", "com.au", "co.uk", "org.uk", "co.nz", "com.br", "co.za")
COUNTRIES = r"\b(australia|austria|brazil|canada|china|france|germany|india|ireland|israel|italy|japan|korea|mexico|netherlands|poland|singapore|spain|sweden|switzerland|uk|britain|england)\b"
#: The most candidates of a company that any rule can reach; lower ranks never win.
POOL = 64
# ----------------------------------------------------------------------------------------------------------------


def ranked(candidates: DataFrame, score: str = "score", k: int | None = None) -> DataFrame:
    """Add ``rank`` within a company: by score, then by the order of appearance; the best ``k`` only, if given."""
    w = Window.partitionBy("company_id").orderBy(F.desc(score), "seq")
    out = candidates.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def _by_rank(row: Column) -> Column:
    """A group's rows as an array in the order of their rank; maps in them can't be compared, so only the rank is."""
    return F.array_sort(F.collect_list(row), lambda a, b: a["rank"] - b["rank"])


def close_race(candidates: DataFrame, gap: int = 15, floor: int = 40) -> DataFrame:
    """The first-generation decision: (company_id, domain, score, runner_up, verification). Close or weak leads need a look."""
    w = Window.partitionBy("company_id").orderBy(F.desc("score"), "seq")
    top = candidates.withColumns({"rank": F.row_number().over(w), "runner_up": F.lead("score").over(w)}).where("rank = 1")
    close = (F.col("score") - F.col("runner_up") < gap) & (F.col("runner_up") >= floor)
    return top.select("company_id", "domain", "score", "runner_up",
                      F.when(F.coalesce(close, F.lit(False)), "unverified").when(F.col("score") >= 75, "verified").when(F.col("score") >= 45, "unverified").otherwise("not_found").alias("verification"))


def select_identity(scored: DataFrame, resolve_min: int = RESOLVE_MIN, margin: int = MARGIN) -> DataFrame:
    """(company_id, company, status, domain, confidence, score, reason, resolve_min, risk, candidates) of the candidates of ``score_identity``.

    Starting from the best score, six rules may pick another candidate; then thresholds, the margin to the next one and six grounds for
    abstention decide. ``candidates`` are the best six hosts and scores. Write the result before filtering on a decision: the
    optimizer would push the filter down into the expressions that make it.
    """
    c = F.col
    pool = ranked(scored.where(~D.is_junk_host(c("host")) & (c("host") != "")), k=POOL)
    packed = F.struct("rank", "host", "score", "host_core", "token_coverage", "authoritative", "entity_type", "signals")
    df = pool.groupBy("company_id").agg(_by_rank(packed).alias("r"))
    everyone = scored.groupBy("company_id").agg(F.min("company").alias("company"), F.count("*").alias("n"))
    df = everyone.join(df.select("company_id", "r"), "company_id", "left")
    df = df.withColumns({"key": T.identity_key(c("company")), "tokens": T.identity_tokens(c("company")), "risk": T.ambiguity_risk(c("company"), c("n"))})
    df = df.withColumns({"least": F.lit(resolve_min) + half_up(c("risk") / 5).cast("int"), "pick": F.get("r", F.lit(0))})
    df = df.withColumn("floor", F.least(c("least") - NEAR, F.lit(40)))

    def sig(x: Column, *names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | F.coalesce(F.try_element_at(x["signals"], F.lit(n)) != 0, F.lit(False))
        return out

    def seek(when) -> Column:
        return F.get(F.filter("r", when), F.lit(0))

    def repick(df: DataFrame, found: Column, ok) -> DataFrame:
        df = df.withColumn("other", found)
        return df.withColumn("pick", F.when(F.coalesce(ok(c("other"), c("pick")), F.lit(False)), c("other")).otherwise(c("pick")))

    key, pick = c("key"), c("pick")
    noisy = ("brandSuffixNoise", "commerce_tld", "tldShop", "affiliate_host_token", "property_subdomain", "non_apex_host", "investor_relations")
    df = repick(df, seek(lambda x: (x["host_core"] == key) | sig(x, "domainExactKey")),
                lambda o, p: (o["host"] != p["host"]) & (sig(p, *noisy) | (p["score"] - o["score"] <= 35)))
    below = sig(pick, "property_subdomain", "non_apex_host")
    df = repick(df, seek(lambda x: (x["host"] != pick["host"]) & (pick["host"].endswith(F.concat(F.lit("."), x["host"])) | (sig(x, "domainExactKey") & below))),
                lambda o, p: sig(p, "property_subdomain", "non_apex_host") | (p["score"] - o["score"] <= 40))
    df = repick(df, seek(lambda x: (x["host_core"] == key) & x["host"].endswith(".com")),
                lambda o, p: (key != "") & (p["host_core"] == key) & (o["host"] != p["host"]) & (D.tld(p["host"]) != "com") & (o["score"] >= c("floor")))
    df = repick(df, seek(lambda x: (x["host"] != pick["host"]) & ((x["host_core"] == pick["host_core"]) | (x["host_core"] == key)) & D.tld(x["host"]).isin(*TRUSTED_TLDS) & (x["score"] >= c("floor"))),
                lambda o, p: o.isNotNull() & ~D.tld(p["host"]).isin(*TRUSTED_TLDS))
    df = repick(df, seek(lambda x: (x["token_coverage"] >= 0.75) & (pick["token_coverage"] < 0.6) & (pick["score"] - x["score"] <= 40)), lambda o, p: (F.size("tokens") >= 2) & o.isNotNull())
    df = df.withColumn("com", seek(lambda x: (x["host_core"] == key) & x["host"].endswith(".com")))
    spoken = F.exists(F.map_keys(c("com")["signals"]), lambda k: has(k, r"venture|private equity|investment firm"))
    df = repick(df, seek(lambda x: sig(x, "investTokenTldBoost")),
                lambda o, p: has(text("company"), INVESTMENT_NAME) & o.isNotNull() & c("com").isNotNull() & ~sig(c("com"), "entityTypeMatch") & ~spoken & sig(o, "entityTypeMatch"))
    df = df.withColumn("rival", seek(lambda x: x["host"] != pick["host"]))

    def strong_count(p: Column) -> Column:
        singles = [sig(p, n).cast("int") for n in ("wikidataOfficial", "strongConsensus", "multiSourceConsensus", "jsonLdMatch", "aboutLanguage")]
        return sum(singles, (sig(p, "domainExactKey") & sig(p, "titleMentionsCompany")).cast("int") + (p["authoritative"] >= 2).cast("int"))

    df = df.withColumn("strong", strong_count(pick))
    authority = (pick["authoritative"] >= 1) | sig(pick, "wikidataOfficial", "strongConsensus") | sig(pick, "domainExactKey")
    rival_noisy = sig(c("rival"), "brandSuffixNoise", "tldShop", "commerce_tld", "genericBrandOnlyDomain", "entityTypeMismatch", "incompleteEntityName")
    tight = F.coalesce(pick["score"] - c("rival")["score"] < margin, F.lit(False)) & ~(authority & rival_noisy)
    high = (c("strong") >= 2) | (sig(pick, "wikidataOfficial") & sig(pick, "homepageHeadMention"))
    medium = (pick["score"] >= c("least") + 15) & ((pick["authoritative"] >= 1) | sig(pick, "domainExactKey"))
    common = lambda: F.forall("tokens", lambda w: w.isin(*T.COMMON_BRANDS))
    lookalike = sig(pick, "print_brand", "store_purpose") | pick["entity_type"].isin("print_services", "store", "product")
    authoritative = sig(pick, "wikidataOfficial", "strongConsensus") | (pick["authoritative"] >= 2)
    generic = ((c("risk") >= 40) & (F.size("tokens") == 2) & common() & (pick["host_core"] == key) & pick["host"].endswith(".com") & ~sig(pick, "entityTypeMatch", "wikidataOfficial")
               & (F.exists("r", lambda x: (x["host"] != pick["host"]) & sig(x, "tokenAsTldMatch")) | ~sig(pick, "aboutLanguage")))
    reason = (F.when(pick.isNull(), "no_candidates").when(pick["score"] < c("least"), "below_resolve_threshold").when(tight, "insufficient_margin")
              .when(~high & ~medium & (c("risk") >= 50) & (c("strong") == 0) & ~sig(pick, "domainExactKey"), "high_ambiguity_weak_evidence")
              .when(high & sig(pick, "tldShop", "store_purpose", "brandSuffixNoise"), "affiliate_conflict")
              .when((F.size("tokens") == 1) & common() & (lookalike | ~authoritative), "short_common_name_ambiguous").when(generic, "generic_name_com_lookalike").otherwise("selected"))
    df = df.withColumn("reason", reason)
    weak = (c("reason") == "no_candidates") | ((c("reason") == "below_resolve_threshold") & (pick["score"] < c("least") - NEAR))
    return df.select("company_id", "company", F.when(c("reason") == "selected", "resolved").when(weak, "unresolved").otherwise("ambiguous").alias("status"),
                     F.when(c("reason") == "selected", pick["host"]).alias("domain"), F.when(c("reason") != "selected", "low").when(high, "high").otherwise("medium").alias("confidence"),
                     F.coalesce(pick["score"], F.lit(0)).alias("score"), "reason", c("least").alias("resolve_min"), "risk",
                     F.transform(F.slice("r", 1, 6), lambda x: F.struct(x["host"].alias("domain"), x["score"].alias("score"))).alias("candidates"))


def diagnose(scored: DataFrame) -> DataFrame:
    """(company_id, margin, top, plus, minus): the lead over the next candidate, the best eight hosts, and the best one's signals for and against."""
    w = Window.partitionBy("company_id").orderBy(F.desc("score"), "seq")
    placed = scored.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)}).where("rank <= 8")
    tops = placed.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "host"))), lambda x: x["host"]).alias("top"),
                                            F.min(F.struct("rank", (F.col("score") - F.col("next")).alias("margin"), F.array_sort(F.map_entries("signals")).alias("signals"))).alias("best"))
    signs = F.map_from_entries(F.col("best.signals"))
    return tops.select("company_id", F.col("best.margin").alias("margin"), "top", F.map_filter(signs, lambda _, v: v > 0).alias("plus"), F.map_filter(signs, lambda _, v: v < 0).alias("minus"))


def rank_pool(pool: DataFrame, finance_filter: bool = False) -> DataFrame:
    """Rank merged candidates (company_id, company, seq, domain, name, snippet, sources, prominence, dns_ok) by the second generation's score.

    Adds ``similarity, exact_name, affinity, wiki_points, source_points, finance_points, dns_points, total_score, rank``. Liveness counts for the
    first five only, as those are the ones that are looked up.
    """
    c = F.col
    sim = name_domain_similarity(c("company"), c("domain"), c("name"))
    df = pool.withColumns({"sim": sim, "affinity": finance_affinity(c("domain"), c("name"), c("snippet"))})
    df = df.withColumns({"similarity": c("sim.score"), "exact_name": c("sim.exact_name")}).drop("sim")
    within = Window.partitionBy("company_id")
    in_ = lambda *names: F.arrays_overlap("sources", F.array(*map(F.lit, names)))
    df = df.withColumns({
        "wiki_points": F.when(c("prominence") > 0, F.least(F.lit(25), half_up(c("prominence") / 4))).when(in_("wikidata", "wikipedia"), 12).otherwise(0).cast("int"),
        "source_points": (F.when(in_("autocomplete") & c("exact_name"), 8).otherwise(0) + F.when(in_("instant_answer"), 5).otherwise(0) + F.when(in_("wikidata", "wikipedia"), 6).otherwise(0)
                          + F.when(in_("dictionary", "major_firm", "dict_seed"), 40).otherwise(0) + F.when(F.size("sources") >= 2, 6).otherwise(0)),
        "any_finance": F.max((c("affinity") == "finance").cast("int")).over(within)})
    df = df.withColumn("finance_points", F.when(F.lit(finance_filter) & (c("affinity") == "finance"), 34).when(
        F.lit(finance_filter) & (c("affinity") == "unrelated") & (c("any_finance") == 1), -30).otherwise(0))
    df = df.withColumn("total_score", c("similarity") + c("wiki_points") + c("source_points") + c("finance_points"))
    first = F.row_number().over(within.orderBy(F.desc("total_score"), "seq"))
    live = F.when(c("dns_ok"), F.when(c("exact_name") | (c("similarity") >= 35), 23).otherwise(15)).otherwise(-20)
    df = df.withColumn("place", first)
    df = df.withColumn("dns_points", F.when((c("place") <= 5) & c("dns_ok").isNotNull(), live).otherwise(0))
    df = df.withColumn("total_score", c("total_score") + c("dns_points"))
    return df.withColumn("rank", F.row_number().over(within.orderBy(F.desc("total_score"), "place"))).drop("place", "any_finance")


def decide_pool(ranked_pool: DataFrame, finance_filter: bool = False) -> DataFrame:
    """(company_id, company, domain, score, ambiguous, sole_finance, decisive_rule, auto_found, status) of a ranked pool."""
    c = F.col
    df = ranked_pool.where(c("rank") <= POOL)
    close = name_closeness(c("company"), c("domain"), c("name"))
    mention = c("content_mention") if "content_mention" in df.columns else F.lit(None).cast("boolean")
    df = df.withColumn("close", close)
    df = df.withColumns({"closeness": c("close.score"), "dead": F.coalesce(~c("dns_ok"), F.lit(False))})
    df = df.withColumn("junk", is_junk_candidate(c("domain"), c("closeness"), c("dns_ok"), mention))
    packed = F.struct("rank", "domain", c("total_score").alias("score"), "exact_name", "similarity", "affinity", "closeness", "junk", "dead", "source_points", "finance_points", "sources")
    df = df.groupBy("company_id").agg(F.first("company").alias("company"), _by_rank(packed).alias("r"))
    df = df.withColumn("live", F.filter("r", lambda x: ~x["dead"]))
    df = df.withColumn("k", F.when(F.size("live") > 0, c("live")).otherwise(c("r")))
    df = df.withColumns({"best": F.get("k", F.lit(0)), "others": F.slice("k", F.lit(2), F.greatest(F.size("k") - 1, F.lit(0)))})
    best, run = c("best"), F.get("others", F.lit(0))
    rivals = F.filter("others", lambda x: (x["affinity"] == "finance") & (F.abs(x["score"] - best["score"]) < AMBIGUITY_GAP + 8) & (x["score"] >= CONFIDENT - 20))
    is_finance = F.lit(finance_filter) & (best["affinity"] == "finance")
    near = F.coalesce(~best["exact_name"] & (F.abs(best["score"] - run["score"]) < AMBIGUITY_GAP) & (run["score"] >= CONFIDENT - 15), F.lit(False))
    df = df.withColumn("sole_finance", is_finance & (F.size(rivals) == 0))
    df = df.withColumn("ambiguous", near & ~c("sole_finance") & ~(is_finance & F.coalesce(run["affinity"] == "unrelated", F.lit(False))))
    lifted = F.when(c("sole_finance") & best["score"].between(CONFIDENT, AUTO_FOUND - 1), AUTO_FOUND).otherwise(best["score"])
    df = df.withColumn("score", lifted)
    weak_run = run.isNull() | (run["score"] < CONFIDENT - 15) | (c("score") - run["score"] >= 18)
    df = df.withColumn("dominant", ~c("ambiguous") & (c("score") >= CONFIDENT) & weak_run)
    df = df.withColumn("score", c("score") + F.when(c("dominant"), 6).otherwise(0))
    legit = F.filter("others", lambda x: ~x["junk"])
    tier = closeness_tier(best["closeness"])
    allowed = D.decisive_tld(best["domain"]).isin(*DECISIVE_TLDS) | has(text("company"), COUNTRIES)
    may = ~best["junk"] & ~best["dead"] & allowed & ~((F.size(T.decisive_forms(c("company"))["tokens"]) <= 1) & F.lit(finance_filter) & (best["affinity"] != "finance"))
    by_name = (tier >= 2) & (c("score") >= CONFIDENT - 12) & ~F.exists(legit, lambda x: (closeness_tier(x["closeness"]) >= tier) & ~D.is_regional_sibling(x["domain"], best["domain"]))
    by_context = (F.lit(finance_filter) & (F.size(legit) > 0) & (best["closeness"] >= 40) & (c("score") >= CONFIDENT - 12) & (best["affinity"] == "finance")
                  & ~F.exists(legit, lambda x: x["affinity"] != "unrelated"))
    sole = (F.size("others") > 0) & (F.size(legit) == 0) & (best["closeness"] >= 40) & (c("score") >= CONFIDENT - 15)
    df = df.withColumn("decisive_rule", F.when(may & by_name, "name-match").when(may & by_context, "context-match").when(may & sole, "sole-legit"))
    df = df.withColumn("ambiguous", c("ambiguous") & c("decisive_rule").isNull())
    df = df.withColumn("confidence", F.when(((c("score") >= CONFIDENT) & ~c("ambiguous")) | c("decisive_rule").isNotNull(), "high").otherwise("low"))
    return df.select("company_id", "company", best["domain"].alias("domain"), "score", "ambiguous", "sole_finance", "decisive_rule", "confidence",
                     _auto_found(best, finance_filter).alias("auto_found")).withColumn(
        "status", F.when(c("auto_found"), "found").when((c("score") >= CONFIDENT) | (c("confidence") == "high") | c("domain").isNotNull(), "potential").otherwise("unverified"))


def _auto_found(best: Column, finance_filter: bool) -> Column:
    c = F.col
    curated = F.arrays_overlap(best["sources"], F.array(F.lit("major_firm"), F.lit("dictionary"), F.lit("learned")))
    tld = D.decisive_tld(best["domain"])
    finance_tld = tld.isin("capital", "fund", "finance", "ventures", "investments") & (best["finance_points"] > 0) & best["exact_name"]
    backed = best["exact_name"] | (best["similarity"] >= 40) | (best["finance_points"] > 0) | c("sole_finance") | (best["source_points"] >= 11) | c("dominant")
    return (F.when(best["domain"].isNull() | c("ambiguous"), False).when(curated & (c("score") >= 90), True).when(c("decisive_rule").isNotNull(), True)
            .when(F.lit(finance_filter) & c("sole_finance") & (c("score") >= CONFIDENT) & (c("confidence") == "high"), True)
            .when((c("score") < AUTO_FOUND) | (c("confidence") != "high"), False).when(c("score") >= 90, True).otherwise((tld.isin(*COMMON_TLDS) | finance_tld) & backed))
