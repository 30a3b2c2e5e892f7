"""Entity-type guard: an encyclopedia entity's classes decide whether it may be a company; a bounded walk up the class hierarchy
covers classes that are not listed themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import has, text
from ..functions.text import qid
from ..sources.shared import materialize

# --- fixed values: public class ids of organizations, media and everything else -----------------------------------
ORGANIZATION = (
    "Q43229 Q4830453 Q6881511 Q783794 Q167037 Q891723 Q1589009 Q134161 Q219577 Q15042660 Q18624259 Q6832945 Q42262 Q1542714 Q166280 Q15850065 Q117351609 Q728425 Q1341618 Q57653825 Q16726425 "
    "Q22687 Q56859 Q730038 Q2481236 Q161718 Q1947591 Q536518 Q6502418 Q1236912 Q12319666 Q778575 Q15980864 Q1687336 Q1236839 Q592888 Q5152546 Q2143354 Q1637408 Q613142 Q181289 "
    "Q327333 Q2659904 Q35798 Q7188 Q417662 Q16334295 Q11204 Q760074 Q3567216 Q1419105 Q163740 Q157031 Q79913 Q708676 Q4466083 Q48204 Q31855 Q1664720 Q780597 Q210167 Q33506 Q16917 "
    "Q3918 Q38723 Q875538 Q23002054 Q2385804 Q4671277 Q9826 Q189004 Q15936437 Q1371037 Q1321960 Q118865").split()
OTHER = (
    "Q5 Q215627 Q95074 Q15632617 Q22808320 Q532 Q3957 Q515 Q486972 Q56061 Q82794 Q3624078 Q6256 Q23442 Q4022 Q8502 Q23397 Q34763 Q123705 Q5084 Q7930989 Q2221906 Q618123 Q27096213 Q5107 "
    "Q15642541 Q1293220 Q28732711 Q937228 Q3695082 Q318 Q3863 Q523 Q11276 Q24676 Q11862829 Q21201 Q29028649 Q151885 Q331042 Q427581 Q23958852 Q17537576 Q11424 Q24856 Q5398426 Q15416 Q482994 "
    "Q7366 Q2188189 Q7725634 Q47461344 Q571 Q49032 Q1980247 Q7725310 Q13442814 Q191067 Q838948 Q1190554 Q1656682 Q186165 Q198 Q2334719 Q107597582 Q4504495 Q483247 "
    "Q4167410 Q13406463 Q19389637 Q4167836 Q14204246 Q11266439").split()
MEDIA = "Q11032 Q41298 Q1616075 Q2001305 Q15242410 Q15265344 Q4438141 Q16145126 Q2085381 Q11033 Q98924065".split()
MEDIA_WORDS = ("media", "news", "broadcast", "publisher", "publishing", "press", "editorial")
DEPTH = 8
# ----------------------------------------------------------------------------------------------------------------


def ids(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, qid), lambda q: q != ""))


def _among(values: Column, known: list[str]) -> Column:
    return F.filter(values, lambda v: v.isin(*known))


def media_keyword(title: Column) -> Column:
    """The first media word of a contact's title (``press`` as a whole word), or null."""
    low = F.lower(text(title))
    found = F.lit(None).cast("string")
    for word in reversed(MEDIA_WORDS):
        found = F.when(has(low, rf"\b{word}" + (r"\b" if word == "press" else "")), word).otherwise(found)
    return found


def _verdict(org: Column, media: Column, other: Column, context: Column, org_reason: str) -> Column:
    """struct(decision, reason, matched): organizations first, then media, then others; media pass where the contact's title says so."""

    def made(decision: str, reason: str, matched: Column) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), matched.alias("matched"))

    return (F.when(F.size(org) > 0, made("accept", org_reason, org)).when(F.size(other) > 0, made("reject", "p31_non_organization", other))
            .when((F.size(media) > 0) & context, made("accept", "p31_media_with_context", media)).when(F.size(media) > 0, made("reject", "p31_media", media))
            .otherwise(made("allow_unknown", "p31_unlisted", F.lit(None).cast("array<string>"))))


def classify_exact(classes: Column, media_context: Column) -> Column:
    """The decision on the entity's own classes; an entity without any is allowed as unknown."""
    own = ids(F.coalesce(classes, F.array().cast("array<string>")))
    verdict = _verdict(_among(own, ORGANIZATION), _among(own, MEDIA), _among(own, OTHER), F.coalesce(media_context, F.lit(False)), "p31_organization")
    none = F.struct(F.lit("allow_unknown").alias("decision"), F.lit("no_p31").alias("reason"), F.lit(None).cast("array<string>").alias("matched"))
    return F.when(F.size(own) == 0, none).otherwise(verdict)


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """(class, above, depth): every class with those up to ``depth`` (a power of two) levels above it, each at its least depth, itself left out.

    Each step joins the relation with itself, which doubles its reach; so three joins, and not eight, see eight levels, in one plan and without a job for each.
    A hot class above many others meets few above it, and adaptive execution can split its side.
    """
    c = F.col
    near = edges.where("child <> parent").select(c("child").alias("class"), c("parent").alias("above"), F.lit(1).alias("depth")).distinct()
    reach = 1
    while reach < depth:
        farther = near.select("class", c("above").alias("over"), c("depth").alias("d")).join(near.select(c("class").alias("over"), "above", "depth"), "over").where("class <> above")
        near = near.unionAll(farther.select("class", "above", (c("d") + c("depth")).cast("int"))).groupBy("class", "above").agg(F.min("depth").alias("depth"))
        reach *= 2
    return near


def walk(starts: DataFrame, edges: DataFrame, known: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """(start, class, depth): for every start the classes above it, each at its least depth, up to ``depth``; cycles come back to no start.

    A start's walk ends at the first level that holds a class of ``known`` (class). It goes by half the depth twice: the relation of all classes to those half as
    high is made once and only the starts are carried on from there.
    """
    c = F.col
    # stored, as both steps read it, and its edges' own sources are read once
    half = materialize(closure(materialize(edges.select("child", "parent").distinct(), "classes"), 1 << max(0, (depth - 1).bit_length() - 1)), "closure")
    first = starts.select(c("class").alias("start")).distinct().join(half.withColumnRenamed("class", "start"), "start")
    second = first.select("start", c("above").alias("class"), c("depth").alias("d")).join(half, "class").where("start <> above").select("start", "above", (c("d") + c("depth")).cast("int").alias("depth"))
    every = first.select("start", "above", "depth").unionAll(second).groupBy("start", c("above").alias("class")).agg(F.min("depth").alias("depth")).where(c("depth") <= depth)
    if known is None:
        return every
    # the level at which a start's walk ends goes along with its rows: one more aggregate, no second look at the relation
    listed = every.join(known.select("class", F.lit(True).alias("listed")).dropDuplicates(["class"]), "class", "left")
    level = F.min(F.when(c("listed"), c("depth"))).over(Window.partitionBy("start"))
    return listed.withColumn("end", level).where("end IS NULL OR depth <= end").select("start", "class", "depth")


def known_classes(spark) -> DataFrame:
    """(class, kind) of all listed classes."""
    rows = [(q, "org") for q in ORGANIZATION] + [(q, "media") for q in MEDIA] + [(q, "reject") for q in OTHER]
    return spark.createDataFrame(rows, "class string, kind string").dropDuplicates(["class"])


def classify(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``decision, reason, matched, via, subclass_depth`` to entities (entity_id, classes, media_context, failed).

    The entity's own classes decide if any is listed; else the nearest listed class above any of them. ``failed`` lookups are ``retry_needed``.
    """
    spark = entities.sparkSession
    c = F.col
    df = entities.withColumn("exact", classify_exact(c("classes"), c("media_context")))
    open_ = df.where(c("exact.reason") == "p31_unlisted").select("entity_id", F.explode(ids(c("classes"))).alias("start"))
    listed = known_classes(spark)
    above = walk(open_.select(c("start").alias("class")), edges, listed).join(F.broadcast(listed), "class")  # the list has under 200 rows
    hits = open_.join(above, "start").groupBy("entity_id", "depth", "kind").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    near = hits.groupBy("entity_id").agg(F.min("depth").alias("subclass_depth"), F.collect_list(F.struct("depth", "kind", "classes")).alias("all"))

    def of(kind: str) -> Column:
        return F.coalesce(F.get(F.filter("all", lambda h: (h["depth"] == c("subclass_depth")) & (h["kind"] == kind)), F.lit(0))["classes"], F.array().cast("array<string>"))

    near = near.select("entity_id", "subclass_depth", of("org").alias("org"), of("media").alias("media"), of("reject").alias("other"))
    df = df.join(near, "entity_id", "left")
    df = df.withColumn("walked", F.when(c("subclass_depth").isNotNull(), _verdict(c("org"), c("media"), c("other"), F.coalesce(c("media_context"), F.lit(False)), "p31_org_subclass")))
    got = F.coalesce(c("walked"), c("exact"))
    failed = F.coalesce(c("failed"), F.lit(False)) if "failed" in entities.columns else F.lit(False)
    via = F.when(c("exact.reason") == "no_p31", "empty_p31").when(c("exact.reason") == "p31_unlisted", "subclass").otherwise("exact")
    return df.select(*entities.columns, F.when(failed, "retry_needed").otherwise(got["decision"]).alias("decision"), F.when(failed, "transient").otherwise(got["reason"]).alias("reason"),
                     F.when(~failed, got["matched"]).alias("matched"), F.when(~failed, via).alias("via"), F.when(~failed, c("subclass_depth")).alias("subclass_depth"))


def describe(decision: Column, reason: Column, matched: Column, via: Column, keyword: Column) -> Column:
    """One line on a decision."""
    listed = F.array_join(matched, ", ")
    below = F.when(via == "subclass", " (via subclass)").otherwise("")
    return (F.when(decision.isNull(), "allow_unknown — missing classification").when(decision == "retry_needed", F.concat(F.lit("retry_needed — "), F.when(reason == "rate_limited", "rate limited").otherwise(reason)))
            .when(reason == "p31_media_with_context", F.concat(F.lit("accept — media class with contact-title keyword: "), F.coalesce(keyword, F.lit("matched"))))
            .when(decision == "accept", F.concat(F.lit("accept — org class matched: "), listed, below)).when(reason == "no_p31", "allow_unknown — empty P31")
            .when(decision == "allow_unknown", F.concat(F.lit("allow_unknown — unlisted legal form: "), F.coalesce(listed, F.lit("")))).otherwise(F.concat(F.lit("reject — "), listed, F.lit(" is a reject class"), below)))


def lookup_status(http_status: Column) -> Column:
    """What a lookup's HTTP status means: ok, rate_limited and transient (both to be tried again), or http."""
    return (F.when(http_status.between(200, 299), "ok").when(http_status == 429, "rate_limited").when(http_status.isNull() | (http_status == 0) | (http_status >= 500), "transient").otherwise("http"))
