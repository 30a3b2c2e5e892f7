"""The matcher against Spark's own expressions, stores that grow, edited rows run again, closures, rare grams and hosts."""

from __future__ import annotations

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from orgweave import queries as Q
from orgweave.functions import extract as X
from orgweave.functions import scan
from orgweave.functions.regex import rx
from orgweave.operators import candidates as C
from orgweave.operators import guard as G
from orgweave.plans import refresh, resolve
from orgweave.sources import store, writers

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# one-pass matcher --------------------------------------------------------------------------------------------------------

PROSE = ["Acme is headquartered in Paris, TX. HQ: Austin, Texas and based in São Paulo, Brazil.", "It employs about 1,200 people, 300–400 employees; company size: 50-100.", "Founded by Ann Lee and Bob Ray. Cy Dee is a founder. Founders: Eve Fox; Gil Hay\nIda Jay, Co-Founder",
         None, "", "ÉMPLOYS 5 \U0001F600 employees here", "headquarters in Rome, Italy", "nothing at all", "Zoë Founder", "x" * 5000 + " based in Oslo, Norway"]


@pytest.mark.parametrize("patterns, needs, ignore_case", [(X.HQ_PATTERNS, X.HQ_NEEDS, True), (X.HEADCOUNT_PATTERNS, X.HEADCOUNT_NEEDS, True), (X.FOUNDER_PATTERNS, X.FOUNDER_NEEDS, False), (X.FOUNDER_LINE, X.LINE_NEEDS, True), (X.PERSON_PATTERNS, (), False)])
def test_one_pass_finds_what_the_expressions_find(spark, patterns, needs, ignore_case):
    texts = list(PROSE)
    if os.path.isdir(SF):
        docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
        texts += docs + [f"{d[:k * 7]} {PROSE[k % 3]} {d[k * 7:]}" for k, d in enumerate(docs)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    rows = df.select("id", scan.scanned(F.col("t"), patterns, 30, 20, ignore_case, needs).alias("a"), X.matches(F.col("t"), patterns, 30, 20, ignore_case).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(len(r["a"]) for r in rows) > 0


def test_table_of_hits(spark):
    df = spark.createDataFrame([(1, "ab12 cd3", "x"), (2, None, "y"), (3, "", "z"), (None, "7", "n")], "id long, t string, pattern string")
    got = scan.regex_hits(df.withColumnRenamed("pattern", "other"), {"n": r"\d+", "w": r"\b([a-z])([a-z])?"}, ["id", "other"], "t", 2, 1)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "x", "n", 1, 2, "12", [], "ab12 "), (1, "x", "n", 2, 7, "3", [], "cd3"), (1, "x", "w", 1, 0, "ab", ["a", "b"], "ab1"), (1, "x", "w", 2, 5, "cd", ["c", "d"], "2 cd3"), (None, "n", "n", 1, 0, "7", [], "7")]))
    assert scan.compiled(r"[\s,]\b\x{2013}").pattern.count("–") == 1 and re.compile(scan.compiled(r"\d", False)).flags & re.IGNORECASE == 0 and rx(r"\s").startswith("(?i)[")


# containment and hosts ---------------------------------------------------------------------------------------------------

def test_rare_grams_find_every_containment(spark):
    keys = [f"customer{i:06}" for i in range(300)] + ["abcd", "xabcdx", "abc", "aaaa", "aaaaaaaa", "zzzzz"]
    outer = [f"thecustomer{i:06}inc" for i in range(0, 300, 7)] + ["abcd", "aaaaa", "customer00000", "qq"]
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "key string")
    got = {tuple(r) for r in C.contained_keys(frame(keys), frame(outer)).collect()}
    assert got == {(k, o) for k in keys for o in outer if len(k) >= 4 and k in o}
    back = {tuple(r) for r in C.contained_keys(frame(outer), frame(keys)).collect()}
    assert back == {(o, k) for k in keys for o in outer if len(o) >= 4 and o in k}


def test_no_gram_that_all_keys_share_is_joined_on(spark):
    c = F.col
    outer = spark.createDataFrame([(f"customer{i:06}",) for i in range(400)], "key string")
    inner = spark.createDataFrame([(f"mer{i:06}",) for i in range(400)], "key string")
    often = outer.select(F.explode(C._grams(c("key"), 4)).alias("gram")).groupBy("gram").count()
    rarest = inner.select("key", F.explode(C._grams(c("key"), 4)).alias("gram")).join(often, "gram").groupBy("key").agg(F.min("count").alias("n"))
    most, mean = rarest.agg(F.max("n"), F.avg("n")).first()  # every key holds "mer0"; one of its gram of digits is in a quarter of them at most
    assert most <= 100 and mean < 30 and C.contained_keys(inner, outer).count() == 400


def test_hosts_and_snippets(spark):
    host = lambda *values: spark.createDataFrame([(v,) for v in values], "host string")
    a, b = ["a.example.com", "example.com", "x.org", "com", "", None], ["example.com", "b.a.example.com", "notexample.com", "org", "x.org"]
    got = {tuple(r) for r in C.related_hosts(host(*a), host(*b)).collect()}
    assert got == {(x, y) for x in a for y in b if x and "." in x and "." in y and (x.endswith(y) or y.endswith(x))}
    cands = spark.createDataFrame([(1, "Acme Robotics", "acme.com"), (1, "Acme Robotics", "other.org"), (2, "Zed", "zed.io")], "company_id int, company string, domain string")
    hits = spark.createDataFrame([(1, 0, "https://www.acme.com/x", "T0", "first"), (1, 1, "blog.acme.com", "second", None), (1, 2, "news.net", "On Acme-Robotics", "named"), (1, 3, "news.net", "none", "none"), (2, 0, None, "t", "")], "company_id int, seq int, host string, title string, snippet string")
    got = {(r["company_id"], r["domain"]): r["search_snippets"] for r in C.search_snippets(cands, hits).collect()}
    assert got == {(1, "acme.com"): "first · second · named", (1, "other.org"): "named"}


# closure -------------------------------------------------------------------------------------------------------------------

def test_closure_by_doubling_is_the_walk(spark):
    import random

    rnd = random.Random(4)
    edges = {(f"c{rnd.randrange(60)}", f"c{rnd.randrange(60)}") for _ in range(90)} | {("n0", "n1"), *((f"n{i}", f"n{i + 1}") for i in range(1, 12)), ("loop", "loop"), ("loop", "n9")}
    starts = [f"c{i}" for i in range(0, 60, 3)] + ["n0", "n3", "loop", "nowhere"]
    up: dict = {}
    for child, parent in edges:
        up.setdefault(child, set()).add(parent)

    def by_hand(known):
        out = set()
        for s in starts:
            seen, front = {s}, {s}
            for level in range(1, 9):
                front = {p for x in front for p in up.get(x, ())} - seen
                seen |= front
                out |= {(s, x, level) for x in front}
                if front & known:
                    break
        return out

    one = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    rel = spark.createDataFrame(list(edges) * 2, "child string, parent string")
    assert {tuple(r) for r in G.walk(one(starts, "class"), rel).collect()} == by_hand(set())
    known = {"c5", "c17", "n4", "n9"}
    assert {tuple(r) for r in G.walk(one(starts, "class"), rel, one([*known, "c5"], "class")).collect()} == by_hand(known)
    assert not {r["class"] for r in G.walk(one(["n0"], "class"), rel).collect()} & {"n9", "n10"}


# stores ----------------------------------------------------------------------------------------------------------------------

def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path, at = str(tmp_path / "s"), lambda d: dt.datetime(2024, 1, d)
    rows = lambda *values: spark.createDataFrame(list(values), "k string, v int, t timestamp")
    first = store.merge(spark, rows(*((f"k{i}", i, at(1)) for i in range(200))), path, "k", "t", 16)
    before = {r["bucket"]: r["folder"] for r in store._manifest(spark, path)}
    assert first == list(range(16)) == sorted(before)
    touched = store.merge(spark, rows(("k3", 33, at(2)), ("k3", 30, at(1)), ("k4", -4, None), (None, 1, at(1))), path, "k", "t")
    after = {r["bucket"]: r["folder"] for r in store._manifest(spark, path)}
    assert 2 <= len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} == set(touched)
    got = {r["k"]: r["v"] for r in store.read(spark, path).collect()}
    assert got == {f"k{i}": i for i in range(200)} | {"k3": 33, None: 1}
    assert {r["k"]: r["v"] for r in store.read(spark, path, number=1).collect()}["k3"] == 3  # a reader of the earlier manifest sees what was
    wider = spark.createDataFrame([("k9", 99, at(3), "new")], "k string, v int, t timestamp, more string")
    store.merge(spark, wider, path, "k", "t")
    assert store.read(spark, path).where("more = 'new'").count() == 1 and store.read(spark, path).count() == 201
    assert store.merge(spark, rows().limit(0), path, "k", "t") == [] and store._manifests(spark, path) == [1, 2, 3]
    assert store.vacuum(spark, path, 1) > 0 and store._manifests(spark, path) == [3] and store.read(spark, path).count() == 201
    with pytest.raises(ValueError):
        store.merge(spark, rows(("a", 1, at(1))), path, "v", "t")
    with pytest.raises(FileNotFoundError):
        store.read(spark, str(tmp_path / "none"))


def test_a_half_written_change_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    store.merge(spark, spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1))], "k string, v int, t timestamp"), path, "k", "t", 4)
    os.makedirs(f"{path}/manifests/2")
    with open(f"{path}/manifests/2/part-0.json", "w") as f:
        f.write('{"bucket":0,"folder":"nowhere"}')
    assert store.read(spark, path).count() == 1


def test_cache_keeps_the_newest_answers(spark, tmp_path):
    path = str(tmp_path / "cache")
    old = spark.createDataFrame([("a.com", dt.datetime(2020, 1, 1), "provider", "old")], "domain string, fetched_at timestamp, source string, company string")
    answers = lambda *v: spark.createDataFrame(list(v), "domain string, company string")
    writers.write_cache(spark, old, answers(("www.b.com", "b")), path, F.lit("2024-01-01").cast("timestamp"))
    writers.write_cache(spark, None, answers(("a.com", "new")), path, F.lit("2024-02-01").cast("timestamp"))
    assert {r["domain"]: r["company"] for r in writers.read_store(spark, path).collect()} == {"a.com": "new", "b.com": "b"}


# edited rows -----------------------------------------------------------------------------------------------------------------

def test_refresh_equals_a_full_run(spark, tmp_path):
    company = [(i, f"Brand{i} Robotics") for i in range(40)]
    pool = [(i, k, d, f"Brand{i}", s, None) for i, _ in company for k, (d, s) in enumerate([(f"brand{i}robotics.com", "autocomplete"), (f"shop{i % 5}.example.com", "search")])]
    page = lambda i, name: (i, f"https://brand{i}robotics.com/", f"<html><head><title>{name} | Official Site</title></head><body><h1>{name}</h1><p>{name} builds robots</p></body></html>")
    frames = lambda c, p, g: (spark.createDataFrame(c, "company_id int, company string"), spark.createDataFrame(p, "company_id int, seq int, domain string, name string, source string, snippet string"), spark.createDataFrame(g, "page_id int, url string, html string"))
    pages = [page(i, f"Brand{i} Robotics") for i in range(30)]
    path, shown = str(tmp_path / "d"), ["company_id", "status", "domain", "confidence", "reason"]
    companies, candidates, sites = frames(company, pool, pages)
    everyone = companies.select("company_id")
    refresh.refresh_identities(spark, path, companies, candidates, sites, everyone, F.lit("2024-01-01").cast("timestamp"))
    edited = [(i, "Quite Another Name") if i == 7 else (i, n) for i, n in company if i != 9]
    changed = [page(3, "Something Else")] + [p for p in pages if p[0] != 3]
    companies, candidates, sites = frames(edited, pool, changed)
    entities = spark.createDataFrame([(20, ["Q1", "Q2"]), (21, ["Q3"])], "company_id int, classes array<string>")
    affected = refresh.affected_companies(candidates, spark.createDataFrame([(7,), (9,)], "company_id int"), spark.createDataFrame([("https://www.brand3robotics.com/about",), (None,)], "url string"), spark.createDataFrame([("Q2",)], "class string"), entities)
    assert sorted(r[0] for r in affected.collect()) == [3, 7, 9, 20]
    touched = refresh.refresh_identities(spark, path, companies, candidates, sites, affected, F.lit("2024-02-01").cast("timestamp"))
    got = {r["company_id"]: tuple(r) for r in store.read(spark, path).select(*shown).collect()}
    full = {r["company_id"]: tuple(r) for r in resolve.resolve_identity(companies, candidates, sites).select(*shown).collect()}
    assert got.pop(9)[1] == "removed" and got == full and len(touched) <= 4


# drivers ---------------------------------------------------------------------------------------------------------------------

def test_stages_one_after_the_other(spark):
    companies = spark.createDataFrame([(1, "Known Firm"), (2, "Major Firm"), (3, "Listed Firm"), (4, "Pool Robotics"), (5, "Rejected Robotics"), (6, "Nobody"), (7, "Securities and Exchange Commission"), (8, "Unsure Robotics")], "company_id int, company string")
    entry = lambda *v: spark.createDataFrame(list(v), "key string, domain string, entry_seq int")
    cand = lambda *v: spark.createDataFrame([(i, k, d, n, s, None, None) for i, k, d, n, s in v], "company_id int, seq int, domain string, name string, source string, snippet string, prominence int")
    pool = cand((1, 0, "never.com", "x", "search"), (4, 0, "poolrobotics.com", "Pool Robotics", "autocomplete"), (4, 1, "www.poolrobotics.com", "Pool Robotics", "wikidata"), (5, 0, "bad.com", "Rejected Robotics", "wikidata"),
                (7, 0, "sec.gov.ph", "Securities and Exchange Commission", "autocomplete"), (7, 1, "sec.gov", "U.S. SEC", "search"), (8, 0, "unsurerobotics.com", "Unsure Robotics", "autocomplete"), (8, 1, "unsurerobotics.com", "Unsure Robotics", "wikidata"))
    live = spark.createDataFrame([("poolrobotics.com", True), ("unsurerobotics.com", True)], "domain string, dns_ok boolean")
    rejected = spark.createDataFrame([(5, "bad.com")], "company_id int, domain string")
    out = resolve.resolve_staged(companies, entry(("knownfirm", "known.com", 0)), entry(("majorfirm", "major.com", 0)), entry(("listedfirm", "listed.com", 0)), pool, cand((4, 0, "not.com", "n", "search"), (5, 0, "rejectedrobotics.com", "Rejected Robotics", "search")),
                                 rejected, live, spark.createDataFrame([(8,)], "company_id int"))
    got = {r["company_id"]: r for r in out.collect()}
    assert [(got[i]["stage"], got[i]["domain"]) for i in range(1, 9)] == [("learned", "known.com"), ("major_firm", "major.com"), ("dictionary", "listed.com"), ("pool", "poolrobotics.com"), ("fallback", "rejectedrobotics.com"), ("none", None), ("pool", "sec.gov"), ("pool", "unsurerobotics.com")]
    assert got[4]["status"] == "found" and got[6]["confidence"] == "none" and got[6]["status"] == "unverified"
    assert got[7]["ambiguous"] and got[7]["confidence"] == "low" and got[7]["status"] == "potential"
    assert got[8]["confidence"] == "low" and got[8]["status"] == "potential" and got[8]["decisive_rule"] is None


def test_two_stages_look_again_at_the_ambiguous_alone(spark):
    companies = spark.createDataFrame([(1, "Stable Asset Partners"), (2, "Stable")], "company_id int, company string")
    pool = spark.createDataFrame([(1, 0, "stableassetpartners.com", "Stable Asset Partners", "autocomplete", "Stable Asset Partners official website"), (1, 1, "stableassetpartners.com", "Stable Asset Partners", "infobox", None), (2, 0, "usestable.com", "Stable", "autocomplete", None), (2, 1, "stable.com", "Stable", "search", None)],
                                 "company_id int, seq int, domain string, name string, source string, snippet string")
    page = "<html><head><title>{0} | Official Site</title><meta name='description' content='{0} is a private equity firm'></head><body><h1>{0}</h1><p>{0} invests</p></body></html>"
    pages = spark.createDataFrame([(1, "https://stableassetpartners.com/", page.format("Stable Asset Partners")), (2, "https://stable.com/about", page.format("Stable"))], "page_id int, url string, html string")
    hits = spark.createDataFrame([(2, 0, "stable.com", "Stable", "Stable is a company that stores mail")], "company_id int, seq int, host string, title string, snippet string")
    one = {r["company_id"]: (r["status"], r["domain"]) for r in resolve.resolve_identity(companies, pool, pages).collect()}
    two = {r["company_id"]: (r["status"], r["domain"], r["reason"]) for r in resolve.resolve_in_two_stages(companies, pool, pages, hits).collect()}
    assert two[1][:2] == one[1] and set(two) == set(one) and (one[2][0] != "ambiguous" or two[2][2].startswith("stage2") or two[2][0] in ("ambiguous", "resolved"))


def test_parts_reach_as_far_as_the_classification(spark):
    from orgweave.operators import industry

    rows = [(1, i, "x" * 500) for i in range(200)] + [(2, 0, "a"), (2, 1, None), (2, 2, "y" * 20_000), (2, 3, ""), *((2, i, "z" * 9_000) for i in range(4, 30))] + [(3, 0, "venture capital firm that invests in seed rounds")]
    df = spark.createDataFrame(rows, "company_id int, seq int, text string")
    got = {r["company_id"]: r["parts"] for r in resolve.evidence_parts(df).collect()}
    assert len(got[1]) == 24 and sum(map(len, got[1])) == 12_000 and [len(p or "") for p in got[2]] == [1, 0, 12_000, 9_000, 9_000, 9_000, 9_000] and len(got[3]) == 1
    whole = df.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]).alias("parts"))
    told = lambda parts: sorted(map(tuple, industry.classify(parts).select("company_id", "industry", "industry_confidence", "industry_score").collect()))
    assert told(whole) == told(resolve.evidence_parts(df))


# what only callers outside use ---------------------------------------------------------------------------------------------------

def test_diagnosis_of_an_ambiguous_company(spark):
    from orgweave.operators import selection

    rows = [(1, 0, "a.com", 90, {"title": 20, "shop": -30}), (1, 1, "b.com", 84, {"title": 10}), (2, 0, "c.com", 50, {})] + [(3, i, f"h{i}.com", 50, {"k": i}) for i in range(12)]
    scored = spark.createDataFrame(rows, "company_id int, seq int, host string, score int, signals map<string,int>")
    got = {r["company_id"]: r for r in selection.diagnose(scored).collect()}
    assert (got[1]["margin"], got[1]["top"], got[1]["plus"], got[1]["minus"]) == (6, ["a.com", "b.com"], {"title": 20}, {"shop": -30})
    assert got[2]["margin"] is None and got[2]["plus"] == {} and got[3]["margin"] == 0 and got[3]["top"] == [f"h{i}.com" for i in range(8)]


def test_founder_summary_and_site_founders(spark):
    from orgweave.operators import consensus, metrics

    rows = spark.createDataFrame([(o,) for o in ["exact_complete"] * 3 + ["correct_partial", "incorrect", "unknown", "unknown", "not_applicable"]], "outcome string")
    assert tuple(metrics.summarize_founders(rows).first()) == (8, 3, 1, 1, 2, 1, 60.0, 80.0, 71.4)
    assert metrics.summarize_founders(rows.limit(0)).first()["exact_precision_pct"] is None
    df = spark.createDataFrame([("Ann Lee; Bob Ray", "ann lee; Cy Dee", "Eve Fox"), (None, "", "Eve Fox; Gil Hay"), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(consensus.merge_site_founders(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["Ann Lee; Bob Ray; Cy Dee", "Eve Fox; Gil Hay", ""]


def test_guard_lines_and_lookups(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert [one(G.lookup_status(lit(s).cast("int"))) for s in (200, 204, 429, 500, 0, None, 404)] == ["ok", "ok", "rate_limited", "transient", "transient", "transient", "http"]
    assert one(G.media_keyword(lit("Head of Press"))) == "press" and one(G.media_keyword(lit("Pressure engineer"))) is None and one(G.media_keyword(lit(None).cast("string"))) is None
    say = lambda d, r, m=None, v="exact", k=None: one(G.describe(lit(d).cast("string"), lit(r).cast("string"), F.array(*map(lit, m)) if m else lit(None).cast("array<string>"), lit(v), lit(k).cast("string")))
    assert say("accept", "p31_organization", ["Q1", "Q2"]) == "accept — org class matched: Q1, Q2" and say("accept", "p31_org_subclass", ["Q1"], "subclass") == "accept — org class matched: Q1 (via subclass)"
    assert say("reject", "p31_media", ["Q9"]) == "reject — Q9 is a reject class" and say("allow_unknown", "no_p31") == "allow_unknown — empty P31" and say("retry_needed", "rate_limited") == "retry_needed — rate limited"
    assert say(None, None) == "allow_unknown — missing classification" and say("accept", "p31_media_with_context", ["Q9"], k="news") == "accept — media class with contact-title keyword: news"


def test_unions_orders_and_inputs(spark, tmp_path):
    from orgweave.functions import matching as N
    from orgweave.operators import corrections as K
    from orgweave.sources import readers

    a = spark.createDataFrame([(1, 0, "a.com")], "company_id int, seq int, domain string")
    b = spark.createDataFrame([(1, 1, "b.com", "B"), (1, 2, "a.com", "A")], "company_id int, seq int, domain string, name string")
    assert sorted(tuple(r) for r in C.union_sources(a, b).select("domain", "source_no", "seq").collect()) == [("a.com", 0, 0), ("a.com", 1, 2), ("b.com", 1, 1)]
    assert sorted(r["domain"] for r in C.append_missing(a, b).collect()) == ["a.com", "b.com"]
    kept = spark.createDataFrame([("zeta", "k1", "kept"), ("Álpha", "k2", "kept"), ("beta", "k3", "deleted"), ("alpha", "k4", "kept")], "company_name string, company_key string, state string")
    assert [r["company_key"] for r in K.export_order(kept).collect()] == ["k4", "k2", "k1"]
    (tmp_path / "in.txt").write_text("  Acme \n\n \nZed\n")
    assert [r["value"] for r in readers.text_lines(spark, str(tmp_path / "in.txt")).collect()] == ["Acme", "Zed"]
    rows = spark.createDataFrame([("A", None, " x ", "Rome"), (None, "B", "", None)], "name string, company string, sector string, hq string")
    assert [tuple(r) for r in readers.aliased_records(rows).collect()] == [("A", "x", "Rome"), ("B", None, None)]
    writers.write_report(a, b, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/summary")).count() == 1 and spark.read.json(str(tmp_path / "report/rows")).count() == 2
    values = spark.createDataFrame([(v,) for v in ("", " - ", "Unknown", "x", None)], "v string")
    assert [r[0] for r in values.select(N.is_placeholder(F.col("v"))).collect()] == [True, True, True, False, True]
    odd = spark.createDataFrame([("Acme", "acmesolutions.com", "Robotics"), ("Fordham University", "fordham.edu", "Banking"), ("Acme", "acme.com", None)], "company string, domain string, industry string")
    assert [tuple(r)[3:] for r in resolve.compound_mismatch(odd).collect()] == [(True, False), (False, True), (False, False)]


# sizes ---------------------------------------------------------------------------------------------------------------

def test_nothing_that_grows_is_broadcast(spark):
    plans = {"facts_and_cache": Q.facts_and_cache(spark, SF), "staged_resolution": Q.staged_resolution(spark, SF)}
    c = F.col
    names = spark.read.parquet(f"{SF}/customer.parquet").select(c("c_custkey").alias("company_id"), c("c_name").alias("company"))
    known = names.select(F.lower("company").alias("key"), c("company").alias("domain"), c("company_id").alias("entry_seq"))
    plans["resolve_known"] = resolve.resolve_known(names, known, known, known)
    for name, df in plans.items():
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString(), name


def test_long_keys_meet_by_long_grams(spark):
    values = [f"customer{i:09}" for i in range(2000)]
    keys = spark.createDataFrame([(v,) for v in values], "key string")
    assert {tuple(r) for r in C.contained_keys(keys, keys).collect()} == {(v, v) for v in values}
    assert C.met_by_grams(keys, keys).count() <= 3000  # 8889 by grams of four


def test_made_rows_are_dealt_to_all_cores(spark):
    assert Q._made(spark, SF).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["industry_classify", "pasted_documents"])
def test_documents_are_dealt_to_all_cores(spark, name):
    assert Q.QUERIES[name](spark, SF).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
