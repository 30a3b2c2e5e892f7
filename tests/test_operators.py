"""Behaviour of operators that no table of the driver shows: quirks, ties, nulls, and the streaming twin."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orgweave.functions import domains as D
from orgweave.functions import extract as X
from orgweave.functions import fields as L
from orgweave.functions import html as H
from orgweave.functions import matching as N
from orgweave.functions import text as T
from orgweave.operators import candidates as C
from orgweave.operators import consensus as S
from orgweave.operators import corrections as K
from orgweave.operators import guard as G
from orgweave.operators import industry as I
from orgweave.operators import scoring as R
from orgweave.operators import selection as W
from orgweave.plans import resolve
from orgweave.sources import readers, shared, writers
from orgweave.streaming.corrections import stream_corrections


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("s"))).collect()]


def test_blank_values(spark):
    assert values(spark, T.is_blank, [None, "", " - ", "Unknown", "needs manual check", "not_applicable", "x", "unknown thing"]) == [True] * 6 + [False, False]


def test_word_edges_are_ascii_and_spaces_unicode(spark):
    assert values(spark, T.match_key, ["Éinc Foo Inc.", "Foo co.uk", "ACME, Inc.", None]) == ["foo", "foouk", "acme", ""]


def test_identity_names(spark):
    assert values(spark, T.identity_tokens, ["The Acme Group, Inc.", "Scale AI", None]) == [["acme"], ["scale", "ai"], []]
    assert values(spark, T.ambiguity_risk, ["Vista", "Acme Robotics Systems", ""]) == [75, 0, 75]


def test_hosts(spark):
    assert values(spark, D.host_of, ["https://www.Foo.com/x?y", "[http://a.b]", "foo.com:80#x", None]) == ["foo.com", "a.b", "foo.com:80#x", ""]
    assert values(spark, D.registrable, ["a.b.foo.co.uk", "https://www.x.foo.com/", "foo"]) == ["foo.co.uk", "foo.com", "foo"]
    assert values(spark, lambda c: D.is_junk_host(c), ["x.com", "netflix.com", "m.linkedin.com"]) == [True, False, True]


def test_industry_taxonomy_precedes_aliases(spark):
    assert values(spark, L.industry, ["climate tech vc", "healthcare / biotech", "deep tech vc", "aBC dEF", "éco fund"]) == ["Renewable Energy", "Biotechnology", "Venture Capital", "ABC DEF", "éCo Fund"]


def test_json_ld_forms(spark):
    pages = ['<script type="application/ld+json">{"@type":"Corporation","name":"A"}</script>', '<script type="application/ld+json">[{"@type":"Person"},{"@type":"Organization","name":"B"}]</script>',
             '<script type="application/ld+json">not json</script><script type="application/ld+json">{"@graph":[{"@type":["X","LocalBusiness"],"name":"C"}]}</script>', "", None]
    assert [[o["name"] for o in v] for v in values(spark, H.json_ld_organizations, pages)] == [["A"], ["B"], ["C"], [], []]


def test_merge_keeps_first_seen_and_skips_bad_hosts(spark):
    rows = [(1, 0, "Foo.com", "foo.com", None, "b", 1), (1, 1, "https://foo.com/x", "Foo", "s", "a", 5), (1, 2, "nohost", "N", "", "a", 9), (1, 3, "foo.com", "Other", "t", "b", None)]
    df = spark.createDataFrame(rows, "company_id int, seq int, domain string, name string, snippet string, source string, prominence int")
    (row,) = C.merge_by_domain(df).collect()
    assert (row["domain"], row["sources"], row["prominence"], row["name"], row["snippet"], row["seq"]) == ("foo.com", ["b", "a"], 5, "Foo", "s", 0)


def log(spark, rows):
    t = lambda d: dt.datetime(2024, 1, d) if d else None
    data = [(k, "N " + (k or ""), dom, "manual", t(c), t(u), deleted, origin, seq) for k, dom, c, u, deleted, origin, seq in rows]
    return spark.createDataFrame(data, readers.SCHEMAS["corrections"])


def test_correction_ties(spark):
    rows = [("a", "old.com", 1, 5, False, 0, 0), ("a", "new.com", 3, 5, False, 1, 0),  # of equal times the incoming one
            ("b", "b.com", 1, 5, False, 0, 1), ("b", None, None, 5, True, 0, 2),  # a tie with a deletion stays deleted
            ("c", "c.com", 1, 6, False, 0, 3), ("c", None, None, 5, True, 1, 4)]  # strictly newer survives, and its tombstone goes
    got = {r["company_key"]: (r["domain"], r["state"]) for r in K.reconcile(log(spark, rows), F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {"a": ("new.com", "kept"), "b": (None, "deleted"), "c": ("c.com", "kept")}
    late = {r["company_key"]: r["state"] for r in K.reconcile(log(spark, rows), F.lit("2026-02-01").cast("timestamp")).collect()}
    assert late == {"a": "kept", "b": "kept", "c": "kept"}  # after a year the tombstone is forgotten


def test_sanitize_drops_what_is_unusable(spark):
    rows = [(None, "x.com", 1, 1, False, 1, 0), ("k", "nodot", 1, 1, False, 1, 1), ("k", "https://www.x.com/y", None, None, None, 1, 2), ("", None, 1, 1, True, 1, 3)]
    got = K.sanitize(log(spark, rows), F.lit("2024-01-09").cast("timestamp")).collect()
    assert sorted((r["company_key"], r["domain"], r["deleted"]) for r in got) == [("k", "x.com", False), ("n", "", True), ("n", "x.com", False)]


def test_streaming_twin(spark, tmp_path):
    schema = "company_key string, company_name string, domain string, updated_at timestamp, deleted boolean, seq long"
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", "A", "old.com", t(1), False, 0), ("a", "A", "new.com", t(3), False, 1), ("b", "B", "b.com", t(2), False, 2), ("b", None, None, t(2), True, 3), ("c", None, None, t(1), True, 4), ("c", "C", "c.com", t(2), False, 5)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_corrections(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("merged").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["company_key"]: (r["domain"], r["state"]) for r in spark.table("merged").collect()}
    assert got == {"a": ("new.com", "kept"), "b": (None, "deleted"), "c": ("c.com", "kept")}


def test_walk_stops_at_known_classes_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "k"), ("k", "z")], "child string, parent string")
    starts, known = spark.createDataFrame([("a",)], "class string"), spark.createDataFrame([("k",)], "class string")
    assert sorted((r["class"], r["depth"]) for r in G.walk(starts, edges, known).collect()) == [("b", 1), ("c", 2), ("k", 2)]
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "child string, parent string")
    assert max(r["depth"] for r in G.walk(spark.createDataFrame([("n0",)], "class string"), chain).collect()) == 8


def test_closeness_ladder(spark):
    rows = [("Acme Capital Partners", "acmecapitalpartners.com", ""), ("Acme Capital Partners", "acme.com", ""), ("Blue Sky Yard", "bsy.com", ""), ("Acme (ACX) Group", "acx.io", ""), ("Acme Robots", "x.com", "Acme Robots"), ("", "a.com", "")]
    df = spark.createDataFrame(rows, "c string, d string, n string")
    got = [r[0]["kind"] for r in df.select(R.name_closeness(F.col("c"), F.col("d"), F.col("n"))).collect()]
    assert got == ["exact-domain", "brand-core", "acronym-domain", "alias-domain", "exact-name", "none"]


def test_selection_without_candidates_and_with_junk_only(spark):
    df = spark.createDataFrame([(1, "Acme", 0, "facebook.com", "Acme", "search", 1, None, None, None, None, None, None)],
                               "company_id int, company string, seq int, domain string, name string, source string, agreement int, title string, description string, snippet string, page_text string, json_ld_name string, wikidata_official boolean")
    (row,) = W.select_identity(R.score_identity(df)).collect()
    assert (row["status"], row["reason"], row["domain"], row["score"]) == ("unresolved", "no_candidates", None, 0)
    assert W.select_identity(R.score_identity(df.where("false"))).count() == 0


def test_consensus_prefers_authority_then_agreement(spark):
    rows = [(1, 0, "Paris", "press", True, 1), (1, 1, "paris", "text", True, 1), (1, 2, "Rome", "official_about", True, 1), (2, 0, "A", "official_about", True, 1), (2, 1, "B", "official_contact", True, 1)]
    df = spark.createDataFrame(rows, "company_id int, seq int, value string, source string, explicit boolean, authority int")
    got = {r["company_id"]: (r["value"], r["conflict"]) for r in S.pick_consensus(df).collect()}
    assert got == {1: ("Rome", False), 2: ("A", True)}


def test_one_team_page_founder_is_too_little(spark):
    rows = [(1, 0, "Ann Lee", "official_team", 4), (2, 0, "Ann Lee", "search_snippet", 2)]
    df = spark.createDataFrame(rows, "company_id int, seq int, value string, source string, authority int")
    assert [(r["company_id"], r["founders"]) for r in S.score_founders(df).collect()] == [(2, "Ann Lee")]


def test_store_round_trip_and_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q"', None)], "company_name string, website string, notes string").withColumns({c: F.lit("") for c in ("industry", "headcount", "location")})
    writers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first()["Website"] == 'x "q"'
    writers.write_store(spark, spark.createDataFrame([(1, "v")], "k int, v string"), str(tmp_path / "store"))
    assert writers.read_store(spark, str(tmp_path / "store")).collect() == [(1, "v")]


def test_readers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,Company Name\n1, Acme \n2,\n")
    assert [r[0] for r in readers.company_file(spark, str(tmp_path / "n.csv")).collect()] == ["Acme"]
    rows = readers.input_records(spark.createDataFrame([("Acme | Robots",), ("Solo",)], "value string")).collect()
    assert [(r["name"], r["context"]) for r in rows] == [("Acme", "Robots"), ("Solo", None)]
    pages = spark.createDataFrame([(1, "https://a.com/", "<p>home</p>"), (2, "https://a.com/about/", "<p>about us</p>"), (3, "https://a.com/blog", "x")], "page_id int, url string, html string")
    assert [(r["host"], r["text"], r["paths"]) for r in readers.deep_site_evidence(pages).collect()] == [("a.com", "home about us", 2)]


SCORED = "company_id int, company string, seq int, domain string, name string, source string, agreement int, title string, description string, snippet string, page_text string, json_ld_name string, wikidata_official boolean"


def test_second_stage_needs_new_evidence(spark):
    rows = [(1, "Orbit Nine", 0, "orbitnine.com", "Orbit Nine", "autocomplete", 1, None, None, None, None, None, None), (1, "Orbit Nine", 1, "orbitnine.io", "Orbit Nine", "autocomplete", 1, None, None, None, None, None, None),
            (2, "Sole Star", 0, "solestar.com", "Sole Star", "autocomplete", 1, None, None, None, None, None, None), (2, "Sole Star", 1, "solestar.io", "Sole Star", "autocomplete", 1, None, None, None, None, None, None),
            (3, "Acme Robotics", 0, "acmerobotics.com", "Acme Robotics", "autocomplete", 3, "Acme Robotics", None, None, None, None, None)]
    scored = R.score_identity(spark.createDataFrame(rows, SCORED))
    decided = W.select_identity(scored, 72)
    assert {r["company_id"]: r["status"] for r in decided.collect()} == {1: "ambiguous", 2: "ambiguous", 3: "resolved"}
    evidence = spark.createDataFrame([(1, "orbitnine.com", "Orbit Nine", "Orbit Nine is a company that orbits", "Welcome to Orbit Nine", "About Orbit Nine", "Orbit Nine", None, ["homepage", "wikidata"], None)],
                                     "company_id int, host string, deep_title string, deep_description string, deep_text string, about_text string, deep_json_ld string, search_snippets string, supporting_sources array<string>, context string")
    got = {r["company_id"]: (r["status"], r["domain"]) for r in resolve.second_stage(decided, scored, evidence).collect()}
    assert got == {1: ("resolved", "orbitnine.com"), 2: ("ambiguous", None), 3: ("resolved", "acmerobotics.com")}


def test_known_names_answer_in_order(spark):
    companies = spark.createDataFrame([(1, "Foo Inc"), (2, "Bar"), (3, "Bazaar Widgets"), (4, "Zip")], "company_id int, company string")
    table = lambda *rows: spark.createDataFrame(list(rows), "key string, domain string, entry_seq int")
    out = resolve.resolve_known(companies, table(("fooinc", "learned.com", 0)), table(("fooinc", "major.com", 0), ("bar", "bar.com", 1)), table(("bazaar", "bazaar.com", 0)))
    assert {r["company_id"]: (r["domain"], r["source"]) for r in out.collect()} == {1: ("learned.com", "learned"), 2: ("bar.com", "major_firm"), 3: ("bazaar.com", "dictionary"), 4: (None, None)}


def test_encyclopedia_candidates(spark):
    titles = spark.createDataFrame([(1, 0, "Acme (disambiguation)", "Q1"), (1, 1, "Acme", "Q2"), (1, 2, "Acme Village", "Q3")], readers.SCHEMAS["titles"])
    entities = spark.createDataFrame([("Q1", ["Q4830453"], "a.com", "A", None), ("Q2", ["Q4830453"], "acme.com", "Acme", "company"), ("Q3", ["Q532"], "village.org", "V", None)], readers.SCHEMAS["entities"])
    edges = spark.createDataFrame([], readers.SCHEMAS["class_edges"])
    assert [(r["company_id"], r["domain"], r["name"]) for r in resolve.encyclopedia_candidates(titles, entities, edges).collect()] == [(1, "acme.com", "Acme")]


def test_provider_enrichment_fills_only_open_fields(spark):
    fields = spark.createDataFrame([(1, "Unknown", "Paris", "Unknown", "Unknown"), (2, "Fintech", "Rome", "11–50", "Ann Lee")], "company_id int, industry string, location string, headcount string, founders string")
    responses = spark.createDataFrame([(i, "acme.com", "Acme", True, 200, None, 9, "acme.com", "Acme", None, None, "Banking", "Lyon", "51–200", None) for i in (1, 2)],
                                      "company_id int, requested_domain string, requested_name string, enabled boolean, http_status int, error string, likelihood int, website string, provider_name string, alternative_names array<string>, alternative_domains array<string>, industry string, location string, headcount string, founders string")
    got = {r["company_id"]: (r["industry"], r["location"], r["headcount"], r["founders"], r["conflicts"]) for r in resolve.enrich_with_provider(fields, responses).collect()}
    assert got[1] == ("Banking", "Paris", "51–200", "Unknown", ["location"]) and got[2][:4] == ("Fintech", "Rome", "11–50", "Ann Lee")


def test_field_strings(spark):
    said = {"10,000+": "5,001–10,000", "More than 10,000": "10,001+", "51-200": "51–200", "1,234": "1,001–5,000", "about 300 to 500 people": "201–500", "Unknown": "Unknown", "-": "Unknown", "some": "some"}
    assert values(spark, L.headcount, list(said)) == list(said.values())
    places = {"headquartered in Austin, Texas": "Austin, TX", "Toyota City, Aichi, Japan": "Toyota City, Japan", "Osaka, osaka": None, "London": "London", "Palo Alto, CA, USA": "Palo Alto, CA", "Smallville": None,
              "our headquarters are located in Leeds, England": None, "based in Boston, MA": "Boston, MA"}
    assert values(spark, L.hq, list(places)) == list(places.values())
    lists = {"Ann Lee and Bob Ray": "Ann Lee; Bob Ray", "Ann Lee (CEO), ann lee, Cher": "Ann Lee", "The Team": "Unknown", "not_applicable": "not_applicable", "Jane Doe, CEO": "Jane Doe"}
    assert values(spark, L.founders, list(lists)) == list(lists.values())


def test_pasted_text(spark):
    text = "• Nvidia, Apple, Ramp\n1. Foo Inc, Bar\n\n[3] Baz Widgets\nJane – CFO\tAcme (x)\nKim, Partner\n"
    rows = readers.pasted_names(spark.createDataFrame([(0, text), (1, None)], "paste_id int, text string")).orderBy("seq").collect()
    assert [r["name"] for r in rows] == ["Nvidia", "Apple", "Ramp", "Foo Inc, Bar", "Baz Widgets", "Jane – CFO\tAcme (x)", "Kim, Partner"]


def test_facts_with_windows(spark):
    texts = [None, "", "Acme is headquartered in Austin, Texas.", "We have an office in Paris, France.", "Meet the team. Jane Doe, Co-Founder of Acme and of many good ideas since then\nSam Poe - Founder of Other Corp"]
    assert [[h["value"] for h in v] for v in values(spark, X.hq_hits, texts)] == [[], [], ["Austin, TX"], [], []]
    lines = values(spark, lambda c: X.founder_line_hits(c, F.lit("Acme"), F.lit(False)), texts)
    assert [h["value"] for h in lines[4]] == ["Jane Doe"] and lines[:4] == [[], [], [], []]
    assert values(spark, lambda c: X.first_person(c, F.lit("Acme")), texts)[4] == "Jane Doe"
    (one,) = values(spark, lambda c: X.matches(c, (r"\b(\d+) (cats|dogs)\b", r"no(pe)"), 3, 2), ["12 cats, 3 dogs!"])
    assert [(h["start"], h["match"], h["g1"], h["g2"], h["g3"], h["window"]) for h in one] == [(0, "12 cats", "12", "cats", "", "12 cats, "), (9, "3 dogs", "3", "dogs", "", "s, 3 dogs!")]


def test_pages_are_read_to_their_end(spark):
    long, other = "Words of no weight. " * 1000, "<p>Acme is based in Boise, ID.</p>"
    facts = "Acme does fintech and is based in Reno, NV. Founder: Jane Doe and friends, 1,200+ people"
    pages = [f"<p>{long}{facts}.</p>", f"{other}<div id='about'>{long}{facts}.</div>", f"{other}<p class=\"x About\">{long}{facts}.</p>", f"{other}<footer>{long}{facts}.</footer>",
             f"<footer>{long}{facts}.{other}", f"<p>{long}</p>", f"<p class='about {long}{facts}."]
    rows = values(spark, lambda c: N.page_fields(c, F.lit("Acme")), pages)
    found = ("Financial Technology", "1,200+", "Reno, NV", "Jane Doe")
    assert [tuple(r)[:4] for r in rows] == [found, found, found, found, found, ("Unknown",) * 4, found]
    assert [r["source"] for r in rows] == ["scrape"] * 5 + ["scrape-unconfirmed", "scrape"]


def test_searches_of_pages_grow_with_their_length(spark):
    staff = {"111,222,333 - 444,555 people": "111,222,333 - 444,555", "12345,678+ employees": "678+", "1,22-33 people": "22-33", "1,222+, 5+ people": "5+", "111," * 25000 + "7+ people": "7+", "111," * 25000 + "222": "Unknown"}
    assert [r["headcount"] for r in values(spark, lambda c: N.page_fields(c, F.lit("")), list(staff))] == list(staff.values())  # 136 s for one such list if each of its numbers is a beginning
    odd = ["Jane Doe, CEO of it. " * 20000, "<p class='" + "about " * 60000, "<footer>x" * 40000]
    assert [r["founders"] for r in values(spark, lambda c: N.page_fields(c, F.lit("")), odd)] == ["Jane Doe", "Unknown", "Unknown"]


def test_industry_by_evidence(spark):
    parts = [["An observability platform and SaaS provider for the semiconductor industry"], [None, ""], ["short"], ["a technology company with many offices around the world"], ["She likes semiconductor physics and processors", "x" * 5000, "observability"],
             ["Acme is a fabless semiconductor company"]]
    rows = I.classify(spark.createDataFrame(list(enumerate(parts)), "i int, parts array<string>")).orderBy("i").collect()
    assert [(r["industry"], r["industry_source"]) for r in rows] == [("Enterprise Software", "explicit_description"), ("Unknown", "none"), ("Unknown", "none"), ("Technology", "explicit_description"), ("Unknown", "insufficient_signal"),
                                                                    ("Semiconductors", "explicit_description")]
    assert all(I._literal(p) and len(I._literal(p)) > 1 for rule in (*I.RULES, I.FALLBACK) for kind in (1, 2, 3) for p in rule[kind])


def test_containment_lookup(spark):
    names = spark.createDataFrame([(1, "Red Widget"), (2, "Bolt"), (3, "abc"), (4, "Bluebolts Ltd"), (5, None), (6, "zzzz")], "id int, name string")
    entries = spark.createDataFrame([(0, "ring", "r"), (1, "redwidget", "w"), (2, "xboltx", "x"), (3, "bluebolt", "b"), (4, "bolt", "o"), (5, "abcd", "a"), (6, "abc", "c"), (7, None, "n")], "entry_seq int, key string, domain string")
    got = {r["id"]: (r["domain"], r["exact"]) for r in C.fuzzy_lookup(names, entries).collect()}
    assert got == {1: ("w", True), 2: ("o", True), 3: ("c", True), 4: ("b", False), 5: (None, None), 6: (None, None)}


def test_bad_fixtures_are_kept(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1, "v": "x"}')
    (tmp_path / "b.json").write_text('{"k": 2, "v": ')
    rows = readers.json_records(spark, str(tmp_path), "k int, v string").collect()
    assert sorted((r["k"] or 0, r["_corrupt"] is not None) for r in rows) == [(0, True), (1, False)]


def test_cache_and_snapshot(spark, tmp_path):
    at = lambda s: F.lit(s).cast("timestamp")
    old = spark.createDataFrame([("a.com", dt.datetime(2024, 1, 1), "provider", "old"), ("b.com", dt.datetime(2024, 1, 1), "provider", "b")], "domain string, fetched_at timestamp, source string, company string")
    writers.write_cache(spark, old, spark.createDataFrame([("https://www.a.com/", "new")], "domain string, company string"), str(tmp_path / "cache"), at("2024-02-01"))
    assert {r["domain"]: r["company"] for r in writers.read_store(spark, str(tmp_path / "cache")).collect()} == {"a.com": "new", "b.com": "b"}
    lines = [r["json"] for r in writers.snapshot(K.reconcile(log(spark, [("b", "b.com", 1, 5, False, 0, 0), ("a", "a.com", 1, 5, False, 0, 1), ("c", None, None, 5, True, 0, 2)]), at("2024-02-01")), at("2024-02-01")).collect()]
    assert ['"version"' in lines[0], '"a"' in lines[1], '"b"' in lines[2], '"deletedAt"' in lines[3]] == [True] * 4 and len(lines) == 4
    assert writers.batch_csv_heading().count('"') == 14


def test_shared_folder_on_a_cluster_must_be_set(spark):
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError):
        shared.shared_dir(Session)
    written = shared.materialize(spark.range(3), "three")
    assert written.count() == 3
    shared.discard(written)
    assert not list(__import__("pathlib").Path(written.written_to.removeprefix("file:")).glob("*.parquet"))
