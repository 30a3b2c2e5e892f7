"""Recorded responses, the retry queue with its stream, and signals merged at their highest."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from orgweave.operators import candidates as C
from orgweave.operators import provider as P
from orgweave.operators import retries
from orgweave.sources import responses
from orgweave.streaming.corrections import stream_corrections
from orgweave.streaming.retries import stream_lookups


def write(path, provider, *lines):
    folder = path / f"provider={provider}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "part.json").write_text("\n".join(x if isinstance(x, str) else json.dumps({"company_id": 1, "seq": i, "company": "Acme", "http_status": 200} | x) for i, x in enumerate(lines)) + "\n")


def body(x):
    return {"body": json.dumps(x)}


def test_bad_lines_and_bodies_are_kept_and_folders_pruned(spark, tmp_path, capsys):
    write(tmp_path, "autocomplete", {"request": "a", "body": "[{"}, "no json at all", {"request": "b", "body": " "}, {"request": "c"} | body([{"domain": "c.com"}]))
    write(tmp_path, "instant", {"request": "a"} | body({}))
    got = responses.recorded(spark, str(tmp_path))
    assert sorted(r["bad"] for r in got.where("bad IS NOT NULL").select("bad").collect()) == ["[{", "no json at all"]
    assert [(r["domain"], r["name"], r["snippet"]) for r in responses.autocomplete_rows(got).collect()] == [("c.com", "c.com", "")]
    assert len(responses.fetch_log(got).collect()) == 5
    responses.autocomplete_rows(got).explain("formatted")
    assert "PartitionFilters: [isnotnull(provider" in capsys.readouterr().out


def test_a_request_counts_once_even_if_it_failed(spark, tmp_path):
    write(tmp_path, "autocomplete", {"request": "Acme", "http_status": 500} | body([{"domain": "x.com"}]), {"request": " acme "} | body([{"domain": "y.com"}]), {"request": ""} | body([{"domain": "z.com"}]),
          {"request": "Acme Inc"} | body([{"name": "no domain"}, {"domain": "a.com", "name": "A", "industry": "i"}]), {"request": "Acme Co"} | body({"domain": "no array"}))
    got = responses.autocomplete_rows(responses.recorded(spark, str(tmp_path))).collect()
    assert [(r["seq"], r["place"], r["query"], r["domain"], r["name"], r["snippet"]) for r in got] == [(3, 1, "Acme Inc", "a.com", "A", "i")]


def test_instant_answers(spark, tmp_path):
    info = lambda *items: {"Infobox": {"content": list(items)}}
    write(tmp_path, "instant", body({"Heading": "Acme Corp"} | info({"label": "Founded", "value": "1"}, {"data_type": "official_website", "value": "https://www.acme.com/x"})),
          body(info({"label": "Website", "value": "https://en.wikipedia.org/wiki/A"}) | {"AbstractURL": "https://en.wikipedia.org/wiki/Acme_%26_Co%C3%A9?x#y"}), body({"Infobox": "", "AbstractURL": "https://acme.org/about", "Heading": ""}),
          {"http_status": 429} | body({"AbstractURL": "https://no.org"}), body([]), {"body": None})
    got = responses.recorded(spark, str(tmp_path))
    assert sorted((r["seq"], r["domain"], r["name"], r["snippet"]) for r in responses.instant_rows(got).collect()) == [(0, "acme.com", "Acme Corp", "official"), (2, "acme.org", "Acme", "abstract")]
    assert [(r["seq"], r["title"]) for r in responses.instant_titles(got).collect()] == [(1, "Acme & Coé")]


def test_provider_answers_flat_nested_and_refused(spark, tmp_path):
    firm = {"name": "Acme", "website": "acme.com", "size": "11-50", "employee_count": 12, "alternative_names": ["A"], "alternative_domains": ["a.io"]}
    write(tmp_path, "enrich", {"request": "acme.com"} | body(firm | {"likelihood": 9}), {"request": "b.com", "http_status": 404} | body({"status": 404}), {"request": "c.com", "http_status": 402} | body({"error": {"message": "no credit"}}),
          {"request": "d.com", "http_status": 500, "body": None}, {"request": "e.com", "body": "{"}, {"request": "f.com, g.com,h.com,i.com,j.com"} | body([{"status": 200, "likelihood": 7, "data": firm}, firm | {"status": 200, "likelihood": 6},
          {"status": 404, "message": "none"}, {"status": 500}, {"data": firm | {"likelihood": 8}}]))
    got = sorted(responses.provider_rows(responses.recorded(spark, str(tmp_path))).collect(), key=lambda r: (r["seq"], r["place"]))
    assert [(r["domain"], r["http_status"], r["error"], r["likelihood"], r["provider_name"]) for r in got] == [
        ("acme.com", 200, None, 9, "Acme"), ("b.com", 404, "not_found", None, None), ("c.com", 402, "no credit", None, None), ("d.com", 500, "http_500", None, None), ("e.com", 200, "unreadable", None, None),
        ("f.com", 200, None, 7, "Acme"), ("g.com", 200, None, 6, "Acme"), ("h.com", 404, "none", None, None), ("i.com", 500, "status_500", None, None), ("j.com", 200, None, 8, "Acme")]
    assert (got[0]["employee_count"], got[0]["alternative_names"], got[5]["alternative_domains"]) == (12, ["A"], ["a.io"])


def test_people(spark, tmp_path):
    people = [{"full_name": "Jane Doe", "job_title": "Co-Founder", "job_company_website": "acme.com", "job_company_name": "Acme"}, {"full_name": "John Roe", "job_title": "CEO"}]
    write(tmp_path, "people", {"request": "acme.com"} | body({"data": people}), {"request": "b.com"} | body({"data": None}))
    rows = responses.people_rows(responses.recorded(spark, str(tmp_path)))
    assert rows.count() == 2
    assert [r["full_name"] for r in P.founder_people(rows).collect()] == ["Jane Doe"]


def expected(rows):
    """The queue by a loop."""
    out = {}
    of = {}
    for key, seq, at, status in rows:
        of.setdefault(key, {})
        of[key][at, seq] = max(status or 0, of[key].get((at, seq), 0))
    for key, tries in of.items():
        for n, ((at, _), status) in enumerate(sorted(tries.items())[:3], 1):
            reason = "done" if 200 <= status < 300 else "rate_limited" if status == 429 else "transient" if status == 0 or status >= 500 else "http"
            out[key] = ({"done": "done", "http": "refused"}.get(reason, "given_up" if n == 3 else "waiting"), reason, n, at)
            if reason in ("done", "http"):
                break
    return out


def attempts(n):
    r = random.Random(5)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(4000))
    rows = [("hot" if r.random() < .3 else f"k{r.randrange(200)}", r.randrange(3), at(), r.choice([200, 404, 429, 429, 429, 500, 503, 0, None])) for _ in range(n)]
    return rows + rows[::7]


SCHEMA = "key string, seq long, at timestamp, http_status int"


def test_queue_and_its_stream_against_a_loop(spark, tmp_path):
    rows = attempts(400)
    want = expected(rows)
    found = retries.lookups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["key"]: (r["state"], r["reason"], r["attempts"], r["at"]) for r in found} == want and len(found) == len(want)
    assert {w[0] for w in want.values()} == {"done", "refused", "given_up", "waiting"}
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = stream_lookups(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "3650 days")
    q = stream.writeStream.format("memory").queryName("lookups").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    told = {}
    for r in spark.table("lookups").collect():  # batches in their order: a key's last row is what it came to
        if r["key"] not in told or r["updated_at"] >= told[r["key"]][1]:
            told[r["key"]] = (r, r["updated_at"])
    last = {k: (r["state"], r["reason"], r["attempts"], r["at"]) for k, (r, _) in told.items()}
    assert last == want


def streamed(spark, stream, name, folder):
    q = stream.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]), [tuple(r) for r in spark.table(name).collect()]


def test_streams_call_python_for_shards_and_not_for_keys(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(f"k{i}" if i else None, s, day(s), 503 if s else 500) for i in range(600) for s in range(2)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / "a"))
    kept, told = streamed(spark, stream_lookups(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "a")), "3650 days", shards=8), "many_lookups", tmp_path / "c1")
    assert kept <= 8 and len(told) == 600 and {r[1:4] for r in told} == {("waiting", "transient", 2)} and None in {r[0] for r in told}
    schema = "company_key string, company_name string, domain string, updated_at timestamp, deleted boolean, seq long"
    log = [(f"k{i}" if i else None, "N", f"{s}.com", day(s), i % 3 == s, s) for i in range(600) for s in range(2)]
    spark.createDataFrame(log, schema).repartition(2).write.parquet(str(tmp_path / "b"))
    kept, told = streamed(spark, stream_corrections(spark.readStream.schema(schema).parquet(str(tmp_path / "b")), "3650 days", shards=8), "many_corrections", tmp_path / "c2")
    assert kept <= 8 and {(r[0], r[2], r[4]) for r in told} == {(f"k{i}" if i else None, None if i % 3 == 1 else "1.com", "deleted" if i % 3 == 1 else "kept") for i in range(600)}


def test_streams_forget_in_their_shards(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    schema = "company_key string, company_name string, domain string, updated_at timestamp, deleted boolean, seq long"
    lookups = [[("a", 0, day(0), 503), ("b", 0, day(0), 503)], [("b", 1, day(60), 503)], [("b", 2, day(61), 200)], [("a", 1, day(62), 503)]]
    changes = [[("a", None, None, day(0), True, 0), ("b", "B", "b.com", day(1), False, 1), ("b", None, None, day(0), True, 2), ("c", "C", "c1.com", day(400), False, 9)], [("b", "B", "b2.com", day(450), False, 3)],
               [("c", "C", "c2.com", day(451), False, 4)], [("c", "C", "c3.com", day(451), False, 0)], [("c", "C", "old.com", day(440), False, 5), ("a", "A", "a.com", day(452), False, 6)]]
    for name, shape, batches in (("l", SCHEMA, lookups), ("k", schema, changes)):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            for f in (tmp_path / name).glob("part-*"):
                if f.stat().st_mtime > 1e9 + 100:
                    os.utime(f, (1e9 + i, 1e9 + i))
    read = lambda name, shape: spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    _, told = streamed(spark, stream_lookups(read("l", SCHEMA), "1 day", shards=1), "forgotten_lookups", tmp_path / "c1")
    assert [r[:4] for r in told if r[0] == "a"] == [("a", "waiting", "transient", 1)] * 2  # after two months the first attempt no longer counts
    _, told = streamed(spark, stream_corrections(read("k", schema), "20 days", shards=1), "forgotten_corrections", tmp_path / "c2")
    of = lambda key: [(r[2], r[4]) for r in told if r[0] == key]
    assert of("a") == [(None, "deleted"), ("a.com", "kept")] and of("b") == [("b.com", "kept"), ("b2.com", "kept")]
    assert of("c") == [("c1.com", "kept"), ("c2.com", "kept"), ("c3.com", "kept"), ("c3.com", "kept")]  # of equal times what comes in wins


def test_queue_of_nulls_and_nothing(spark):
    assert retries.lookups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 0, None, 500), (None, 1, dt.datetime(2024, 1, 1), 200), ("a", None, dt.datetime(2024, 1, 1), -1), ("b", 0, dt.datetime(2024, 1, 1), 301)]
    got = retries.lookups(spark.createDataFrame(rows, SCHEMA))
    assert sorted((str(r["key"]), r["state"], r["reason"], r["attempts"]) for r in got.collect()) == [("None", "done", "done", 2), ("a", "waiting", "transient", 1), ("b", "refused", "http", 1)]
    assert [r["key"] for r in retries.again(got).collect()] == ["a"]


def test_signals_at_their_highest(spark):
    schema = "company_id long, domain string, seq long, source string, exact boolean, signals map<string,int>"
    rows = [(1, "a.com", 3, "wiki", False, {"name_similarity": 10, "notability": 12}), (1, "a.com", 1, "auto", None, {"name_similarity": 40, "notability": None}), (1, "a.com", 2, "wiki", True, {"other": -5}), (1, "b.com", 0, "auto", None, None),
            (1, None, 4, None, None, {}), (None, "c.com", 5, "auto", None, {"x": 1})]
    got = {(r["company_id"], r["domain"]): (r["sources"], r["exact"], r["signals"], r["total"], r["seq"]) for r in C.merge_signals(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "a.com"): (["auto", "wiki"], True, {"name_similarity": 40, "notability": 12, "other": -5}, 47, 1), (1, "b.com"): (["auto"], False, {}, 0, 0), (1, None): ([], False, {}, 0, 4),
                   (None, "c.com"): (["auto"], False, {"x": 1}, 1, 5)}


def test_live_hosts_overtake(spark):
    schema = "company_id long, domain string, seq long, source string, exact boolean, signals map<string,int>"
    rows = [(1, f"{d}.com", i, "s", d == "b", {"name_similarity": s}) for i, (d, s) in enumerate([("a", 30), ("b", 28), ("c", 27), ("d", 20), ("e", 19), ("f", 18)])]
    live = spark.createDataFrame([("b.com", True), ("c.com", True), ("f.com", True), ("a.com", False)], "domain string, dns_ok boolean")
    got = C.rank_evidence(C.merge_signals(spark.createDataFrame(rows, schema)), live).orderBy("place").select("domain", "total", F.coalesce(F.col("dns_ok").cast("string"), F.lit("-")).alias("ok")).collect()
    assert [tuple(r) for r in got] == [("b.com", 51, "true"), ("c.com", 42, "true"), ("f.com", 18, "-"), ("a.com", 10, "false"), ("d.com", 0, "false"), ("e.com", -1, "false")]
