import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from curatrix.sources import connectors, sinks, study_pages


@pytest.fixture(scope="module")
def site():
    tries = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            page = int(q["page"][0])
            tries[page] += 1
            if page == 2 and tries[2] == 1:
                return self.send_error(503)
            if page == 3:
                return self.send_error(404)
            body = json.dumps({"hits": {"hits": [{"id": page * 10 + i, "q": q["q"][0]} for i in range(2)]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/?q={{query}}&page={{page}}&size={{size}}"
    server.shutdown()


def test_pages_are_partitions(spark, site):
    spark.dataSource.register(connectors.PagedJson)
    options = {"source": "zenodo", "url": site, "records": "hits.hits", "query": "a b&c", "pages": "4", "wait": "0.05"}
    df = spark.read.format("paged_json").options(**options).load()
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert Counter(r.status for r in rows) == {"ok": 6, "offline": 1}
    assert {json.loads(r.raw)["id"] for r in rows if r.raw} == {10, 11, 20, 21, 40, 41}
    assert {json.loads(r.raw)["q"] for r in rows if r.raw} == {"a b&c"}
    assert connectors.search("zenodo", "x", size=500)["size"] == "25"
    assert connectors.search("zenodo", "a:b")["query"] == "a\\:b" and connectors.search("dryad", "a:b")["query"] == "a:b"
    assert connectors.lucene_escaped("a:b(c)") == "a\\:b\\(c\\)"


@pytest.fixture(scope="module")
def linked():
    """Finds all words or nothing; a page of two tells the next one."""
    held = [{"id": i, "modality": "eeg" if i % 2 else "meg", "text": "eeg study" if i % 2 else "study"} for i in range(7)]
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query, keep_blank_values=True)
            words, at = q["search"][0].split(), int(q.get("at", ["0"])[0])
            asked[q["search"][0]] += 1
            found = [r for r in held if all(w in r["text"].split() for w in words)]
            more = f"?search={'+'.join(words)}&at={at + 2}" if at + 2 < len(found) else None
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"results": found[at : at + 2], "next": more}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield {"source": "dandi", "url": f"http://127.0.0.1:{server.server_port}/?search={{query}}", "records": "results", "next": "next", "wait": "0.01"}, asked
    server.shutdown()


def test_links_and_ladder(spark, linked):
    options, asked = linked
    spark.dataSource.register(connectors.PagedJson)
    rows = spark.read.format("paged_json").options(**options, query="study", pages="3").load().collect()
    assert [(r.page, json.loads(r.raw)["id"]) for r in rows] == [(1, 0), (1, 1), (2, 2), (2, 3), (3, 4), (3, 5)]
    texts = connectors.weaker("eeg hippocampus study", ["eeg", None], ["hippocampus"], ["eeg"])
    assert texts == ["eeg hippocampus study", "eeg", "hippocampus", ""]
    asked.clear()
    requests = [{**options, "query": t, "pages": "9"} for t in texts]
    found = connectors.ladder(spark, requests, F.try_variant_get("payload", "$.id", "int") > 1).select("rung", "raw").collect()
    assert {(r.rung, json.loads(r.raw)["id"]) for r in found} == {(1, 3), (1, 5)}
    assert set(asked) == {"eeg hippocampus study", "eeg"} and asked["eeg"] == 2
    # what no request asks for any more still holds
    found = connectors.ladder(spark, requests[2:], F.try_variant_get("payload", "$.modality", "string") == "meg").select("rung", "raw").collect()
    assert {(r.rung, json.loads(r.raw)["id"]) for r in found} == {(1, i) for i in (0, 2, 4, 6)}
    assert connectors.ladder(spark, requests[:1]).count() == 0


def test_query_terms(spark):
    df = spark.createDataFrame([(["fMRI", "", None], ["Human"], ["fmri", "fMRRRi", "memory", " memory ", "x"]), ([], [], None)], "m array<string>, s array<string>, k array<string>")
    got = [r[0] for r in df.select(connectors.query_terms([F.col("m"), F.col("s")], F.col("k"))).collect()]
    assert got == ["fMRI Human memory x", ""]


def test_study_pages(spark):
    index = '<a href="/study/alpha-1">A</a> <a href="https://x.org/study/beta">B</a> <a href="/study/alpha-1">A</a>'
    page = '<meta name="description" content="D"><h1>The <b>T</b></h1><h2>Overview</h2><p>Text &amp; more</p><h2>Next</h2><div class="x pi">Dr. A</div>'
    notes = "<h3>Release 1 (2019-05)</h3><p>x</p><h3>Beta 2020</h3> doi:10.1234/AbC. and 10.1234/abc"
    df = spark.createDataFrame([(index, page, notes)], "i string, p string, n string")
    r = df.select(study_pages.slugs(F.col("i")).alias("s"), study_pages.study(F.col("p")).alias("t"), study_pages.releases(F.col("n")).alias("r"), study_pages.dois(F.col("n")).alias("d")).first()
    assert r.s == ["alpha-1", "beta"]
    assert tuple(r.t) == ("The T", "Text & more", "D", ["Dr. A"])
    assert [tuple(x) for x in r.r] == [("Release 1 (2019-05)", "2019-05"), ("Beta 2020", "2020")] and r.d == ["10.1234/abc"]
    assert study_pages.discovery_gate(df, 2, "i").first().verdict == "pass"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_report({"A": df, "B": df.limit(1)}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/A")).count() == 2
    assert sinks.messages(df, "k").orderBy("key").first().value == '{"k":1,"v":"a"}'
    fresh = spark.createDataFrame([(2, "new")], "k int, v string")
    assert {tuple(r) for r in sinks.rebuild(df, fresh, fresh, "k").collect()} == {(1, "a"), (2, "new")}
