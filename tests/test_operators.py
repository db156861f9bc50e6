"""Operators on small tables: merge against a plain fold, rules, documents, crawl, sinks, stream."""

import json
import random
from xml.etree import ElementTree

from pyspark.sql import functions as F

from spindrift.operators import captures, crawl, documents, extract, html, merge, rules, select
from spindrift.plans import queries, scan
from spindrift.sources import cookies, sinks

RANK = {"low": 0, "medium": 1, "high": 2}
SCHEMA = "method string, url string, method_observed boolean, type string, source string, source_url string, evidence string, confidence string, status_code int, content_type string, params array<string>, tags array<string>, seq long"


def fold(rows):
    """The merge as a loop over rows in order."""
    out = {}
    for r in sorted(rows, key=lambda r: r[-1]):
        m, u, obs, kind, src, su, ev, conf, status, ct, params, tags, _ = r
        e = out.get((m, u))
        if e is None:
            out[(m, u)] = {"obs": obs, "type": kind, "source": src, "source_url": su, "evidence": ev, "confidence": conf, "status": status, "ct": ct, "params": params, "tags": tags}
            continue
        e["obs"] |= obs
        if RANK[conf] > RANK[e["confidence"]]:
            e["confidence"], e["evidence"] = conf, ev or e["evidence"]
        if e["type"] == "Unknown":
            e["type"] = kind
        if e["status"] is None and status is not None:
            e["status"], e["source"], e["source_url"] = status, src, su or e["source_url"]
        e["ct"] = e["ct"] if e["ct"] is not None else ct
        e["params"], e["tags"] = (sorted({*e[k], *new}) for k, new in (("params", params), ("tags", tags)))
    return out


def test_merge_is_the_ordered_fold(spark):
    r = random.Random(5)
    rows = [
        (r.choice(["GET", "POST"]), f"https://a.com/{r.randrange(60)}", r.random() < 0.3, r.choice(["Unknown", "REST", "GraphQL"]), f"s{k % 7}", r.choice([None, "", f"u{k}"]), r.choice([None, "", f"e{k}"]),
         r.choice(list(RANK)), r.choice([None, None, 200, 404]), r.choice([None, "a/b"]), [f"p{r.randrange(4)}"] * r.randint(0, 2), [f"t{r.randrange(4)}"], k)
        for k in range(300)
    ]
    got = merge.merge_observations(spark.createDataFrame(rows, SCHEMA)).collect()
    want = fold(rows)
    assert len(got) == len(want)
    for g in got:
        w = want[(g["method"], g["url"])]
        assert (g["method_observed"], g["type"], g["source"], g["source_url"], g["evidence"], g["confidence"], g["status_code"], g["content_type"], g["params"], g["tags"]) == tuple(w.values())


def test_prefer_observed_comes_before_confidence(spark):
    rows = [("PUT", "https://a.com/x", True, "REST", "s", None, "e", "low", None, None, [], [], 1), ("POST", "https://a.com/x", False, "REST", "s", None, "e", "high", None, None, [], [], 2), ("GET", "https://a.com/y", False, "Unknown", "s", None, "e", "high", None, None, [], [], 3)]
    m = merge.merge_observations(spark.createDataFrame(rows, SCHEMA))
    assert [(r["method"], r["url"]) for r in select.prefer_observed(m).orderBy("url").collect()] == [("PUT", "https://a.com/x"), ("GET", "https://a.com/y")]
    routes = spark.createDataFrame([("https://a.com/y/",)], "url string")
    assert select.selection(m, routes, confidence="medium").count() == 0
    assert [r["url"] for r in select.selection(m, routes.limit(0)).collect()] == ["https://a.com/x", "https://a.com/y"]


JS = """const apiUrl = "https://api.a.com/base"; // fetch("/api/hidden")
fetch('/api/one', {method: 'delete'}); axios({url: "/api/two", method: "PATCH"}); $.ajax({type: 'PUT', url: '/api/three'});
x.open("GET", saveUrl); saveUrl = "/api/four"; go(apiUrl + "/five"); t = "/tiles/{z}/{x}/{y}.pbf"; /* "/api/gone" */
//# sourceMappingURL=app.js.map"""


def test_rules_comments_and_variables(spark):
    a = spark.createDataFrame([(1, "https://www.a.com/app.js", "js", "JavaScript", JS), (2, "https://www.a.com/e.js", "js", "JavaScript", None), (3, "https://www.a.com/f.js", "js", "JavaScript", "")], "artifact_id long, url string, kind string, source_kind string, body string")
    found = {(r["rule"], r["value"], r["method"]) for r in rules.matches(a).collect()}
    assert {("fetch", "/api/one", "DELETE"), ("fetch", "/api/one", None), ("axios.config", "/api/two", "PATCH"), ("jquery.ajax", "/api/three", "PUT"), ("var:saveUrl", "/api/four", "GET"), ("tile-template", "/tiles/{z}/{x}/{y}.pbf", None)} <= found
    urls = {r["url"] for r in extract.analyze(a).collect()}
    assert "https://www.a.com/api/one" in urls and "https://api.a.com/api/one" in urls and "https://api.a.com/base/five" in urls
    assert not any("gone" in u for u in urls)
    side = {(r["what"], r["value"]) for r in rules.side_outputs(a).collect()}
    assert ("sourcemap", "app.js.map") in side


def test_pages(spark):
    page = '<base href="/b/"><title>A <b>x</title><script>var t="</p>";</script><a href="one.">1</a><a href="mailto:x@y">2</a><img srcset="i.png 1x, j.png 2x"><form method=post action="/api/f"><div hx-get="/api/hx">'
    p = spark.createDataFrame([(1, "https://a.com/x", page), (2, "https://a.com/y", None), (3, "https://a.com/z", "<![bad")], "page_id long, url string, html string")
    items = html.page_items(p)
    got = {(r["bucket"], r["url"]) for r in html.resources(p, items).collect()}
    assert {("anchors", "https://a.com/b/one"), ("media", "https://a.com/b/i.png"), ("media", "https://a.com/b/j.png"), ("data_urls", "https://a.com/api/hx")} <= got
    assert [(r["url"], r["method"]) for r in html.forms(p, items).collect()] == [("https://a.com/api/f", "POST")]
    assert html.inline_artifacts(p, items).first()["body"] == 'var t="</p>";'


def test_titles_as_their_sql_has_them(spark, tmp_path):
    import duckdb

    titles = ["Cut &amp;&amp", "&amp;lt; &lt;b&gt; &quot;x&#39;&#x27;", "&am", "a &lt b", " a\n\t b\u00a0 ", "A <b>x", "", "a<!-- c -->b", "AT&#T &# &x"]
    markup = [f"<html>\n<head>{h}<title>{t}</title><p>\n<svg><title>no</title></svg><a href='/z'>" for t in titles for h in ("", "<meta name=a\n>\n")]
    rows = list(enumerate([*markup, "<title>never ends", "<p>none", None]))
    spark.createDataFrame([(k, f"https://a.com/{k}", m) for k, m in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = queries.QUERIES["h01_titles"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLES["h01_titles"]).fetchall())
    assert [r["title"] for r in got if r["page_id"] == 0] == ["Cut &&amp"]
    found = html.page_items(spark.read.parquet(f"{tmp_path}/pages.parquet")).where("bucket = 'anchors'")
    assert found.count() == len(markup)  # nothing of a page is lost behind its title


def test_documents(spark):
    rows = [
        (1, "https://a.com/robots.txt", "text", "Disallow: /private/x*\nAllow: /\nSitemap: https://a.com/s.xml"),
        (2, "https://a.com/sitemap.xml", "xml", "<urlset><url><loc>https://a.com/p</loc>"),  # broken
        (3, "https://a.com/openapi.yaml", "yaml", "swagger: '2.0'\nhost: h.a.com\nbasePath: /v1\nschemes: [https]\npaths:\n  /x/{id}:\n    get: {}\n"),
        (4, "https://a.com/arcgis/rest/services/R/MapServer?f=json", "json", '{"currentVersion": 10, "layers": [{"id": 0, "name": "n"}], "singleFusedMapCache": true}'),
        (5, "https://a.com/openapi.json", "json", "{broken"),
        (6, "https://a.com/openapi.json", "json", None),
    ]
    urls = {r["url"] for r in documents.expand(spark.createDataFrame(rows, "artifact_id long, url string, kind string, body string")).collect()}
    root = "https://a.com/arcgis/rest/services/R/MapServer"
    assert urls == {"https://a.com/private/x", "https://a.com/p", "https://h.a.com/v1/x/{id}", f"{root}/0", f"{root}/0/query", *(f"{root}/{o}" for o in ("export", "identify", "find", "legend", "layers")), f"{root}/tile/{{z}}/{{y}}/{{x}}"}


def test_openapi_key_anywhere(spark):
    far = json.dumps({"components": {"schemas": {f"S{k}": {"type": "object", "title": "currentVersion"} for k in range(100)}}, "info": {"title": "t"}, "openapi": "3.0.0", "paths": {"/late": {"get": {}}}})
    assert far.index('"openapi"') > 2048
    rows = [
        (1, "https://a.com/one.json", "json", far),
        (2, "https://b.com/two.yaml", "yaml", "# a licence\n" * 300 + "swagger: '2.0'\npaths:\n  /late:\n    post: {}\n"),
        (3, "https://c.com/three.json", "json", json.dumps({"info": "x_capabilities", "swagger": "2.0", "paths": {"/late": {"get": {}}}})),
        (4, "https://d.com/arcgis/rest/services/R/MapServer", "json", '{"currentVersion": 10, "layers": [{"id": 0}], "note": {"openapi": 1}}'),
        (5, "https://e.com/five.js", "js", "x" * 3000 + ' {"openapi": "3.0.0"}'),
    ]
    got = {(r["method"], r["url"]) for r in documents.expand(spark.createDataFrame(rows, "artifact_id long, url string, kind string, body string")).collect()}
    assert {("GET", "https://a.com/late"), ("POST", "https://b.com/late"), ("GET", "https://c.com/late")} <= got
    assert {u.split("/")[2] for _, u in got} == {"a.com", "b.com", "c.com", "d.com"} and ("GET", "https://d.com/arcgis/rest/services/R/MapServer/0") in got


def test_scan_reads_data_files_operations_and_traffic(spark):
    pages = spark.createDataFrame([(1, "https://a.com/", "<html></html>")], "page_id long, url string, html string")
    arts = spark.createDataFrame(
        [
            (11, "https://a.com/conf.json", "json", "JSON", '{"apiUrl": "https://api.a.com/api/conf"}'),
            (12, "https://a.com/conf.xml", "xml", "XML", '<c url="https://api.a.com/api/from-xml"/>'),
            (13, "https://a.com/conf.yaml", "yaml", "JSON", "apiUrl: 'https://api.a.com/api/from-yaml'"),
            (14, "https://a.com/openapi.json", "json", "JSON", '{"openapi": "3.0.0", "info": {"description": "https://api.a.com/api/told"}, "paths": {"/op": {"get": {}}}}'),
            (15, "https://b.com/m.js", "js", "JavaScript", "gql`query Parts { id }`"),
            (16, "https://a.com/sitemap.xml", "xml", "XML", "<urlset><url><loc>https://a.com/api/listed</loc></url></urlset>"),
        ],
        "artifact_id long, url string, kind string, source_kind string, body string",
    )
    log = spark.createDataFrame([(7, "https://a.com/zz", "PUT", "xhr", 204, "text/plain")], "request_id long, url string, method string, resource_type string, status int, content_type string")
    responses = spark.createDataFrame([("https://a.com/", {"X-Api-Url": "https://api.a.com/api/header"})], "url string, headers map<string,string>")
    captures = spark.createDataFrame([("https://a.com/", {"c": "https://api.a.com/api/cookie"})], "url string, cookies map<string,string>")
    got = {(r["method"], r["url"]): r for r in scan.observations(pages, arts, log, responses, captures).collect()}
    urls = {u for _, u in got}
    assert {f"https://api.a.com/api/{x}" for x in ("conf", "from-xml", "from-yaml", "header", "cookie")} <= urls
    assert "https://api.a.com/api/told" not in urls and ("GET", "https://a.com/op") in got
    assert got[("PUT", "https://a.com/zz")]["status_code"] == 204 and got[("PUT", "https://a.com/zz")]["type"] == "REST"
    assert got[("POST", "https://b.com/graphql")]["tags"] == ["graphql:api", "query:Parts"]
    assert got[("GET", "https://a.com/api/listed")]["source"] == "sitemap.xml"
    assert scan.scan(pages, arts, spark.createDataFrame([], "url string"), log, responses, captures).where("url like '%/zz'").count() == 1


def test_scan_reads_captures_and_embedded_json(spark):
    blob = '<script type="application/json">{"u": "https://api.a.com/api/blob"}</script>'
    pages = spark.createDataFrame([(1, "https://a.com/", blob), (2, "https://a.com/2", None)], "page_id long, url string, html string")
    arts = spark.createDataFrame([(1, "https://a.com/m.js.map", "map", "SourceMap", '{"sources": ["s/one.js", "s/two.js"], "sourcesContent": ["fetch(\\"/api/one\\")", "fetch(\\"/api/two\\")"]}')], "artifact_id long, url string, kind string, source_kind string, body string")
    dom = '<form action="/api/late"></form><a href="/seen">x</a><a href="https://b.com/other">y</a><script>fetch("/api/inline")</script>'
    browser = spark.createDataFrame([(9, "https://a.com/", ["wss://a.com/live", "https://a.com/none"], ["https://a.com/sw.js"], ["x https://api.a.com/api/stored https://a.com/plain"], dom), (10, "https://a.com/e", None, None, None, None)], "capture_id long, page_url string, sockets array<string>, workers array<string>, storage array<string>, html string")
    rows = scan.observations(pages, arts, browser=browser).collect()
    got = {(r["method"], r["url"]): r for r in rows}
    assert {("ANY", "wss://a.com/live"), ("GET", "https://a.com/sw.js"), ("GET", "https://api.a.com/api/stored"), ("GET", "https://a.com/api/late"), ("GET", "https://a.com/api/inline"), ("GET", "https://api.a.com/api/blob")} <= set(got)
    assert ("GET", "https://a.com/plain") not in got and got[("GET", "https://api.a.com/api/stored")]["confidence"] == "low"
    assert "origin:one.js" in got[("GET", "https://a.com/api/one")]["tags"] and "origin:two.js" in got[("GET", "https://a.com/api/two")]["tags"]
    assert [r["url"] for r in captures.rendered_routes(browser, "https://a.com/").collect()] == ["https://a.com/seen"]
    assert len({str(r["seq"]) for r in rows if r["seq"]["stage"] != 6}) == sum(r["seq"]["stage"] != 6 for r in rows)


def test_crawl_is_bounded(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "a")], "page_url string, url string")
    captured = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    start = spark.createDataFrame([("a",)], "url string")
    assert {(r["url"], r["depth"]) for r in crawl.crawl(start, links, captured, 2, 100).collect()} == {("a", 0), ("b", 1), ("e", 1), ("c", 2)}
    assert crawl.crawl(start, links, captured, 5, 2).count() == 2


def test_penalty_fold(spark):
    e = spark.createDataFrame([("h", 1, "waf"), ("h", 2, "waf"), ("h", 3, None), ("h", 4, "rate_limited")], "host string, ord int, category string")
    assert tuple(crawl.penalties(e).first()) == ("h", 1.0, 3)


def test_sinks(spark, tmp_path):
    rows = [("GET", "https://a.com/x|y", True, "REST", "s", "https://a.com/", "</script>", "high", 200, None, ["p"], ["t", "u"], 1), ("POST", 'https://a.com/"<&', True, "Unknown", "s", None, "e", "low", None, None, [], [], 2)]
    m = merge.merge_observations(spark.createDataFrame(rows, SCHEMA))
    assert sinks.flat(m).where("method = 'GET'").first()["tags"] == "t u"
    errors = spark.createDataFrame([("https://a.com/e", "waf")], "url string, error string")
    scan = sinks.Scan(m, "a.com", errors=errors, routes=spark.createDataFrame([("https://a.com/r",), ("https://a.com/q",)], "url string"), values={"page_title": 'T "x"'})
    done, failed = sinks.write_reports(scan, ["json", "csv", "markdown", "html", "graphml", "text", "nonsense"], str(tmp_path / "r"))
    assert set(failed) == {"nonsense"} and len(done) == 6
    text = lambda f: "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "r" / f).glob("part-*")))
    doc = json.loads(text("json"))
    assert len(doc) == 15 and doc["target"] == "a.com" and doc["page_title"] == 'T "x"' and [r["url"] for r in doc["routes"]] == ["https://a.com/q", "https://a.com/r"]
    assert {e["url"] for e in doc["endpoints"]} == {r[1] for r in rows} and doc["errors"] == [{"url": "https://a.com/e", "error": "waf"}] and doc["summary"]["total"] == 2
    assert "x\\|y" in text("markdown") and text("markdown").index("## REST") < text("markdown").index("## Unknown")
    assert text("csv").startswith("\ufeffmethod,")
    graph = ElementTree.fromstring(text("graphml"))
    nodes = {n.get("id"): [d.text for d in n] for n in graph.iter() if n.tag.endswith("}node")}
    assert nodes == {"https://a.com/x|y": ["endpoint", "REST"], 'https://a.com/"<&': ["endpoint", "Unknown"], "https://a.com/": ["source", None]}
    assert text("html").count("</script>") == 1 and "GET     https://a.com/x|y  s  H" in text("text")
    assert [r["line"] for r in sinks.terminal(scan, 1).orderBy("at").collect()][0].startswith("[REST]")
    for scan_id in (1, 2):
        sinks.append_history(m.drop("params", "tags"), str(tmp_path / "h"), scan_id)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
    assert json.loads(sinks.json_report(m, "a").where("section = 'summary'").first()["line"])["total"] == 2


def test_merge_of_a_hot_endpoint_holds_no_list_of_its_observations(spark):
    rows = spark.range(200_000).selectExpr("'GET' method", "'https://a.com/b' url", "false method_observed", "'REST' type", "'s' source", "'u' source_url", "'e' || id evidence", "CASE WHEN id % 2 = 0 THEN 'low' ELSE 'high' END confidence",
        "CAST(NULL AS INT) status_code", "CAST(NULL AS STRING) content_type", "array('p' || id % 3) params", "array('t') tags", "id seq")
    m = merge.merge_observations(rows)
    assert "collect_list" not in m._jdf.queryExecution().toString()
    g = m.first()
    assert (g["evidence"], g["confidence"], g["params"], g["n_observations"]) == ("e1", "high", ["p0", "p1", "p2"], 200_000)


def test_penalty_blocks_are_the_fold(spark, monkeypatch):
    monkeypatch.setattr(crawl, "BLOCK", 3)
    r = random.Random(1)
    rows = [(f"h{r.randrange(4)}", k, r.choice(["waf", None, "rate_limited", "x", "x", "x"])) for k in range(300)]
    want = {}
    for h, _, c in rows:
        p, n = want.get(h, (0.0, 0))
        hit = c in ("waf", "rate_limited")
        want[h] = (min(max(2 * p, 0.5), 6.0) if hit else (0.0 if p / 2 <= 0.1 else p / 2), n + hit)
    got = crawl.penalties(spark.createDataFrame(rows, "host string, ord long, category string"), 6.0).collect()
    assert {g["host"]: (g["penalty"], g["refusals"]) for g in got} == want


def test_sitemaps_are_followed_one_level_deep(spark):
    index = "<sitemapindex><sitemap><loc>/s1.xml</loc></sitemap><sitemap><loc>/gone.xml</loc></sitemap></sitemapindex>"
    one = "<urlset>" + "".join(f"<url><loc>https://a.com/{p}</loc></url>" for p in ("api/x", "about", "login")) + "<sitemap><loc>/s2.xml</loc></sitemap></urlset>"
    docs = spark.createDataFrame([(1, "https://a.com/sitemap.xml", index), (2, "https://a.com/s1.xml", one), (3, "https://a.com/s2.xml", one)], "artifact_id long, url string, body string")
    seeds = spark.createDataFrame([("https://a.com/sitemap.xml", 0)], "url string, ord int")
    got = {(r["source_url"], r["url"], r["type"], r["method"]) for r in crawl.sitemap_pages(seeds, docs).collect()}
    assert got == {("https://a.com/s1.xml", "https://a.com/api/x", "REST", "GET"), ("https://a.com/s1.xml", "https://a.com/login", "Authentication", "POST")}
    assert crawl.sitemap_pages(seeds, docs, pages=1).count() == 1
    assert crawl.sitemap_pages(seeds, docs, rounds=3).count() == 4
    assert crawl.sitemap_pages(seeds.limit(0), docs).count() == 0


def test_absorbed_and_schema_stage(spark):
    js = 'a = "/docs/swagger.json"; b = "/swagger-ui/index.html"; c = "/arcgis/rest/services/R/MapServer/0"; d = "/geoserver/wfs?service=WFS"; e = "/graphql"; f = "/api/chunk.1.js"; apiUrl = "https://api.a.com/b"; r = {path: "home"}'
    arts = spark.createDataFrame([(1, "https://a.com/app.js", "js", "JavaScript", js)], "artifact_id long, url string, kind string, source_kind string, body string")
    found = crawl.absorbed(extract.analyze(arts), arts, "https://a.com/")
    by = {}
    for r in found.collect():
        by.setdefault(r["bucket"], set()).add(r["url"])
    assert {"https://a.com/docs/swagger.json", "https://a.com/swagger-ui/index.html"} <= by["schema"] and "https://a.com/arcgis/rest/services/R/MapServer" in by["arcgis"]
    assert by["base"] == {"https://api.a.com/b"} and by["route"] == {"https://a.com/home"} and "https://a.com/api/chunk.1.js" in by["asset"] and "https://a.com/graphql" in by["graphql"]
    captured = spark.createDataFrame(
        [(11, "https://a.com/swagger-ui/swagger.json", "json", '{"swagger": "2.0", "paths": {"/p": {"get": {}, "post": {}}}}'), (12, "https://a.com/arcgis/rest/services/R/MapServer?f=json", "json", '{"currentVersion": 1, "layers": [{"id": 0}]}'), (13, "https://b.com/swagger.json", "json", '{"swagger": "2.0", "paths": {"/q": {"get": {}}}}')],
        "artifact_id long, url string, kind string, body string",
    )
    rows = crawl.schema_stage(found, captured, "https://a.com/").collect()
    urls = {r["url"] for r in rows}
    assert {"https://a.com/p", "https://a.com/arcgis/rest/services/R/MapServer/0/query"} <= urls and not any("b.com" in u for u in urls)
    assert [r["evidence"] for r in rows if r["type"] == "Swagger/OpenAPI"] == ["OpenAPI document with 2 operations"]
    few = crawl.absorbed(extract.analyze(arts), arts, "https://a.com/", limits={"schema": 1})
    count = lambda df, b: df.where(F.col("bucket") == b).count()
    assert count(few, "schema") == 1 and count(few, "asset") == count(found, "asset")


def test_cookie_files(spark):
    files = [("list", '[{"name": "a", "value": 1, "domain": ".x.com"}, {"name": "a", "value": "2", "domain": "x.com", "secure": true}, {"value": "z"}, 5]'), ("flat", '{"k": "v", "n": 1.5, "o": {}}'), ("tabs", "# c\n#HttpOnly_.x.com\tTRUE\t/p\ttrue\t0\tsid\tabc\nshort\tline\n"), ("bad", "[1"), ("none", None)]
    got = cookies.read_cookies(spark.createDataFrame(files, "file string, body string"))
    assert {(r["file"], r["name"], r["value"], r["domain"], r["path"], r["secure"]) for r in got.collect()} == {("list", "a", "1", "x.com", "/", False), ("list", "a", "2", "x.com", "/", True), ("flat", "k", "v", "", "/", False), ("flat", "n", "1.5", "", "/", False), ("tabs", "sid", "abc", "x.com", "/p", True)}
    given = spark.createDataFrame([("flat", "k", "mine")], "file string, name string, value string")
    assert {(r["file"], r["name"], r["value"]) for r in cookies.merged(got, given).collect()} == {("list", "a", "2"), ("flat", "k", "mine"), ("flat", "n", "1.5"), ("tabs", "sid", "abc")}


def test_stream_matches_batch(spark, tmp_path):
    from spindrift.streaming import ingest

    schema = "artifact_id long, url string, kind string, source_kind string, body string"
    for k in range(2):
        spark.createDataFrame([(k, f"https://www.a.com/{k}.js", "js", "JavaScript", JS)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest.start(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = merge.merge_observations(extract.analyze(spark.read.parquet(str(tmp_path / "in"))))
    key = lambda df: sorted((r["method"], r["url"]) for r in df.select("method", "url").collect())
    assert key(ingest.merged(spark, str(tmp_path / "out"))) == key(batch)


def test_entry_has_sql_for_known_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 60
    assert F is not None
