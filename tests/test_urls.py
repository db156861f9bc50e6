"""Scalar conformance: (function, arguments, expected)."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import classify as C
from spindrift.functions import url as U

NORMAL = [
    ("HTTP://Example.COM:80/a/./b/../c?x=1#f", "http://example.com/a/c?x=1"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com:443//a///b/", "https://example.com/a/b/"),
    ("https://example.com/a/..", "https://example.com/"),
    ("https://example.com./x?", "https://example.com/x"),
    ("https://u:p@example.com:8443/x", "https://u:p@example.com:8443/x"),
    ("wss://example.com:443/s", "wss://example.com/s"),
    ("https://a_b.com/", None),
    ("https://[::1]/x", None),
    ("ftp://example.com/", None),
    ("https://-bad.com/", None),
    ("https://a..b/", None),
    ("https://localhost:3000/v1/", "https://localhost:3000/v1/"),
    ("https://example.com/{z}/{x}.pbf", "https://example.com/{z}/{x}.pbf"),
    ("not a url", None),
    (None, None),
]
RESOLVED = [
    ("https://a.com/x/y.html", "/z", "https://a.com/z"),
    ("https://a.com/x/y.html", "z?q=1", "https://a.com/x/z?q=1"),
    ("https://a.com/x/y.html", "../z", "https://a.com/z"),
    ("https://a.com/x/y.html", "//b.com/c", "https://b.com/c"),
    ("https://a.com/x", "https://c.com/d", "https://c.com/d"),
    ("https://a.com/x", "mailto:a@b.c", None),
    ("https://a.com/x", "data:text/plain,1", None),
    ("https://a.com/x?q=2", "?p=1", "https://a.com/x?p=1"),
    ("https://a.com", "b", "https://a.com/b"),
]
CLEAN = [
    ('"https:\\/\\/x.com\\/a"', "https://x.com/a"),
    ("/a/b)", "/a/b"),
    ("/wiki/Foo_(bar)", "/wiki/Foo_(bar)"),
    ("/a.", "/a"),
    ("/a..", "/a.."),
    ("/a&amp;b,;", "/a&b"),
    ("/a]}", "/a"),
    ("", ""),
]
PROBABLE = [("/api/x", True), ("/a", False), ("x", False), ("text/html", False), ("/1.2.3", False), ("https://a", True), ("/abc", True), ("/api/return", False), ("/s/g;n.f=function(b){", False), ("#x", False), ("javascript:void(0)", False), ("/*", False)]
TEMPLATE = [("https://a.com/u/12/x?id=7", "https://a.com/u/{id}/x?id=7"), ("https://a.com/9f2c", "https://a.com/9f2c"), ("https://a.com/0123456789abcdef", "https://a.com/{id}"), ("https://a.com/1234567890123", "https://a.com/1234567890123"), ("https://a.com/12345678", "https://a.com/{id}")]
KINDS = [
    ("https://a.com/graphql", "GraphQL"), ("wss://a.com/x", "WebSocket"), ("https://a.com/swagger.json", "Swagger/OpenAPI"), ("https://a.com/x/ImageServer", "Image Service"),
    ("https://a.com/wmsomething", "GeoServer"), ("https://a.com/ows?service=WMTS", "Tile Server"), ("https://a.com/App_Themes/reset.css", "Unknown"), ("https://a.com/reset", "Authentication"),
    ("https://a.com/apiv2/events", "REST"), ("https://a.com/apiary", "Unknown"), ("https://a.com/data/x.json", "Static JSON"), ("https://a.com/api/x.json", "REST"), ("https://a.com/x.asmx?wsdl", "SOAP"),
    ("https://a.com/v3/items", "REST"), ("https://a.com/sse", "Stream/SSE"), ("https://a.com/t/{z}/{x}/{y}", "Tile Server"),
]


def check(spark, rows, use, n):
    names = [f"a{k}" for k in range(n)]
    schema = ", ".join(f"{c} string" for c in names)
    df = spark.createDataFrame([r[:n] for r in rows], schema)
    got = [r[0] for r in df.coalesce(1).select(use(*[F.col(c) for c in names])).collect()]
    assert got == [r[n] for r in rows]


@pytest.mark.parametrize(
    ("rows", "use", "n"),
    [
        (NORMAL, U.normalize, 1), (RESOLVED, U.absolutize, 2), (CLEAN, U.clean_candidate, 1), (PROBABLE, U.is_probably_url, 1), (TEMPLATE, U.templatize, 1), (KINDS, C.classify, 1),
        ([("www.a.co.uk", "a.co.uk"), ("a.b.com", "b.com"), ("10.0.0.1", "10.0.0.1"), ("localhost", "localhost"), ("x.gov.tr", "x.gov.tr")], U.registered_domain, 1),
        ([("https://a.com/x.JS", "js"), ("https://a.com/x", ""), ("https://a.com/a%2Ejson", "json"), ("https://a.com/a.b/c", "")], U.extension, 1),
        ([("https://a.com/x?b=1&a&b=2", ["a", "b"]), ("https://a.com/", [])], U.query_names, 1),
    ],
)
def test_scalars(spark, rows, use, n):
    check(spark, rows, use, n)


def test_scope_and_hosts(spark):
    one = spark.createDataFrame([("https://api.a.com/x",)], "url string")
    u = F.col("url")
    row = one.select(
        U.same_scope(u, F.lit("https://www.a.com/")), U.same_scope(u, F.lit("https://www.a.com/"), False), U.host_allowed(u, ["*.a.com"], ["api.a.com"]),
        U.host_allowed(u, [], []), U.matches_filters(u, ["API"], []), U.parent_service(u, "missing"),
    ).first()
    assert list(row) == [True, False, False, True, True, None]
    assert U.host_suffix(" https://*.Example.com:80/x ") == "example.com"
    assert U.slugify("https://a.com/b/c") == "a.com_b_c"


def test_methods(spark):
    rows = [("https://a.com/login", "Authentication", None, "POST"), ("https://a.com/x/save", "REST", None, "POST"), ("https://a.com/x/save", "REST", "DELETE", "DELETE"), ("wss://a.com", "WebSocket", "GET", "ANY"), ("https://a.com/q", "GraphQL", None, "POST"), ("https://a.com/", "REST", None, "GET")]
    check(spark, rows, C.guess_method, 3)
