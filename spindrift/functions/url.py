"""URL functions as Column expressions: no UDF, so they stay inside generated code.

URLs are split with the RFC 3986 pattern and never with parse_url, which rejects
templates such as `{z}` and hosts it doesn't like.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

# fixed values: suffixes of two labels under which names are registered
SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "com.tr", "org.tr", "net.tr", "gov.tr", "edu.tr", "bel.tr", "k12.tr", "av.tr", "com.au",
    "net.au", "org.au", "gov.au", "edu.au", "com.br", "com.cn", "com.mx", "com.ar", "com.sg", "com.hk", "com.tw", "co.jp", "or.jp", "ne.jp", "ac.jp",
    "go.jp", "co.kr", "or.kr", "go.kr", "co.in", "net.in", "org.in", "gov.in", "ac.in", "co.za", "org.za", "gov.za", "co.nz", "net.nz", "govt.nz",
    "com.es", "gob.es", "com.pl", "gov.pl", "com.ua", "gov.ua", "com.sa", "gov.sa", "com.eg", "gov.eg", "com.my", "gov.my",
]
# fixed values: path markers that keep a weak candidate
API_MARKERS = [
    "/api", "/rest", "/graphql", "/gql", "/v1/", "/v2/", "/v3/", "/v4/", "/services/", "/service/", "/rpc", "/ajax", "/json", "/data/", "/query",
    "mapserver", "featureserver", "imageserver", "sceneserver", "vectortileserver", "geometryserver", "gpserver", "geoserver", "geocode", "/ows",
    "/wms", "/wfs", "/wmts", "/wcs", "getcapabilities", "/oauth", "/token", "/login", "/auth", "/swagger", "/openapi", "/api-docs", "/.well-known/",
    "/sitemap", "/feed", "/rss", "/upload", "/download", "/export", "/search", "/session",
]
# fixed values: extensions
BINARY = [
    "png", "jpg", "jpeg", "gif", "webp", "avif", "bmp", "ico", "svg", "woff", "woff2", "ttf", "otf", "eot", "mp4", "webm", "mp3", "ogg", "wav",
    "pdf", "zip", "gz", "br", "wasm",
]
ANALYSABLE = [
    "js", "mjs", "cjs", "jsx", "ts", "tsx", "map", "json", "geojson", "topojson", "css", "xml", "yaml", "yml", "txt", "webmanifest",
]
PAGES = ["", "html", "htm", "php", "asp", "aspx", "jsp", "do", "action"]
# fixed values: paths of delivery networks and firewalls
INFRASTRUCTURE = [
    "/cdn-cgi/", "/_incapsula_resource", "/_sucuri/", "/akam/", "/_vercel/insights", "/_vercel/speed-insights", "/__nextjs_original-stack-frame",
    "/.well-known/traffic-advice",
]
# fixed values: what hosts look like, and what code does that no URL holds
HOST = r"(?i)^(?:(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}|\d{1,3}(?:\.\d{1,3}){3}|[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)$"
CODE = r"=\s*function|function\s*\(|\)\s*\{|\}\s*[;)(]|=>|;\s*[A-Za-z_$][\w$]*\s*[.(]|\breturn\b|\btypeof\b|\binstanceof\b|\bprototype\b"


def let(value: Column, use) -> Column:
    """Bind a value once: use(value) may name it often without the expression growing by its size each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn that the optimizer doesn't write out again wherever the column is used: one row is generated from one."""
    return df.drop(name).select("*", F.explode(F.array(value)).alias(name))


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query."""
    return F.regexp_extract(F.trim(url), _SPLIT, group)


def _parts(url: Column) -> Column:
    names = ("scheme", "authority", "path", "query")
    return let(url, lambda u: F.struct(*[part(u, k + 1).alias(n) for k, n in enumerate(names)]))


def any_of(value: Column, markers: list[str]) -> Column:
    """Whether the value contains one of the markers. One pattern, so that the value stands in the plan once."""
    return value.rlike("|".join(re.sub(r"([^\w/ ])", r"\\\1", m) for m in markers))


def clean_candidate(raw: Column) -> Column:
    """Unescape what source code escapes, cut at the first character no URL literal holds, trim what follows one."""
    v = F.regexp_replace(F.trim(raw), "^[\"'`]+|[\"'`]+$", "")
    for a, b in (("\\/", "/"), ("\\u002F", "/"), ("\\u002f", "/"), ("\\u0026", "&"), ("&amp;", "&"), ("\\n", ""), ("\\r", ""), ("\\t", ""), ("\\\\", "\\")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return let(F.regexp_extract(v, "^[^\"'`<>|^\\\\ \\t\\r\\n]*", 0), trim_punctuation)


def trim_punctuation(value: Column) -> Column:
    """Drop prose punctuation at the end, and closing brackets while they outnumber the opening ones."""

    def step(v: Column) -> Column:
        last = F.right(v, F.lit(1))
        unbalanced = F.lit(False)
        for o, c in ("()", "[]", "{}"):
            count = lambda x: F.length(v) - F.length(F.replace(v, F.lit(x), F.lit("")))  # noqa: B023, E731
            unbalanced = unbalanced | ((last == c) & (count(c) > count(o)))
        drop = last.isin(list(",;:!*'\"")) | ((last == ".") & ~v.endswith("..")) | unbalanced
        return F.when(drop, F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(v)

    tail = F.length(F.regexp_extract(value, "[,;:!*'\".)\\]}]*$", 0))
    return F.aggregate(F.sequence(F.lit(0), tail), value, lambda acc, _: step(acc))


def is_probably_url(candidate: Column) -> Column:
    """Whether a cleaned candidate is worth resolving."""
    return let(F.trim(candidate), _probable)


def _probable(v: Column) -> Column:
    low = F.lower(v)
    rejected = (
        ~F.length(v).between(2, 2048)
        | v.rlike(r"(?i)^(data|blob|javascript|mailto|tel|sms|about|chrome|moz-extension):")
        | v.rlike(CODE)
        | v.startswith("#")
        | v.isin("/", "//", "./", "../")
        | (v.rlike(r"(?i)^[a-z]+/[a-z0-9.+-]+$"))
        | v.rlike(r"^/?\d+(\.\d+)+/?$")
    )
    absolute = reduce(lambda a, b: a | b, [v.startswith(p) for p in ("http://", "https://", "ws://", "wss://", "//")])
    segments = F.filter(F.split(v, "/"), lambda s: s != "")
    first = F.get(segments, F.lit(0))
    path = v.startswith("/") & ~v.rlike(r"^/[*+\-.,;:!?()\[\]{}=<>~^|&%$#@ ]*$")
    kept = any_of(low, API_MARKERS) | (F.size(segments) >= 2) | first.contains(".") | (F.length(first) >= 3)
    return F.coalesce(~rejected & (absolute | (path & kept)), F.lit(False))


def remove_dots(path: Column) -> Column:
    """Resolve `.` and `..` in an absolute path; a trailing slash stays."""
    kept = F.aggregate(
        F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    flat = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.endswith("/") & ~flat.endswith("/"), F.concat(flat, F.lit("/"))).otherwise(flat)


def normalize(url: Column, keep_query: bool = True) -> Column:
    """The normal form of an http(s) or ws(s) URL; null if it isn't one."""
    return let(_parts(url), lambda p: _normal(p, keep_query))


def _normal(p: Column, keep_query: bool) -> Column:
    place = F.regexp_extract(p["authority"], "([^@]*)$", 1)
    port = F.regexp_replace(F.regexp_extract(place, r":(\d*)$", 1), "^0+(?=.)", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(place, r"^([^:]*)(?::\d*)?$", 1)), r"\.+$", "")
    path = F.regexp_replace(F.when(p["path"] == "", "/").otherwise(p["path"]), "/{2,}", "/")
    pieces = F.struct(F.lower(p["scheme"]).alias("scheme"), host.alias("host"), port.alias("port"), path.alias("path"), F.regexp_extract(p["authority"], "^(.*)@", 1).alias("user"))

    def put(x: Column) -> Column:
        default = F.when(x["scheme"].isin("http", "ws"), F.lit("80")).otherwise("443")
        good = x["scheme"].isin("http", "https", "ws", "wss") & x["host"].rlike(HOST) & (F.length(x["port"]) <= 5) & (F.lpad(x["port"], 5, "0") <= "65535")
        login = F.when(x["user"].rlike("^(?::|$)"), "").otherwise(F.concat(F.regexp_replace(x["user"], ":$", ""), F.lit("@")))
        shown = F.when((x["port"] == "") | (x["port"] == default), "").otherwise(F.concat(F.lit(":"), x["port"]))
        clean = F.when(x["path"].contains("."), remove_dots(x["path"])).otherwise(x["path"])
        query = F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"])) if keep_query else F.lit("")
        return F.when(good, F.concat(x["scheme"], F.lit("://"), login, x["host"], shown, clean, query))

    return let(pieces, put)


def absolutize(base: Column, candidate: Column) -> Column:
    """Resolve a candidate against the URL of the artefact it was found in; null if it can't be one."""
    return let(F.struct(_parts(base).alias("b"), F.trim(candidate).alias("c")), lambda x: _resolved(x["b"], x["c"]))


def _resolved(b: Column, given: Column) -> Column:
    def join(v: Column) -> Column:
        origin_ = F.concat(b["scheme"], F.lit("://"), b["authority"])
        path = F.when(b["path"] == "", "/").otherwise(b["path"])
        query = F.when(b["query"] == "", "").otherwise(F.concat(F.lit("?"), b["query"]))
        own = F.regexp_extract(v, r"^([^?#]*)", 1)
        rest = F.regexp_extract(v, r"^[^?#]*(.*)$", 1)
        merged = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_extract(path, "^(.*/)", 1), own))
        closed = let(merged, lambda m: F.when(m.rlike(r"(^|/)\.{1,2}(/|$)"), _closed(m)).otherwise(m))
        return (
            F.when(v == "", F.lit(None).cast("string"))
            .when(v.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.when(v.rlike("(?i)^(https?|wss?)://"), v))
            .when(v.startswith("?"), F.concat(origin_, path, v))
            .when(v.startswith("#"), F.concat(origin_, path, query, v))
            .otherwise(F.concat(origin_, closed, rest))
        )

    scheme = F.when(b["scheme"] == "", "https").otherwise(b["scheme"])
    return let(F.when(given.startswith("//"), F.concat(scheme, F.lit(":"), given)).otherwise(given), join)


def _closed(path: Column) -> Column:
    """Dot segments of a reference; a last `.` or `..` names a folder."""
    return let(F.when(path.rlike(r"/\.{1,2}$"), F.concat(path, F.lit("/"))).otherwise(path), remove_dots)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(part(url, 2), "([^@]*)$", 1), "^([^:]*)", 1))


def origin(url: Column) -> Column:
    return F.concat(part(url, 1), F.lit("://"), part(url, 2))


def registered_domain(host: Column) -> Column:
    """The last two labels, or three under a suffix of two; addresses and short names as they are."""

    def cut(h: Column) -> Column:
        labels = F.split(h, r"\.")
        two, three = (F.array_join(F.slice(labels, -k, k), ".") for k in (2, 3))
        return F.when((h == "") | h.rlike(r"^[\d.]+$") | (F.size(labels) <= 2), h).otherwise(F.when(two.isin(SUFFIXES), three).otherwise(two))

    return let(F.regexp_replace(F.lower(F.regexp_extract(host, "^([^:]*)", 1)), r"^\.+|\.+$", ""), cut)


def same_scope(url: Column, base: Column, follow_subdomains: bool = True, same_origin_only: bool = False) -> Column:
    if same_origin_only:
        return F.lower(origin(url)) == F.lower(origin(base))
    same = host_of(url) == host_of(base)
    return same | (registered_domain(host_of(url)) == registered_domain(host_of(base))) if follow_subdomains else same


def extension(url: Column) -> Column:
    """Extension of the last path segment without its dot, lower case; "" if there is none."""

    def of(name: Column) -> Column:
        plain = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
        return F.lower(F.regexp_extract(plain, r"\.([A-Za-z0-9]{1,10})$", 1))

    return let(F.regexp_extract(part(url, 3), "([^/]*)$", 1), of)


def is_infrastructure(url: Column) -> Column:
    return any_of(F.lower(part(url, 3)), INFRASTRUCTURE)


def is_binary(url: Column) -> Column:
    return extension(url).isin(BINARY)


def is_analysable(url: Column) -> Column:
    return extension(url).isin(ANALYSABLE)


def is_html_like(url: Column) -> Column:
    return extension(url).isin(PAGES)


def strip_placeholders(url: Column) -> Column:
    return F.regexp_replace(url, r"\$\{[^}]*\}|\{\{[^}]*\}\}|<%[^%]*%>|%[0-9a-fA-F]{2}", ":var")


def host_suffix(value: str) -> str:
    """What a user gave as a host filter, as a bare suffix."""
    v = value.strip().lower()
    v = v.split("://", 1)[1] if "://" in v else v
    return v.split("/")[0].split(":")[0].removeprefix("*.").strip(".")


def host_matches(url: Column, suffixes: list[str]) -> Column:
    names = [s for s in map(host_suffix, suffixes) if s]
    one = lambda host, s: (host == s) | host.endswith("." + s)
    return let(host_of(url), lambda host: reduce(lambda a, b: a | b, [one(host, s) for s in names], F.lit(False)))


def host_allowed(url: Column, allow: list[str], deny: list[str]) -> Column:
    return (host_matches(url, allow) if allow else F.lit(True)) & ~host_matches(url, deny)


def matches_filters(url: Column, include: list[str], exclude: list[str]) -> Column:
    hit = lambda patterns: reduce(lambda a, b: a | b, [url.rlike("(?i)" + p) for p in patterns], F.lit(False))
    return ~hit(exclude) & (hit(include) if include else F.lit(True))


def parent_service(url: Column, marker: str) -> Column:
    """The URL up to the first path segment that equals the marker, without its query; null without one."""
    segments = F.split(part(url, 3), "/")
    at = F.array_position(F.transform(segments, F.lower), marker.lower())
    return F.when(at > 0, F.concat(origin(url), F.array_join(F.slice(segments, F.lit(1), F.greatest(at.cast("int"), F.lit(1))), "/")))


def templatize(url: Column) -> Column:
    """Numbers, UUIDs and long hex segments of the path become {id}."""
    pattern = r"^(?:\d{1,12}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,64})$"
    path = F.array_join(F.transform(F.split(part(url, 3), "/"), lambda s: F.when(s.rlike(pattern), "{id}").otherwise(s)), "/")
    query = part(url, 4)
    return F.concat(origin(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def query_names(url: Column) -> Column:
    """Sorted different names of the query's parameters."""
    names = F.transform(F.split(part(url, 4), "&"), lambda p: F.coalesce(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)), F.regexp_extract(p, "^([^=]*)", 1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def slugify(target: str) -> str:
    """A file name for a target."""
    import re
    from urllib.parse import urlsplit

    parts = urlsplit(target if "://" in target else f"https://{target}")
    name = re.sub(r"[^A-Za-z0-9._-]+", "-", f"{parts.netloc}{parts.path.replace('/', '_')}").strip("-_.")
    return name[:80] or "scan"


def normalise_target(given: Column) -> Column:
    """What a user gives as a target, as an address; null if it isn't one of the web."""
    v = F.trim(given)
    whole = normalize(F.when(v.contains("://"), v).otherwise(F.concat(F.lit("https://"), v)))
    return F.when((v != "") & whole.rlike("^https?://"), whole)


def to_websocket(url: Column) -> Column:
    return F.regexp_replace(url, "^http", "ws")
