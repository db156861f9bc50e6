"""What an endpoint is, how it is called, and what a response says, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import any_of, let, part

# fixed values: types with their interest, and markers in the order they are tried
INTEREST = {
    "GraphQL": 100, "Swagger/OpenAPI": 95, "Authentication": 90, "REST": 85, "ArcGIS REST": 80, "GeoServer": 78, "Image Service": 70,
    "WebSocket": 68, "SOAP": 60, "Stream/SSE": 58, "Tile Server": 40, "Static JSON": 30, "Unknown": 10,
}
CONFIDENCE = {"low": 0, "medium": 1, "high": 2}
SWAGGER = [
    "swagger.json", "swagger.yaml", "swagger.yml", "openapi.json", "openapi.yaml", "openapi.yml", "/swagger-ui", "/swagger/", "/api-docs",
    "/apidocs", "/redoc", "/v2/api-docs", "/v3/api-docs", "/openapi",
]
GRAPHQL = [
    "/graphql", "/graphiql", "/gql", "/altair", "/playground", "/subscriptions",
]
ARCGIS = [
    "/mapserver", "/featureserver", "/sceneserver", "/geometryserver", "/gpserver", "/geocodeserver", "/geodataserver", "/globeserver",
    "/streamserver", "/arcgis/rest/",
]
OGC_SERVICES = [
    "wms", "wmts", "wfs", "wcs", "csw", "wps",
]
OGC = [
    "/geoserver", "/ows", "/wms", "/wmts", "/wfs", "/wcs", "/mapserv", "/qgis",
]
TILES = [
    "{z}", "{x}", "{y}", "{-y}", "/tiles/", "/tile/", ".pbf", ".mvt", "/wmts",
]
AUTH = [
    "login", "signin", "sign-in", "logout", "signout", "register", "signup", "oauth", "oauth2", "token", "authorize", "auth", "sso", "saml",
    "session", "password", "forgot", "reset", "verify", "otp", "mfa", "2fa", "refresh", "identity", "jwt", "openid-configuration", "connect",
]
STREAMS = [
    "sse", "stream", "streams", "eventsource", "event-stream", "livestream",
]
REST = [
    "/api/", "/api?", "/apis/", "/rest/", "/restapi", "/services/", "/service/", "/rpc/", "/ajax/", "/query", "/graph/", "/gateway/", "/backend/",
    "/data/",
]
STATIC = [
    ".json", ".geojson", ".topojson", ".xml", ".csv", ".yaml", ".yml",
]
MUTATING = [
    "create", "update", "delete", "remove", "insert", "add", "save", "submit", "upload", "edit", "modify", "post", "put", "patch", "send", "apply",
]
VENDORS = (
    ("cf-mitigated", "", "Cloudflare"), ("cf-ray", "", "Cloudflare"), ("cf-chl-bypass", "", "Cloudflare"), ("server", "cloudflare", "Cloudflare"),
    ("x-sucuri-id", "", "Sucuri"), ("x-sucuri-block", "", "Sucuri"), ("x-iinfo", "", "Imperva/Incapsula"), ("x-cdn", "incapsula", "Imperva/Incapsula"),
    ("x-akamai-transformed", "", "Akamai"), ("server", "akamaighost", "Akamai"), ("x-amzn-waf-action", "", "AWS WAF"), ("x-datadome", "", "DataDome"),
    ("x-px-block", "", "PerimeterX"), ("server", "awselb", "AWS ELB"),
)
CHALLENGES = [
    "just a moment...", "cf-browser-verification", "checking your browser before accessing", "attention required! | cloudflare", "__cf_chl", "cf_chl_opt",
    "enable javascript and cookies to continue", "ddos protection by", "request unsuccessful. incapsula", "access denied | ", "you have been blocked", "_imperva_",
]
RETRYABLE = ["timeout", "connection", "protocol", "rate_limited", "server_error"]


def segment_of(path: Column, names: list[str]) -> Column:
    """Whether one of the names is a whole path segment."""
    return path.rlike("(?:^|/)(?:" + "|".join(n.replace("-", "\\-") for n in names) + ")(?:[/?]|$)")


def _ends(path: Column, endings: list[str]) -> Column:
    return path.rlike("(?:" + "|".join("\\" + e for e in endings) + ")$")


def classify(url: Column, hint: Column | None = None, body_type: Column | None = None) -> Column:
    """The first rule that holds, from the most specific to the most general."""
    hint, body_type = (F.lit("") if c is None else F.coalesce(c, F.lit("")) for c in (hint, body_type))
    given = F.struct(F.lower(part(url, 1)).alias("scheme"), F.lower(part(url, 3)).alias("path"), F.lower(part(url, 4)).alias("query"), F.lower(F.concat(hint, F.lit(" "), body_type)).alias("context"), body_type.alias("body"))
    whole = lambda x: F.when(x["query"] == "", x["path"]).otherwise(F.concat(x["path"], F.lit("?"), x["query"]))
    return let(let(given, lambda x: F.struct(x["scheme"].alias("scheme"), x["path"].alias("path"), x["query"].alias("query"), x["context"].alias("context"), x["body"].alias("body"), whole(x).alias("whole"))), _kind)


def _kind(x: Column) -> Column:
    path, query, whole, context, body_type = (x[n] for n in ("path", "query", "whole", "context", "body"))
    service = lambda names: query.rlike("(?:^|&)service=(?:" + "|".join(names) + ")(?:&|$)")
    ogc_path = any_of(path, OGC)
    rest = any_of(whole, REST) | path.rlike(r"/api(?:s|v\d{1,2}|_v\d{1,2}|\d{1,2})?(?:/|\?|$)") | path.rlike(r"/v[1-9]\d?(?:/|$)")
    return (
        F.when(x["scheme"].isin("ws", "wss"), "WebSocket")
        .when(any_of(whole, SWAGGER), "Swagger/OpenAPI")
        .when(any_of(path, GRAPHQL) | context.contains("graphql"), "GraphQL")
        .when(path.contains("/imageserver"), "Image Service")
        .when(path.contains("/vectortileserver"), "Tile Server")
        .when(any_of(path, ARCGIS), "ArcGIS REST")
        .when(service(["wmts"]), "Tile Server")
        .when(service(OGC_SERVICES), "GeoServer")
        .when(ogc_path & path.contains("wmts"), "Tile Server")
        .when(ogc_path | whole.contains("getcapabilities"), "GeoServer")
        .when(any_of(whole, TILES), "Tile Server")
        .when(segment_of(path, AUTH), "Authentication")
        .when(whole.contains("wsdl") | context.contains("soap"), "SOAP")
        .when(segment_of(path, STREAMS) | context.contains("eventsource"), "Stream/SSE")
        .when(rest & _ends(path, STATIC) & ~path.contains("/api"), "Static JSON")
        .when(rest, "REST")
        .when(_ends(path, STATIC), "Static JSON")
        .when(body_type.isin("application/json", "application/geo+json", "application/ld+json"), "REST")
        .when(body_type.isin("text/xml", "application/xml"), "Static JSON")
        .otherwise("Unknown")
    )


def guess_method(url: Column, kind: Column, observed: Column | None = None) -> Column:
    path = F.lower(part(url, 3))
    last = F.regexp_extract(path, "([^/]+)/*$", 1)
    seen = F.lit(None).cast("string") if observed is None else observed
    return (
        F.when(kind == "WebSocket", "ANY")
        .when(seen.isNotNull(), seen)
        .when(kind == "GraphQL", "POST")
        .when((kind == "Authentication") & segment_of(path, "login token signin sign-in register signup".split()), "POST")
        .when(last.isin(MUTATING), "POST")
        .otherwise("GET")
    )


def _lookup(value: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def is_documentation(kind: Column) -> Column:
    return kind == "Swagger/OpenAPI"


def interest(kind: Column) -> Column:
    return _lookup(kind, INTEREST, 0)


def confidence_rank(confidence: Column) -> Column:
    return _lookup(confidence, CONFIDENCE, -1)


def protection_vendor(headers: Column, body_head: Column) -> Column:
    """Vendor of a firewall or delivery network by lower-cased headers (a map), else by the body; null without one."""
    low = F.transform_values(F.transform_keys(headers, lambda k, _: F.lower(k)), lambda _, v: F.lower(F.coalesce(v, F.lit(""))))
    tried = lambda m: [F.when(F.element_at(m, h).contains(needle) if needle else F.element_at(m, h).isNotNull(), v) for h, needle, v in VENDORS]
    by_body = let(F.lower(body_head), lambda body: F.when(body.contains("cloudflare") & any_of(body, CHALLENGES), "Cloudflare"))
    return F.coalesce(let(low, lambda m: F.coalesce(*tried(m))), by_body)


def is_challenge(status: Column, headers: Column, body_head: Column) -> Column:
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    mitigated = F.coalesce(F.lower(F.element_at(low, "cf-mitigated")).contains("challenge"), F.lit(False))
    return any_of(F.lower(body_head), CHALLENGES) | mitigated | (status.isin(401, 403, 429, 503) & protection_vendor(headers, body_head).isNotNull())


def classify_response(status: Column, headers: Column, body_head: Column) -> Column:
    """Category of a response that can't be used; null for one that can."""
    return (
        F.when(is_challenge(status, headers, body_head), F.when(protection_vendor(headers, body_head) == "Cloudflare", "cloudflare").otherwise("waf"))
        .when(status == 403, "forbidden")
        .when(status == 404, "not_found")
        .when(status == 429, "rate_limited")
        .when(status.between(500, 599), "server_error")
        .when(status.between(400, 499), "client_error")
    )


def is_retryable(category: Column) -> Column:
    return category.isin(RETRYABLE)


def is_verifiable(url: Column, method: Column, status: Column) -> Column:
    return status.isNull() & part(url, 1).isin("http", "https") & method.isin("GET", "HEAD", "OPTIONS", "ANY")


def asset_kind(url: Column, content_type: Column) -> Column:
    """Kind of a document by its extension, else by its content type."""
    from .url import extension

    return let(F.struct(extension(url).alias("ext"), F.lower(F.coalesce(content_type, F.lit(""))).alias("kind")), _asset)


def _asset(x: Column) -> Column:
    ext, has = x["ext"], x["kind"].contains
    return (
        F.when(ext.isin("js", "mjs", "cjs", "jsx", "ts", "tsx"), "js")
        .when(ext == "css", "css")
        .when(ext == "map", "map")
        .when(ext.isin("json", "geojson", "topojson", "webmanifest"), "json")
        .when(ext.isin("xml", "rss", "atom", "kml", "wsdl"), "xml")
        .when(ext.isin("yaml", "yml"), "yaml")
        .when(ext.isin("html", "htm"), "html")
        .when(has("javascript") | has("ecmascript"), "js")
        .when(has("css"), "css")
        .when(has("json"), "json")
        .when(has("yaml"), "yaml")
        .when(has("xml"), "xml")
        .when(has("html"), "html")
        .otherwise("other")
    )
