"""Expansion of documents that describe services: robots, sitemaps, manifests, headers, cookies, well-known
files, source maps, OpenAPI, ArcGIS catalogues and OGC capabilities.

Tolerant parsing (JSON, YAML, XML with namespaces) happens in one Arrow map, which gives candidates; resolving,
normal form and classification are column expressions, the same for all kinds.
"""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.classify import classify, guess_method
from .extract import ARCGIS_KINDS, ARCGIS_TYPES, ogc_base, ogc_service

FIELDS = "artifact_id long, source_url string, ord int, source string, candidate string, method string, kind string, evidence string, confidence string, params array<string>, tags array<string>, strip boolean"
_ARROW = pa.schema(
    [("artifact_id", pa.int64()), ("source_url", pa.string()), ("ord", pa.int32())]
    + [(n, pa.string()) for n in ("source", "candidate", "method", "kind", "evidence", "confidence")]
    + [("params", pa.list_(pa.string())), ("tags", pa.list_(pa.string())), ("strip", pa.bool_())]
)
# fixed values: verbs of OpenAPI, and what ArcGIS services offer
OPENAPI_VERBS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]
ARCGIS_OPERATIONS = {
    "mapserver": ("export", "identify", "find", "legend", "layers"),
    "featureserver": ("query", "queryRelatedRecords", "layers"),
    "imageserver": ("exportImage", "identify", "computeStatisticsHistograms"),
    "vectortileserver": ("resources/styles/root.json", "tilemap"),
    "geocodeserver": ("findAddressCandidates", "suggest", "reverseGeocode"),
    "geometryserver": ("project", "buffer", "areasAndLengths"),
}
OGC_OPERATIONS = ["getmap", "getfeature", "getcapabilities", "getfeatureinfo", "gettile", "describefeaturetype", "getcoverage", "describecoverage", "transaction", "getlegendgraphic", "getrecords", "execute", "describeprocess"]
OGC_LAYERS = ["layer", "featuretype", "coveragesummary", "coverage", "record"]


def _row(source: str, candidate: str, evidence: str, confidence: str = "high", method: str | None = None, kind: str | None = None, params=(), tags=(), strip: bool = True) -> dict:
    return {"source": source, "candidate": candidate, "method": method, "kind": kind, "evidence": " ".join(evidence.split())[:240], "confidence": confidence, "params": list(params), "tags": list(tags), "strip": strip}


def _tree(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def robots(text: str, url: str) -> list[dict]:
    out = []
    for m in re.finditer(r"^[ \t]*(?:dis)?allow[ \t]*:[ \t]*([^\s#]*)", text, re.I | re.M):
        if m.group(1) not in ("/", "*", ""):
            out.append(_row("robots.txt", m.group(1).replace("*", "").rstrip("$"), m.group(0).strip(), "medium"))
    return out


def sitemap_entries(text: str) -> list[tuple[str, bool]]:
    """Locations by local name, and whether each is a sitemap of an index; a broken document still gives those a pattern finds."""
    local = lambda e: str(e.tag).rpartition("}")[2].lower()
    try:
        root = ElementTree.fromstring(text.strip())
    except ElementTree.ParseError:
        index = "<sitemapindex" in text.lower()
        return [(x, index) for x in re.findall(r"<(?:\w+:)?loc[^>]*>\s*([^<]+?)\s*<", text)]
    index = local(root) == "sitemapindex"
    found = [((e.text or "").strip(), index or local(above) == "sitemap") for above in root.iter() for e in above if local(e) == "loc"]
    return [(x, nested) for x, nested in found if x]


def sitemap(text: str, url: str) -> list[dict]:
    return [_row("sitemap.xml", x, "sitemap", "medium") for x, _ in sitemap_entries(text)]


def sitemap_locations(artifacts: DataFrame) -> DataFrame:
    """url, ord, location and nested of every entry of sitemaps (url, body)."""

    def run(batches):
        for batch in batches:
            rows = [(u, k, x, n) for u, text in zip(*(c.to_pylist() for c in batch.columns)) for k, (x, n) in enumerate(sitemap_entries(text or ""))]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, kinds)], names=["url", "ord", "location", "nested"])

    return artifacts.select("url", "body").mapInArrow(run, "url string, ord int, location string, nested boolean")


def manifest(text: str, url: str) -> list[dict]:
    d = _tree(text)
    if not isinstance(d, dict):
        return []
    share = d.get("share_target") if isinstance(d.get("share_target"), dict) else {}
    found = [(d.get(k), k, None) for k in ("start_url", "scope", "id")] + [(share.get("action"), "share_target", "POST")]
    found += [(r.get("url"), "related", None) for k in ("related_applications", "shortcuts") for r in d.get(k) or () if isinstance(r, dict)]
    return [_row("manifest.json", v, what, "medium", m) for v, what, m in found if isinstance(v, str) and v]


def well_known(text: str, url: str) -> list[dict]:
    d = _tree(text)
    if not isinstance(d, dict):
        return [_row("well-known", x, "well-known", "low") for x in re.findall(r"https?://[^\s'\"<>]+", text)]
    out = []
    for k, v in d.items():
        if isinstance(v, str) and v.startswith(("http://", "https://")):
            login = "openid" in url and ("endpoint" in k or "uri" in k)
            out.append(_row("well-known", v, k, kind="Authentication" if login else None, tags=[f"key:{k}"]))
    return out


def _names(parameters) -> set[str]:
    return {f"{p['name']}:{p.get('in') or 'query'}" for p in parameters or () if isinstance(p, dict) and isinstance(p.get("name"), str) and p["name"]} if isinstance(parameters, list) else set()


def openapi_tree(text: str):
    d = _tree(text) if text.lstrip()[:1] in ("{", "[") else None
    if d is None:
        try:
            import yaml

            d = yaml.safe_load(text)
        except Exception:
            return None
    return d if isinstance(d, dict) and ("swagger" in d or "openapi" in d) and isinstance(d.get("paths"), dict) else None


def openapi_bases(d: dict, url: str) -> list[str]:
    """Server URLs with their variables' defaults; for the older version schemes, host and base path; else the document's origin."""
    origin = "/".join(url.split("/")[:3])
    out: list[str] = []
    for s in d.get("servers") or ():
        if isinstance(s, dict) and isinstance(s.get("url"), str):
            v = s["url"]
            for name, about in (s.get("variables") or {}).items():
                v = v.replace("{" + name + "}", str((about or {}).get("default", "")))
            out.append((v if "://" in v else origin + "/" + v.lstrip("/")).rstrip("/"))
    if not out and d.get("host"):
        out = [f"{s}://{d['host']}{d.get('basePath') or ''}".rstrip("/") for s in d.get("schemes") or [url.split(":")[0]]]
    if not out:
        out = [(origin + (d.get("basePath") or "")).rstrip("/")]
    return list(dict.fromkeys(out))


def openapi(text: str, url: str) -> list[dict]:
    d = openapi_tree(text)
    if d is None:
        return []
    title = str((d.get("info") or {}).get("title") or "") if isinstance(d.get("info"), dict) else ""
    out = []
    for path, item in d["paths"].items():
        if not isinstance(path, str) or not isinstance(item, dict):
            continue
        for verb, op in item.items():
            if verb.lower() not in OPENAPI_VERBS:
                continue
            op = op if isinstance(op, dict) else {}
            tags = {"source:openapi"} | ({f"api:{title}"} if title else set()) | {f"tag:{t}" for t in op.get("tags") or () if isinstance(t, str)}
            if isinstance(op.get("operationId"), str) and op["operationId"]:
                tags.add(f"operationId:{op['operationId']}")
            told = str(op.get("summary") or op.get("description") or "")[:160] or f"{verb.upper()} {path}"
            params = sorted(_names(item.get("parameters")) | _names(op.get("parameters")))
            out += [_row("OpenAPI", f"{b}/{path.lstrip('/')}", told, method=verb.upper(), params=params, tags=sorted(tags)) for b in openapi_bases(d, url)]
    return out


def arcgis(text: str, url: str) -> list[dict]:
    d = _tree(text)
    if not isinstance(d, dict):
        return []
    root, out = url.split("?")[0].rstrip("/"), []
    say = lambda path, kind, told, *tags: out.append(_row("ArcGISCatalog", path, told, method="GET", kind=kind, tags=tags, strip=False))
    for s in d.get("services") or ():
        if isinstance(s, dict) and isinstance(s.get("name"), str) and s.get("type"):
            say(f"{root}/{s['name'].rpartition('/')[2]}/{s['type']}", ARCGIS_TYPES.get(s["type"].lower(), "ArcGIS REST"), f"catalog service {s['name']} ({s['type']})", f"arcgis:{s['type'].lower()}")
    for f in d.get("folders") or ():
        if isinstance(f, str):
            say(f"{root}/{f}", "ArcGIS REST", f"catalog folder {f}", "arcgis:folder")
    m = re.search(rf"^(.*?/({'|'.join(ARCGIS_KINDS)}))(?:/|$)", root, re.I)
    if m:
        service, kind = m.group(1), m.group(2).lower()
        is_a = ARCGIS_TYPES.get(kind, "ArcGIS REST")
        for layer in [x for k in ("layers", "tables") for x in d.get(k) or () if isinstance(x, dict) and x.get("id") is not None]:
            say(f"{service}/{layer['id']}", is_a, f"layer {layer['id']}: {layer.get('name') or ''}", f"arcgis:{kind}", f"layer:{layer['id']}")
            say(f"{service}/{layer['id']}/query", is_a, f"query operation for layer {layer['id']}", f"arcgis:{kind}", "operation:query")
        for op in ARCGIS_OPERATIONS.get(kind, ()):
            say(f"{service}/{op}", is_a, f"standard {kind} operation", f"arcgis:{kind}", f"operation:{op}")
        if d.get("singleFusedMapCache") or d.get("tileInfo"):
            say(f"{service}/tile/{{z}}/{{y}}/{{x}}", "Tile Server", "cached tile scheme", f"arcgis:{kind}", "operation:tile")
    return out


def capabilities(text: str, url: str) -> list[dict]:
    """Each advertised address with the operation around it, and one row with the layers' names."""
    try:
        root = ElementTree.fromstring(text.strip())
    except ElementTree.ParseError:
        return []
    local = lambda e: str(e.tag).rpartition("}")[2]
    out, layers = [], []

    def visit(e, above: list) -> None:
        href = e.get("{http://www.w3.org/1999/xlink}href") or e.get("href")
        if href:
            names = [n for a in reversed(above[-8:]) for n in (local(a), a.get("name") or "") if n.lower() in OGC_OPERATIONS]
            out.append(_row("GetCapabilities", href, names[0] if names else "OnlineResource", method="GET", tags=[f"operation:{n}" for n in names[:1]], strip=False))
        if above and local(e).lower() in ("name", "identifier") and local(above[-1]).lower() in OGC_LAYERS and (e.text or "").strip():
            layers.append(e.text.strip())
        for c in e:
            visit(c, [*above, e])

    visit(root, [])
    if layers:
        out.append(_row("GetCapabilities", url, f"{len(layers)} published layers", method="GET", params=list(dict.fromkeys(layers))[:100], tags=["layers"], strip=False))
    return out


_PARSERS = {"robots": robots, "sitemap": sitemap, "manifest": manifest, "well_known": well_known, "openapi": openapi, "arcgis": arcgis, "capabilities": capabilities}


OPENAPI_KEY = "[\"']?(?:openapi|swagger)[\"']?\\s*:"
NOT_DATA = ["js", "css", "html", "map"]


def document_kind():
    """Which parser a document goes to, by cheap looks at its address and its beginning; null: none."""
    path, head = F.lower(U.part(F.col("url"), 3)), F.lower(F.substring("body", 1, 2048))
    return (
        F.when(path.endswith("/robots.txt"), "robots")
        .when(path.contains("/.well-known/"), "well_known")
        .when(path.rlike("(?:manifest\\.json|\\.webmanifest)$"), "manifest")
        .when(head.contains("<urlset") | head.contains("<sitemapindex") | path.rlike("/sitemap[^/]*\\.xml$"), "sitemap")
        .when(head.rlike("_capabilities|<(?:\\w+:)?capabilities"), "capabilities")
        .when(head.contains("currentversion") | head.contains("servicedescription") | head.contains("singlefusedmapcache"), "arcgis")
        .when(head.rlike(OPENAPI_KEY), "openapi")
    )


def may_be_openapi(artifacts: DataFrame):
    """Whether a description's key stands anywhere in a text that isn't markup; of scripts, styles and pages only the beginning decides."""
    if "kind" not in artifacts.columns:
        data = F.lit(True)
    else:
        data = F.coalesce(~F.col("kind").isin(NOT_DATA), F.lit(True))
    return F.coalesce(data & ~F.col("body").rlike(r"^\s*<") & F.col("body").rlike(OPENAPI_KEY), F.lit(False))


def candidates(artifacts: DataFrame) -> DataFrame:
    """What the documents' parsers find, unresolved. What may be OpenAPI is tried as that before its beginning counts."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, url, body, kind, first in zip(*(c.to_pylist() for c in batch.columns)):
                found = openapi(body or "", url or "") if first else []
                if not found and kind and not (first and kind == "openapi"):
                    found = _PARSERS[kind](body or "", url or "")
                rows += [{"artifact_id": key, "source_url": url, "ord": k, **r} for k, r in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    chosen = artifacts.withColumn("_parser", document_kind())
    chosen = chosen.withColumn("_first", may_be_openapi(artifacts) & F.coalesce(~F.col("_parser").isin("robots", "well_known", "manifest"), F.lit(True)))
    return chosen.where("_parser is not null or _first").select("artifact_id", "url", "body", "_parser", "_first").mapInArrow(run, FIELDS)


def expand(artifacts: DataFrame) -> DataFrame:
    """Observations of all service descriptions, with seq for the merge."""
    rows = candidates(artifacts)
    text = F.when(F.col("strip"), U.strip_placeholders(F.col("candidate"))).otherwise(F.col("candidate"))
    full = U.absolutize(F.col("source_url"), text)
    full = F.when(F.col("source") == "GetCapabilities", ogc_base(full)).otherwise(full)
    rows = U.bind(U.bind(rows, "_full", full), "url", U.normalize(F.col("_full"))).where("url is not null")
    rows = U.bind(rows, "_named", classify(F.col("url"), F.col("source")))
    named = F.col("_named")
    ogc = F.when(ogc_service(F.col("source_url")) == "WMTS", "Tile Server").otherwise("GeoServer")
    kind = (
        F.when(F.col("kind").isNotNull(), F.col("kind"))
        .when(F.col("source") == "GetCapabilities", ogc)
        .when((F.col("source") == "OpenAPI") & named.isin("Unknown", "Static JSON"), "REST")
        .otherwise(named)
    )
    seq = F.struct(F.lit(0).alias("stage"), F.col("artifact_id").alias("artifact"), F.lit(0).alias("extractor"), F.col("ord").alias("ord"), F.lit(0).alias("base"))
    return U.bind(rows, "type", kind).select(
        guess_method(F.col("url"), F.col("type"), F.col("method")).alias("method"), "url", F.col("method").isNotNull().alias("method_observed"), "type", "source", "source_url", "evidence",
        "confidence", F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("content_type"), "params", "tags", seq.alias("seq"),
    )


def sitemap_links(artifacts: DataFrame) -> DataFrame:
    """Sitemaps that robots files name."""
    lines = artifacts.where(F.lower(U.part(F.col("url"), 3)).endswith("/robots.txt")).select("url", F.explode(F.split("body", "\r?\n")).alias("line"))
    target = F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*(\S+)", 1)
    return lines.where(target != "").select(F.col("url").alias("source_url"), U.normalize(U.absolutize(F.col("url"), target)).alias("url")).where("url is not null").distinct()


def header_endpoints(responses: DataFrame) -> DataFrame:
    """From url and headers (a map): what content policies and vendor headers name."""
    low = F.transform_keys("headers", lambda k, _: F.lower(k))
    each = responses.select("url", F.explode(low).alias("name", "value"))
    policy = F.flatten(F.transform(F.regexp_extract_all("value", F.lit(r"(?i)(?:connect|default|script|frame)-src\s+([^;]+)"), 1), lambda v: F.split(F.trim(v), r"\s+")))
    links = F.regexp_extract_all("value", F.lit("<([^>]+)>"), 1)
    csp = F.col("name").isin("content-security-policy", "content-security-policy-report-only")
    targets = F.when(csp, F.filter(policy, lambda t: t.rlike("^(?:https?:|wss?:)?//"))).when(F.col("name") == "link", links).when(F.col("name").isin("x-api-url", "x-backend-url", "x-graphql-url", "location"), F.array("value"))
    rows = each.select("url", "name", csp.alias("csp"), F.explode(targets).alias("t"))
    found = U.normalize(U.strip_placeholders(U.absolutize(F.col("url"), F.replace("t", F.lit("*."), F.lit("")))))
    rows = rows.select(F.col("url").alias("source_url"), "name", found.alias("url"), F.when(F.col("csp"), "low").otherwise("high").alias("confidence")).where("url is not null")
    return rows.withColumn("type", classify(F.col("url"), F.lit("Header"))).distinct()


def cookie_endpoints(captures: DataFrame) -> DataFrame:
    """From url and cookies (a map): URLs inside values."""
    each = captures.select(F.col("url").alias("source_url"), F.explode("cookies").alias("name", "value"))
    rows = each.select("source_url", "name", F.explode(F.regexp_extract_all("value", F.lit(r"https?://[^\s;,\"']+"), 0)).alias("u")).withColumn("url", U.normalize(F.col("u"))).where("url is not null")
    return rows.select("source_url", "url", F.concat(F.lit("cookie:"), F.col("name")).alias("tag"), classify(F.col("url"), F.lit("Cookie")).alias("type"))


def body_field_names(posts: DataFrame, most: int = 40) -> DataFrame:
    """From request_id and post_body: names of the fields of a JSON object or a form."""
    keys = F.json_object_keys(F.when(F.col("post_body").rlike(r"^\s*\{"), F.col("post_body")))
    operation = F.get_json_object(F.when(F.col("post_body").rlike(r"^\s*\{"), F.col("post_body")), "$.operationName")
    form = F.transform(F.split("post_body", "&"), lambda p: F.regexp_extract(p, "^([^=]+)=", 1))
    names = F.when(keys.isNotNull(), F.concat(F.slice(keys, 1, most), F.when(operation.isNotNull(), F.array(F.concat(F.lit("gql:"), operation))).otherwise(F.array().cast("array<string>")))).when(F.col("post_body").contains("="), F.filter(form, lambda n: n != ""))
    return posts.select("request_id", F.coalesce(names, F.array().cast("array<string>")).alias("names"))


API_RESOURCES = ["xhr", "fetch", "eventsource", "websocket"]


def network_endpoints(log: DataFrame) -> DataFrame:
    """From a request log (request_id, url, method, resource_type, status, content_type): what was called and looks like an interface."""
    rows = U.bind(log, "norm", U.normalize(F.col("url"))).where("norm is not null").where(~U.is_infrastructure(F.col("norm")))
    rows = U.bind(rows, "type", classify(F.col("norm"), F.lit(None).cast("string"), F.col("content_type")))
    api = F.col("resource_type").isin(API_RESOURCES) | F.coalesce(F.col("content_type").contains("json"), F.lit(False)) | ~F.col("method").isin("GET", "HEAD")
    rows = rows.where((F.col("type") != "Unknown") | api)
    return rows.select("request_id", F.col("norm").alias("url"), F.upper("method").alias("method"), "type", F.col("status").alias("status_code"), "content_type", F.lit("high").alias("confidence"), F.array(F.lit("observed"), F.concat(F.lit("resource:"), F.col("resource_type"))).alias("tags"))


def source_map_files(artifacts: DataFrame, most: int | None = 4000) -> DataFrame:
    """Embedded sources of source maps, plain or in sections, as artefacts of their own; packages of others are left out.

    `most` is the reference's number of sources a map; None takes all.
    """
    shape = "struct<sourceRoot:string,sources:array<string>,sourcesContent:array<string>,sections:array<struct<map:struct<sources:array<string>,sourcesContent:array<string>>>>>"
    maps = artifacts.where("kind = 'map'").select("artifact_id", "url", F.from_json("body", shape).alias("m"))
    none = F.array().cast("array<string>")
    merged = lambda own, inner: F.concat(F.coalesce(F.col(f"m.{own}"), none), F.flatten(F.transform(F.coalesce(F.col("m.sections"), F.expr(f"cast(array() as {shape})".replace(f"cast(array() as {shape})", "cast(null as array<struct<map:struct<sources:array<string>,sourcesContent:array<string>>>>)"))), lambda s: F.coalesce(s["map"][inner], none))))
    sources, contents = F.coalesce(merged("sources", "sources"), F.col("m.sources")), F.coalesce(merged("sourcesContent", "sourcesContent"), F.col("m.sourcesContent"))
    files = maps.select("artifact_id", "url", F.posexplode(F.slice(F.arrays_zip(sources.alias("name"), contents.alias("body")), 1, most or 1 << 30)).alias("ord", "f"))
    files = files.select("artifact_id", "url", "ord", "f.name", "f.body").where("trim(body) <> '' and instr(name, 'node_modules') = 0")
    return files.withColumn("origin", F.concat(F.lit("origin:"), F.regexp_extract("name", "([^/]*)$", 1)))
