"""Queries over the operators, named after what they show, with DuckDB SQL written from the operators' rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import url as U
from ..operators import captures, crawl, detect, documents, extract, html, merge, report, rules, select
from ..sources import cookies, sinks
from . import corpora, scan
from . import fixed as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def urls(spark: SparkSession, d: str) -> DataFrame:
    return corpora.frame(spark, d, corpora.URLS)


def observed(spark: SparkSession, d: str) -> DataFrame:
    o = corpora.frame(spark, d, corpora.OBSERVATIONS)
    return o.withColumns({"params": F.array("param"), "tags": F.array("tag"), "discovered_at": F.lit(None).cast("timestamp")})


def scripts(spark: SparkSession, d: str) -> DataFrame:
    # the table is one small file; scripts are dealt over all cores
    return corpora.frame(spark, d, corpora.SCRIPTS).repartition(spark.sparkContext.defaultParallelism)


def any_sql(value: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({value}, '{m}')" for m in markers) + ")"


# parts of a URL in DuckDB
S, A, P, Q = (
    "lower(regexp_extract(url, '^([^:/?#]+):', 1))",
    "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)",
    "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)",
    "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)",
)
H = f"lower(regexp_extract({A}, '([^@:]*)(?::\\d*)?$', 1))"
U_CTE = f"WITH u AS ({corpora.URLS}), x AS (SELECT id, url, {S} AS s, {A} AS a, {H} AS h, {P} AS p, {Q} AS q FROM u)"
PG = f"WITH x AS (SELECT page_id, url, {S} AS s, {A} AS a, {H} AS h, {P} AS p, {Q} AS q FROM pages)"
SUFFIX_LIST = ", ".join(f"'{s}'" for s in V.SUFFIXES)
DOMAIN = f"""CASE WHEN regexp_full_match(h, '[\\d.]+') OR len(string_split(h, '.')) <= 2 THEN h
  WHEN array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') IN ({SUFFIX_LIST}) THEN array_to_string(list_slice(string_split(h, '.'), -3, -1), '.')
  ELSE array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') END"""
ID = "\\d{1,12}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,64}"
ROUTE = f"""regexp_extract(url, '^[^:/?#]+', 0) || '://' || a || array_to_string(list_transform(string_split(p, '/'), lambda g: CASE WHEN regexp_full_match(g, '{ID}') THEN '{{id}}' ELSE g END), '/')
  || CASE WHEN q = '' THEN '' ELSE '?' || q END"""
NORM = """CASE WHEN s IN ('http', 'https', 'ws', 'wss') THEN s || '://' || h
  || CASE WHEN regexp_extract(a, ':(\\d+)$', 1) IN ('', CASE WHEN s IN ('http', 'ws') THEN '80' ELSE '443' END) THEN '' ELSE ':' || regexp_extract(a, ':(\\d+)$', 1) END
  || regexp_replace(CASE WHEN p = '' THEN '/' ELSE p END, '/+', '/', 'g') || CASE WHEN q = '' THEN '' ELSE '?' || q END END"""


# --- URL functions -------------------------------------------------------------------------------------------------
@query(f"{U_CTE} SELECT id, {NORM} AS normal FROM x")
def u05_normalize(spark, d):
    return urls(spark, d).select("id", U.normalize(F.col("url")).alias("normal"))


@query(f"{PG} SELECT page_id, {NORM} AS normal, h AS host FROM x")
def u05_u07_pages(spark, d):
    return pages(spark, d).select("page_id", U.normalize(F.col("url")).alias("normal"), U.host_of(F.col("url")).alias("host"))


@query(f"{U_CTE} SELECT id, h AS host, {DOMAIN} AS domain FROM x")
def u06_registered_domain(spark, d):
    return urls(spark, d).select("id", U.host_of(F.col("url")).alias("host"), U.registered_domain(U.host_of(F.col("url"))).alias("domain"))


@query(f"{U_CTE} SELECT id, (h = 'www.example.com' OR {DOMAIN} = 'example.com') AS scoped, h = 'www.example.com' AS same_host, (s || '://' || lower(a)) = 'https://www.example.com' AS same_origin FROM x")
def u08_same_scope(spark, d):
    u, b = F.col("url"), F.lit("https://www.example.com/")
    return urls(spark, d).select("id", U.same_scope(u, b).alias("scoped"), U.same_scope(u, b, False).alias("same_host"), U.same_scope(u, b, same_origin_only=True).alias("same_origin"))


EXT = "lower(regexp_extract(regexp_extract(p, '[^/]*$', 0), '\\.([A-Za-z0-9]{1,10})$', 1))"


@query(
    f"""{U_CTE}, e AS (SELECT id, {EXT} AS ext FROM x)
SELECT id, ext, ext IN ({", ".join(f"'{b}'" for b in V.BINARY)}) AS is_binary, ext IN ({", ".join(f"'{b}'" for b in V.ANALYSABLE)}) AS analysable,
  ext IN ({", ".join(f"'{b}'" for b in V.PAGES)}) AS page FROM e"""
)
def u09_u11_extension(spark, d):
    u = F.col("url")
    return urls(spark, d).select("id", U.extension(u).alias("ext"), U.is_binary(u).alias("is_binary"), U.is_analysable(u).alias("analysable"), U.is_html_like(u).alias("page"))


@query(f"{U_CTE} SELECT id, {any_sql('lower(p)', V.INFRASTRUCTURE)} AS infrastructure FROM x")
def u10_infrastructure(spark, d):
    return urls(spark, d).select("id", U.is_infrastructure(F.col("url")).alias("infrastructure"))


@query(f"WITH u AS ({corpora.URLS}) SELECT id, regexp_replace(url || '/a%20b/${{x}}/{{{{y}}}}', '\\$\\{{[^}}]*\\}}|\\{{\\{{[^}}]*\\}}\\}}|<%[^%]*%>|%[0-9a-fA-F]{{2}}', ':var', 'g') AS plain FROM u")
def u12_strip_placeholders(spark, d):
    return urls(spark, d).select("id", U.strip_placeholders(F.concat("url", F.lit("/a%20b/${x}/{{y}}"))).alias("plain"))


@query(f"{U_CTE} SELECT id, ((h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.org' OR h LIKE '%.example.org') AND NOT (h = 'id.example.com' OR h LIKE '%.id.example.com')) AS allowed FROM x")
def u14_host_allowed(spark, d):
    return urls(spark, d).select("id", U.host_allowed(F.col("url"), ["*.example.com", "https://example.org/x"], ["id.example.com"]).alias("allowed"))


@query(f"WITH u AS ({corpora.URLS}) SELECT id, (regexp_matches(lower(url), 'api|geo') AND NOT regexp_matches(lower(url), 'swagger')) AS kept FROM u")
def u15_matches_filters(spark, d):
    return urls(spark, d).select("id", U.matches_filters(F.col("url"), ["api", "geo"], ["swagger"]).alias("kept"))


@query(f"{U_CTE} SELECT id, CASE WHEN regexp_matches(p, '(?i)/mapserver(/|$)') THEN s || '://' || a || regexp_extract(p, '(?i)^(.*?/mapserver)(/|$)', 1) END AS service FROM x")
def u16_parent_service(spark, d):
    return urls(spark, d).select("id", U.parent_service(F.col("url"), "MapServer").alias("service"))


@query(f"{U_CTE} SELECT id, regexp_extract(url, '^[^:/?#]+', 0) || '://' || a AS origin, {ROUTE} AS route FROM x")
def u17_u18_templatize(spark, d):
    return urls(spark, d).select("id", U.origin(F.col("url")).alias("origin"), U.templatize(F.col("url")).alias("route"))


@query(
    f"""{U_CTE} SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(q, '&'), lambda g: regexp_extract(g, '^([^=]*)', 1)), lambda g: g <> ''))), ',') AS names FROM x"""
)
def u19_query_names(spark, d):
    return urls(spark, d).select("id", F.array_join(U.query_names(F.col("url")), ",").alias("names"))


@query(
    f"""WITH u AS ({corpora.URLS}), c AS (SELECT id, url, CASE id % 4 WHEN 0 THEN '/' WHEN 1 THEN 'x' WHEN 2 THEN '/v' || (id % 9) || '/' || id ELSE url END AS cand FROM u)
SELECT id, (length(cand) BETWEEN 2 AND 2048 AND cand <> '/' AND (regexp_matches(cand, '^(https?|wss?)://') OR (cand LIKE '/%' AND length(cand) > 3))) AS probable FROM c"""
)
def u03_is_probably_url(spark, d):
    k = F.col("id") % 4
    cand = F.when(k == 0, "/").when(k == 1, "x").when(k == 2, F.concat(F.lit("/v"), F.col("id") % 9, F.lit("/"), F.col("id"))).otherwise(F.col("url"))
    return urls(spark, d).select("id", U.is_probably_url(cand).alias("probable"))


RAW = "regexp_extract(url, '^([^:/?#]+):', 1)"  # the scheme as it is written


@query(
    f"""{U_CTE}, y AS (SELECT *, {RAW} AS raw, s IN ('http', 'https', 'ws', 'wss') AS web FROM x)
SELECT id, raw || '://' || a || '/up/' || id AS rooted, CASE WHEN web THEN raw || '://other.example.com/x' END AS relative_scheme, CASE WHEN web THEN url END AS whole,
  raw || '://' || a || CASE WHEN p = '' THEN '/' ELSE p END || '?k=' || id AS with_query FROM y"""
)
def u04_absolutize(spark, d):
    b = F.col("url")
    parts = {"rooted": F.concat(F.lit("/up/"), "id"), "relative_scheme": F.lit("//other.example.com/x"), "whole": b, "with_query": F.concat(F.lit("?k="), "id")}
    return urls(spark, d).select("id", *[U.absolutize(b, c).alias(n) for n, c in parts.items()])


@query(
    """SELECT o_orderkey AS id, 'https://x.example.com/a/' || o_orderkey AS cleaned FROM orders"""
)
def u01_u02_clean_candidate(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    raw = F.concat(F.lit('"https:\\/\\/x.example.com\\/a/'), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, '").,').otherwise(');"'))
    return o.select(F.col("o_orderkey").alias("id"), U.clean_candidate(raw).alias("cleaned"))


# --- classification ------------------------------------------------------------------------------------------------
W = "CASE WHEN q = '' THEN lower(p) ELSE lower(p) || '?' || lower(q) END"
SEG = lambda names: "regexp_matches(lower(p), '(^|/)(" + "|".join(names) + ")([/?]|$)')"
STAT = "regexp_matches(lower(p), '\\.(json|geojson|topojson|xml|csv|yaml|yml)$')"
RESTY = f"({any_sql('w', V.REST)} OR regexp_matches(lower(p), '/api(s|v\\d{{1,2}}|_v\\d{{1,2}}|\\d{{1,2}})?(/|\\?|$)') OR regexp_matches(lower(p), '/v[1-9]\\d?(/|$)'))"
KIND = f"""CASE WHEN s IN ('ws', 'wss') THEN 'WebSocket' WHEN {any_sql("w", V.SWAGGER)} THEN 'Swagger/OpenAPI' WHEN {any_sql("lower(p)", V.GRAPHQL)} THEN 'GraphQL'
  WHEN contains(lower(p), '/imageserver') THEN 'Image Service' WHEN contains(lower(p), '/vectortileserver') THEN 'Tile Server' WHEN {any_sql("lower(p)", V.ARCGIS)} THEN 'ArcGIS REST'
  WHEN regexp_matches(lower(q), '(^|&)service=wmts(&|$)') THEN 'Tile Server' WHEN regexp_matches(lower(q), '(^|&)service=(wms|wfs|wcs|csw|wps)(&|$)') THEN 'GeoServer'
  WHEN {any_sql("lower(p)", V.OGC)} THEN CASE WHEN contains(lower(p), 'wmts') THEN 'Tile Server' ELSE 'GeoServer' END WHEN contains(w, 'getcapabilities') THEN 'GeoServer'
  WHEN {any_sql("w", V.TILES)} THEN 'Tile Server' WHEN {SEG(V.AUTH)} THEN 'Authentication' WHEN contains(w, 'wsdl') THEN 'SOAP' WHEN {SEG(V.STREAMS)} THEN 'Stream/SSE'
  WHEN {RESTY} THEN CASE WHEN {STAT} AND NOT contains(lower(p), '/api') THEN 'Static JSON' ELSE 'REST' END WHEN {STAT} THEN 'Static JSON' ELSE 'Unknown' END"""
K_CTE = f"{U_CTE}, y AS (SELECT *, {W} AS w FROM x), k AS (SELECT *, {KIND} AS type FROM y)"
VERB = f"""CASE WHEN type = 'WebSocket' THEN 'ANY' WHEN type = 'GraphQL' THEN 'POST' WHEN type = 'Authentication' AND {SEG("login token signin sign-in register signup".split())} THEN 'POST'
  WHEN regexp_extract(rtrim(lower(p), '/'), '[^/]*$', 0) IN ({", ".join(f"'{m}'" for m in V.MUTATING)}) THEN 'POST' ELSE 'GET' END"""
INTEREST = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.INTEREST.items()) + " ELSE 0 END"


@query(f"{K_CTE} SELECT id, type, {VERB} AS method, CAST({INTEREST} AS INTEGER) AS interest FROM k")
def c01_c02_c03_classify(spark, d):
    kind = C.classify(F.col("url"))
    return urls(spark, d).withColumn("type", kind).select("id", "type", C.guess_method(F.col("url"), F.col("type")).alias("method"), C.interest(F.col("type")).alias("interest"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 0 THEN 'cloudflare' WHEN o_orderkey % 8 = 1 THEN 'waf' WHEN o_orderkey % 8 = 2 THEN 'forbidden' WHEN o_orderkey % 8 = 3 THEN 'not_found'
  WHEN o_orderkey % 8 = 4 THEN 'rate_limited' WHEN o_orderkey % 8 = 5 THEN 'server_error' WHEN o_orderkey % 8 = 6 THEN 'client_error' END AS category,
  coalesce((o_orderkey % 8) IN (4, 5), false) AS retryable FROM orders"""
)
def c05_c06_c07_c08_responses(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey") % 8
    status = F.element_at(F.array(*map(F.lit, (200, 403, 403, 404, 429, 502, 410, 200))), (k + 1).cast("int"))
    headers = F.when(k == 1, F.create_map(F.lit("X-DataDome"), F.lit("protected"))).otherwise(F.create_map(F.lit("Server"), F.lit("nginx")))
    body = F.when(k == 0, "<title>Just a moment...</title> Cloudflare").otherwise("<p>hello</p>")
    category = C.classify_response(status, headers, body)
    return o.select(F.col("o_orderkey").alias("id"), category.alias("category"), F.coalesce(C.is_retryable(category), F.lit(False)).alias("retryable"))


@query(f"{K_CTE} SELECT id, (regexp_extract(url, '^([^:/?#]+):', 1) IN ('http', 'https') AND id % 3 <> 0 AND {VERB} IN ('GET', 'HEAD', 'OPTIONS', 'ANY')) AS verifiable FROM k")
def c09_verifiable(spark, d):
    u = urls(spark, d)
    status = F.when(F.col("id") % 3 == 0, 200)
    return u.select("id", C.is_verifiable(F.col("url"), C.guess_method(F.col("url"), C.classify(F.col("url"))), status).alias("verifiable"))


@query(
    f"""{U_CTE}, e AS (SELECT id, {EXT} AS ext FROM x) SELECT id, CASE WHEN ext IN ('js', 'mjs', 'cjs', 'jsx', 'ts', 'tsx') THEN 'js' WHEN ext = 'css' THEN 'css' WHEN ext = 'map' THEN 'map'
  WHEN ext IN ('json', 'geojson', 'topojson', 'webmanifest') THEN 'json' WHEN ext IN ('xml', 'rss', 'atom', 'kml', 'wsdl') THEN 'xml' WHEN ext IN ('yaml', 'yml') THEN 'yaml' WHEN ext IN ('html', 'htm') THEN 'html'
  WHEN id % 2 = 0 THEN 'html' ELSE 'js' END AS kind FROM e"""
)
def s08_asset_kind(spark, d):
    t = F.when(F.col("id") % 2 == 0, "text/html; charset=utf-8").otherwise("application/javascript")
    return urls(spark, d).select("id", C.asset_kind(F.col("url"), t).alias("kind"))


# --- merge, selection, reports -------------------------------------------------------------------------------------
O_CTE = f"WITH o AS ({corpora.OBSERVATIONS}), r AS (SELECT *, CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS rank FROM o)"
MERGED = """SELECT method, url, bool_or(method_observed) AS method_observed, coalesce(arg_min(type, seq) FILTER (type <> 'Unknown'), 'Unknown') AS type,
  CASE WHEN arg_min(coalesce(status_code, -1), seq) = -1 AND count(status_code) > 0 THEN arg_min(source, seq) FILTER (status_code IS NOT NULL) ELSE arg_min(source, seq) END AS source,
  CASE WHEN arg_min(coalesce(status_code, -1), seq) = -1 AND count(status_code) > 0 THEN arg_min(source_url, seq) FILTER (status_code IS NOT NULL) ELSE arg_min(source_url, seq) END AS source_url,
  arg_min(evidence, seq - 1000000000000 * rank) AS evidence, CASE max(rank) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  arg_min(status_code, seq) FILTER (status_code IS NOT NULL) AS status_code, arg_min(content_type, seq) FILTER (content_type IS NOT NULL) AS content_type,
  array_to_string(list_sort(list_distinct(list(param))), ',') AS params, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags, count(*) AS n_observations
  FROM r GROUP BY method, url"""
M_CTE = f"{O_CTE}, m AS ({MERGED})"


def merged(spark, d):
    return merge.merge_observations(observed(spark, d))


def shown(m: DataFrame) -> DataFrame:
    return m.withColumns({"params": F.array_join("params", ","), "tags": F.array_join("tags", ",")})


@query(f"{M_CTE} SELECT * FROM m")
def agg01_merge(spark, d):
    return shown(merged(spark, d))


@query(f"{M_CTE} SELECT type, url, method FROM m")
def agg02_collector_order(spark, d):
    return merged(spark, d).select("type", "url", "method").orderBy("type", "url", "method")


@query(f"{PG} SELECT h AS host, {ROUTE} AS route, count(*) AS n FROM x GROUP BY ALL")
def agg03_group_routes(spark, d):
    return report.group_routes(pages(spark, d)).orderBy(F.desc("n"), "host", "route")


@query(f"{U_CTE} SELECT CASE WHEN h = '' THEN '?' ELSE h END AS host, count(*) AS n FROM x GROUP BY ALL")
def agg04_group_by_host(spark, d):
    return report.group_by_host(urls(spark, d))


@query(f"{M_CTE} SELECT type, count(*) AS n FROM m GROUP BY type")
def agg05_type_counts(spark, d):
    return report.type_counts(merged(spark, d))


@query(f"{M_CTE}, x AS (SELECT *, {A} AS a, {H} AS h, {P} AS p, {Q} AS q FROM m) SELECT count(*) AS total, count(DISTINCT h) AS hosts, count(DISTINCT {ROUTE}) AS routes, count(*) FILTER (confidence = 'high') AS high_confidence, count(status_code) AS observed FROM x")
def agg06_summarize(spark, d):
    return report.summarize(merged(spark, d))


@query("SELECT event_type AS category, count(*) AS n FROM events GROUP BY event_type")
def agg07_error_counts(spark, d):
    return report.error_counts(spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "category"))


@query(f"{M_CTE} SELECT source_url AS src, count(DISTINCT url) AS n FROM m WHERE source_url NOT IN (SELECT url FROM m) GROUP BY source_url ORDER BY n DESC, src LIMIT 10")
def agg08_top_sources(spark, d):
    return report.top_sources(merged(spark, d))


@query("SELECT 'html' AS kind, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS n_bytes FROM pages")
def agg09_scan_counters(spark, d):
    return report.scan_counters(pages(spark, d).select(F.lit("html").alias("kind"), F.col("html").alias("body")))


@query(f"{M_CTE} SELECT DISTINCT 'type' AS facet, type AS value FROM m UNION ALL SELECT DISTINCT 'method', method FROM m UNION ALL SELECT 'sources', CAST(count(DISTINCT source_url) AS VARCHAR) FROM m")
def agg10_facets(spark, d):
    return report.facets(merged(spark, d))


FILTERED = "regexp_matches(url, '(?i)things/1') AND NOT regexp_matches(url, '(?i)things/13')"


@query(f"{M_CTE} SELECT method, url FROM m WHERE {FILTERED} AND regexp_matches(url, '^https://api(1|2)\\.example\\.com/')")
def f01_f02_filters(spark, d):
    m = select.filter_patterns(merged(spark, d), ["things/1"], ["things/13"])
    return select.filter_hosts(m, ["api1.example.com", "api2.example.com"], []).select("method", "url")


OBSERVED_FIRST = "SELECT * FROM m WHERE method_observed OR url NOT IN (SELECT url FROM m WHERE method_observed)"


@query(f"{M_CTE} SELECT method, url, confidence FROM ({OBSERVED_FIRST})")
def f03_prefer_observed(spark, d):
    return select.prefer_observed(merged(spark, d)).select("method", "url", "confidence")


@query(f"{M_CTE} SELECT method, url FROM m WHERE confidence IN ('high', 'medium') AND type <> 'Unknown'")
def f04_f05_confidence_and_known(spark, d):
    return select.drop_unknown(select.at_least(merged(spark, d), "medium")).select("method", "url")


@query(f"{M_CTE} SELECT method, url FROM m WHERE NOT (type = 'Unknown' AND rtrim(url, '/') IN (SELECT 'https://api' || (n_nationkey % 40) || '.example.com/v1/things/' || r FROM nation, range(500) t(r)))")
def f06_split_routes(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    r = n.select(F.explode(F.sequence(F.lit(0), F.lit(499))).alias("r"), "n_nationkey").select(F.concat(F.lit("https://api"), F.col("n_nationkey") % 40, F.lit(".example.com/v1/things/"), "r", F.lit("/")).alias("url"))
    return select.split_routes(merged(spark, d), r)[0].select("method", "url")


@query(f"{U_CTE} SELECT id FROM x WHERE (h = 'example.com' OR h LIKE '%.example.com') AND regexp_matches(url, '(?i)page|api')")
def f07_route_candidates(spark, d):
    return select.route_candidates(urls(spark, d), ["example.com"], [], ["page|api"], []).select("id")


@query(f"{M_CTE} SELECT method, url, row_number() OVER (ORDER BY {INTEREST} DESC, CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, url, method) AS position FROM m")
def f08_rank(spark, d):
    return select.numbered(merged(spark, d)).select("method", "url", "position")


@query(
    f"""{M_CTE}, f AS (SELECT * FROM m WHERE {FILTERED}), s AS (SELECT * FROM f WHERE method_observed OR url NOT IN (SELECT url FROM f WHERE method_observed))
SELECT method, url, type, confidence, params FROM s WHERE confidence IN ('high', 'medium') AND type <> 'Unknown'"""
)
def f09_selection(spark, d):
    none = spark.createDataFrame([], "url string")
    return shown(select.selection(merged(spark, d), none, ["things/1"], ["things/13"], confidence="medium", keep_unknown=False)).select("method", "url", "type", "confidence", "params")


@query(f"{M_CTE} SELECT type, method, url, position FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, url, method) AS position FROM m) WHERE position <= 5")
def f10_top_of_each_type(spark, d):
    return select.top_of_each_type(merged(spark, d), 5).select("type", "method", "url", F.col("position").cast("long").alias("position"))


@query(f"{M_CTE} SELECT DISTINCT source_url AS src, url AS dst FROM m")
def k06_edges(spark, d):
    return report.edges(merged(spark, d)).select("src", "dst")


@query(f"{M_CTE} SELECT method, url, 'added' AS change FROM m WHERE method = 'POST' AND url LIKE '%1' UNION ALL SELECT method, url, 'removed' FROM m WHERE method = 'GET' AND url LIKE '%2'")
def k05_t08_history_difference(spark, d):
    m = merged(spark, d).select("method", "url")
    return report.history_difference(m.where("not (method = 'POST' and url like '%1')"), m.where("not (method = 'GET' and url like '%2')"))


@query(f"{M_CTE} SELECT method, url, type, confidence, source, source_url, coalesce(CAST(status_code AS VARCHAR), '') AS status_code, coalesce(content_type, '') AS content_type, replace(params, ',', ' ') AS params, replace(tags, ',', ' ') AS tags FROM m")
def k02_csv_rows(spark, d):
    return sinks.flat(merged(spark, d))


JSON_LIST = lambda c: f"to_json(CASE WHEN {c} = '' THEN [] ELSE string_split({c}, ',') END)"


@query(
    f"""{M_CTE} SELECT 'endpoints' AS section, CAST(json_object('url', url, 'method', method, 'type', type, 'source', source, 'source_url', source_url, 'confidence', confidence, 'status_code', CAST(status_code AS INTEGER), 'content_type', content_type,
  'params', {JSON_LIST("params")}, 'tags', {JSON_LIST("tags")}, 'evidence', evidence) AS VARCHAR) AS line FROM m
UNION ALL SELECT 'type_counts', CAST(json_object('type', type, 'n', count(*)) AS VARCHAR) FROM m GROUP BY type"""
)
def k01_json_report(spark, d):
    return sinks.json_report(merged(spark, d), "https://www.example.com/").where("section <> 'summary'")


@query(
    f"""{M_CTE}, c AS (SELECT type, count(*) AS n FROM m GROUP BY type)
SELECT '[' || type || ']  (' || n || ')' || chr(10) || 'METHOD  URL  SOURCE  C' AS line FROM c UNION ALL SELECT rpad(method, 7, ' ') || ' ' || url || '  ' || source || '  ' || upper(left(confidence, 1)) FROM m"""
)
def k08_terminal(spark, d):
    return sinks.terminal(sinks.Scan(merged(spark, d))).select("line")


@query(f"{M_CTE} SELECT '| ' || method || ' | ' || url || ' | ' || confidence || ' |' AS line FROM m")
def k04_markdown_rows(spark, d):
    return sinks.markdown(sinks.Scan(merged(spark, d), "x")).where("at.s = 2 and at.t1 <> ''").select("line")


# --- pages ---------------------------------------------------------------------------------------------------------
def unescaped(v: str) -> str:
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        v = f"replace({v}, '{name}', '{c}')"
    return v


@query(f"SELECT page_id, trim(regexp_replace({unescaped("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}, '\\s+', ' ', 'g')) AS title FROM pages WHERE html LIKE '%<title>%'")
def h01_titles(spark, d):
    return html.page_items(pages(spark, d)).where("bucket = 'title'").select("page_id", F.col("value").alias("title"))


# what an attribute's URL is once it is unescaped, cut, rid of punctuation, resolved and put in normal form
CUT = f"""regexp_extract({unescaped(unescaped("raw"))}, '^[^"''`<>|^\\\\ \\t\\r\\n]*', 0)"""
ANCHORS = f"""{PG}, l AS (SELECT page_id, url AS page_url, s, a, h, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1), 1) AS k
  FROM x JOIN (SELECT page_id AS _id, html FROM pages) ON page_id = _id),
t AS (SELECT *, regexp_replace({CUT}, '([,;:!*''"]|[.])+$', '') AS v FROM l),
n AS (SELECT page_id, page_url, s, h, k, regexp_replace(regexp_extract(v, '^[^?#]*', 0), '/+', '/', 'g') AS np, regexp_extract(v, '^[^?#]*\\?([^#]*)', 1) AS nq FROM t WHERE v <> '' AND NOT regexp_matches(v, '^(#|javascript:|data:|mailto:|tel:)')),
anchors AS (SELECT page_id, page_url, s || '://' || h || np || CASE WHEN nq = '' THEN '' ELSE '?' || nq END AS url, min(k) AS k, any_value(np) AS p, any_value(h) AS h FROM n GROUP BY ALL)"""


@query(f"{ANCHORS} SELECT page_id, 'anchors' AS bucket, url, CAST(k + 2 AS INTEGER) AS ord FROM anchors")
def h01_h02_resources(spark, d):
    return html.resources(pages(spark, d)).select("page_id", "bucket", "url", "ord")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1)) AS BIGINT) AS n_anchors FROM pages")
def h01_anchor_counts(spark, d):
    found = html.page_items(pages(spark, d)).where("bucket = 'anchors'").groupBy("page_id").agg(F.count("*").alias("n"))
    return pages(spark, d).select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n_anchors"))


@query(
    f"""{PG} SELECT page_id, s || '://' || h || '/api/login' AS url, 'POST' AS method, 'Authentication' AS type FROM x
UNION ALL SELECT page_id, {NORM}, 'GET', 'REST' FROM x"""
)
def h04_h08_forms(spark, d):
    p = pages(spark, d).withColumn("html", F.concat("html", F.lit('<form method="post" action="/api/login"></form><form></form>')))
    return html.forms(p).select("page_id", "url", "method", "type")


@query(f"{PG} SELECT page_id, s || '://' || h || v.path AS url, v.type, 'medium' AS confidence FROM x, (SELECT '/api/v1/list' AS path, 'REST' AS type UNION ALL SELECT '/manifest.json', 'Static JSON') v")
def h09_resource_endpoints(spark, d):
    p = pages(spark, d).withColumn("html", F.concat("html", F.lit('<div data-api-url="/api/v1/list"></div><link rel=manifest href="/manifest.json">')))
    return html.resource_endpoints(html.resources(p)).select("page_id", "url", "type", "confidence")


@query(
    """SELECT page_id, unnest(CASE page_id % 3 WHEN 0 THEN ['jQuery', 'WordPress'] WHEN 1 THEN ['Next.js', 'MapLibre/Mapbox'] ELSE ['GraphQL client', 'Angular'] END) AS name FROM pages
UNION ALL SELECT page_id, 'nginx/1.' || (page_id % 9) FROM pages WHERE page_id % 2 = 0"""
)
def h10_technologies(spark, d):
    more = F.element_at(F.array(*map(F.lit, ('<script src="/static/jquery.min.js"></script><meta name="generator" content="WordPress 6">', '<link href="/_next/a.css"><script src="/maplibre-gl.js"></script>', "<script>new Apollo()</script><script src='/angular.min.js'></script>"))), (F.col("page_id") % 3 + 1).cast("int"))
    p = pages(spark, d).withColumn("html", F.concat("html", more))
    headers = F.create_map(F.lit("Server"), F.concat(F.lit(" nginx/1."), (F.col("page_id") % 9).cast("string")), F.lit("Date"), F.lit("x"))
    return html.technologies(html.page_items(p), p.where("page_id % 2 = 0").select("page_id", headers.alias("headers")))


@query(
    f"""{ANCHORS}, f AS (SELECT DISTINCT {NORM} AS url FROM (SELECT * FROM x ORDER BY page_id LIMIT 5)), c AS (SELECT DISTINCT {NORM} AS url FROM x),
e AS (SELECT DISTINCT {NORM} AS page_url, page_id FROM x),
d1 AS (SELECT DISTINCT anchors.url FROM anchors JOIN e USING (page_id) WHERE e.page_url IN (SELECT url FROM f) AND {EXT} IN ('', 'html', 'htm', 'php', 'asp', 'aspx', 'jsp', 'do', 'action') AND anchors.url NOT IN (SELECT url FROM f)),
v1 AS (SELECT url FROM d1 ORDER BY url LIMIT (SELECT 200 - count(*) FROM f)),
d2 AS (SELECT DISTINCT anchors.url FROM anchors JOIN e USING (page_id) WHERE e.page_url IN (SELECT url FROM v1) AND {EXT} IN ('', 'html', 'htm', 'php', 'asp', 'aspx', 'jsp', 'do', 'action') AND anchors.url NOT IN (SELECT url FROM f UNION ALL SELECT url FROM v1))
SELECT url, 0 AS depth FROM f UNION ALL SELECT url, 1 FROM v1 UNION ALL SELECT url, 2 FROM (SELECT url FROM d2 ORDER BY url LIMIT (SELECT 200 - (SELECT count(*) FROM f) - (SELECT count(*) FROM v1)))"""
)
def s06_crawl(spark, d):
    p = pages(spark, d)
    links = html.link_graph(html.resources(p))
    start = p.orderBy("page_id").limit(5).select(U.normalize(F.col("url")).alias("url"))
    return crawl.crawl(start, links.withColumn("page_url", U.normalize(F.col("page_url"))), p.select(U.normalize(F.col("url")).alias("url")), 2, 200)


@query(f"{PG} SELECT url, CAST(page_id % 7 AS BIGINT) AS n_scripts FROM x ORDER BY (page_id = 3) DESC, page_id % 7 DESC, url LIMIT 20")
def s14_render_targets(spark, d):
    p = pages(spark, d).select("url", (F.col("page_id") % 7).alias("n_scripts"), (F.col("page_id") == 3).alias("is_entry"))
    return crawl.render_targets(p, 20)


@query(
    f"""{U_CTE}, n AS (SELECT {NORM} AS url, min(id) AS ord FROM x GROUP BY ALL HAVING {NORM} IS NOT NULL),
z AS (SELECT url, ord, {A} AS a, {H} AS h, {P} AS p FROM n)
SELECT url, CAST(ord AS BIGINT) AS ord FROM z WHERE {EXT} IN ('js', 'mjs', 'cjs', 'jsx', 'ts', 'tsx', 'map', 'json', 'geojson', 'topojson', 'css', 'xml', 'yaml', 'yml', 'txt', 'webmanifest')
  AND ({DOMAIN} = 'example.com' OR {EXT} IN ('js', 'mjs', 'cjs', 'map', 'json')) ORDER BY ord, url LIMIT 300"""
)
def s09_admit_assets(spark, d):
    return crawl.admit_assets(urls(spark, d).select("url", F.col("id").alias("ord")), "https://www.example.com/", 300)


@query("SELECT event_id AS request_id, array_to_string(list_sort(json_keys(props)), ',') AS names FROM events")
def s13_body_field_names(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("request_id"), F.col("props").alias("post_body"))
    return documents.body_field_names(e).select("request_id", F.array_join(F.array_sort("names"), ",").alias("names"))


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS host, event_id, event_id % 3 = 0 OR event_id % 7 = 0 AS hit FROM events),
l AS (SELECT host, list(CASE WHEN hit THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY event_id) AS steps, count(*) FILTER (hit) AS refusals FROM e GROUP BY host)
SELECT host, list_reduce(list_prepend(0.0::DOUBLE, steps), lambda acc, x: CASE WHEN x > 0 THEN least(greatest(acc * 2, 0.5), 8) WHEN acc / 2 <= 0.1 THEN 0 ELSE acc / 2 END) AS penalty, refusals FROM l"""
)
def t01_penalties(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    category = F.when(F.col("event_id") % 3 == 0, "rate_limited").when(F.col("event_id") % 7 == 0, "waf")
    return crawl.penalties(e.select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("ord"), category.alias("category")))


# --- rules and documents -------------------------------------------------------------------------------------------
J = f"WITH j AS ({corpora.SCRIPTS})"


@query(f"{J} SELECT artifact_id, 'axios' AS rule, regexp_extract(body, 'axios\\.get\\(\"([^\"]+)\"', 1) AS value, 'GET' AS method FROM j UNION ALL SELECT artifact_id, 'XMLHttpRequest', regexp_extract(body, 'open\\(\"POST\", \"([^\"]+)\"', 1), 'POST' FROM j UNION ALL SELECT artifact_id, 'jquery.ajax', regexp_extract(body, 'getJSON\\(\"([^\"]+)\"', 1), 'GET' FROM j UNION ALL SELECT artifact_id, 'sendBeacon', '/api/beacon', 'POST' FROM j UNION ALL SELECT artifact_id, 'EventSource', regexp_extract(body, 'EventSource\\(\"([^\"]+)\"', 1), NULL FROM j UNION ALL SELECT artifact_id, 'new WebSocket', regexp_extract(body, 'WebSocket\\(\"([^\"]+)\"', 1), NULL FROM j")
def r03_r15_call_sites(spark, d):
    names = ["axios", "XMLHttpRequest", "jquery.ajax", "sendBeacon", "EventSource", "new WebSocket"]
    return rules.matches(scripts(spark, d)).where(F.col("rule").isin(names)).select("artifact_id", "rule", "value", "method")


@query(f"{J} SELECT artifact_id, regexp_extract(body, 'fetch\\(\"([^\"]+)\", \\{{', 1) AS value, 'PUT' AS method, false AS in_comment FROM j UNION ALL SELECT artifact_id, regexp_extract(body, 'fetch\\(\"([^\"]+)\", \\{{', 1), NULL, false FROM j UNION ALL SELECT artifact_id, '/api/commented/' || artifact_id, NULL, true FROM j")
def r01_r02_r36_fetch(spark, d):
    return rules.matches(scripts(spark, d)).where("rule = 'fetch' and extractor = 0").select("artifact_id", "value", "method", "in_comment")


#: A call or literal for each rule: the text with # for a number, the value it gives, and the method.
SNIPPETS = [
    ("axios.config", 'axios({url: "/api/a#", method: "PATCH"})', "/api/a#", "PATCH"), ("axios.create", 'axios.create({baseURL: "https://c.example.com/b#"})', "https://c.example.com/b#", None),
    ("jquery.ajax", '$.ajax({type: "PUT", url: "/api/j#"})', "/api/j#", "PUT"), ("http.client", 'this.http.get<Item[]>("/api/h#")', "/api/h#", "GET"), ("superagent", 'superagent.del("/api/s#")', "/api/s#", "DELETE"),
    ("ky/wretch", 'ky.put("/api/k#")', "/api/k#", "PUT"), ("serviceWorker.register", 'navigator.serviceWorker.register("/sw#.js")', "/sw#.js", None), ("Worker", 'new SharedWorker("/w#.js")', "/w#.js", None),
    ("ws-url", 'connect(wss://x.example.com/s#)', "wss://x.example.com/s#)", None), ("arcgis", 'go("https://m.example.com/arcgis/rest/services/R#/MapServer/0")', "https://m.example.com/arcgis/rest/services/R#/MapServer/0", None),
    ("ogc", 'go("/maps#/geoserver/wms")', "/maps#/geoserver/wms", None), ("swagger", 'go("/docs#/swagger.json")', "/docs#/swagger.json", None), ("graphql", 'go("https://g#.example.com/graphql")', "https://g#.example.com/graphql", None),
    ("config:baseURL", 'baseURL: "/base#"', "/base#", None), ("config:MY_SERVICE_URL", 'MY_SERVICE_URL = "/env#"', "/env#", None), ("absolute-url", 'x(https://a#.example.com/p)', "https://a#.example.com/p)", None),
    ("protocol-relative", 'x("//cdn#.example.com/lib")', "//cdn#.example.com/lib", None), ("quoted-path", 'x("/some/path#")', "/some/path#", None), ("api-path", 'x("/api/q#")', "/api/q#", None), ("versioned-path", 'x("/v2/things#")', "/v2/things#", None),
    ("data-file", 'x("/f#/data.geojson?x=1")', "/f#/data.geojson?x=1", None), ("tile-template", 'x("/t#/{z}/{x}/{y}.png")', "/t#/{z}/{x}/{y}.png", None), ("var:target", 'r.open("POST", target); target = "/api/v#"', "/api/v#", "POST"),
    ("fetch", 'fetch(`/api/t#/${id}`, o)', "/api/t#/${id}", None), ("EventSource", 'new EventSource("/api/e#")', "/api/e#", None), ("sendBeacon", 'navigator.sendBeacon("/api/b#")', "/api/b#", "POST"),
]
PARTS = "SELECT p_partkey AS artifact_id, p_partkey % {n} AS k, '' || p_partkey AS n FROM part"


def cases(column: int) -> str:
    said = lambda v: "NULL" if v is None else "replace('" + v.replace("'", "''") + "', '#', n)"
    return "CASE k " + " ".join(f"WHEN {k} THEN {said(row[column])}" for k, row in enumerate(SNIPPETS)) + " END"


@query(f"WITH p AS ({PARTS.format(n=len(SNIPPETS))}) SELECT DISTINCT artifact_id, {cases(0)} AS rule, {cases(2)} AS value, {cases(3)} AS method FROM p")
def r01_r36_all_rules(spark, d):
    p = corpora.frame(spark, d, PARTS.format(n=len(SNIPPETS)))
    pick = lambda column: F.replace(F.get(F.array(*[F.lit(row[column]) for row in SNIPPETS]), F.col("k").cast("int")), F.lit("#"), F.col("n"))
    texts = p.select("artifact_id", pick(0).alias("wanted"), pick(1).alias("body"))
    found = rules.matches(texts).join(texts.select("artifact_id", "wanted"), "artifact_id").where("rule = wanted")
    return found.select("artifact_id", "rule", "value", "method").distinct()


@query(
    f"""{J} SELECT artifact_id, 'route' AS what, r AS value FROM j, (SELECT 'catalog' AS r UNION ALL SELECT '/home') UNION ALL SELECT artifact_id, 'sourcemap', 'b.js.map' FROM j
UNION ALL SELECT artifact_id, 'graphql', g FROM j, (SELECT 'Parts' AS g UNION ALL SELECT 'Save' UNION ALL SELECT 'Named')"""
)
def r33_r35_side_outputs(spark, d):
    more = " r=[{path: 'catalog'},{redirectTo: '/home'},{path: 'catalog'}] gql`query Parts { id }` graphql`mutation Save { ok }` {\"operationName\": \"Named\"}\n//# sourceMappingURL=a.js.map\n//# sourceMappingURL=b.js.map"
    return rules.side_outputs(scripts(spark, d).withColumn("body", F.concat("body", F.lit(more)))).select("artifact_id", "what", "value")


@query(f"{J} SELECT artifact_id, regexp_extract(body, '\"(https://[^\"]+)\"', 1) AS base FROM j")
def e04_base_urls(spark, d):
    return extract.base_urls(scripts(spark, d)).select("artifact_id", F.explode("bases").alias("base"))


@query(f"{J} SELECT artifact_id, regexp_extract(body, '\"(https://[^\"]+)\"', 1) || '/more/' || (artifact_id % 50) AS url, 'rule:concat,base:apiUrl' AS tags FROM j")
def e06_concatenations(spark, d):
    found = extract.analyze(scripts(spark, d)).where(F.col("seq.extractor") == extract.CONCATENATED)
    return found.select(F.col("seq.artifact").alias("artifact_id"), "url", F.array_join("tags", ",").alias("tags"))


#: Which paths a script of the corpus names, by key.
SAID = """CASE w WHEN 'parts' THEN '/api/parts/' || p WHEN 'sizes' THEN '/api/sizes/' || size WHEN 'save' THEN '/api/save/' || (p % 100) WHEN 'brands' THEN '/api/brands/' || (p % 25) WHEN 'beacon' THEN '/api/beacon'
  WHEN 'feed' THEN '/api/feed/' || (p % 3) WHEN 'api' THEN '/api' WHEN 'more' THEN '/base/more/' || (p % 50) WHEN 'base' THEN '/base' WHEN 'socket' THEN '/s/' || (p % 5) ELSE '/api/commented/' || p END"""
#: Calls go to the script's own host as written, and to the configured base at lower confidence; fetches of the call sweep to both at high.
CALLS = "(VALUES ('parts', 'PUT', true, 'REST'), ('parts', 'GET', false, 'REST'), ('sizes', 'GET', true, 'REST'), ('save', 'POST', true, 'REST'), ('brands', 'GET', true, 'REST'), ('beacon', 'POST', true, 'REST'), ('feed', 'GET', false, 'Stream/SSE')) c(w, method, seen, type)"
PATHS = "(VALUES ('parts'), ('sizes'), ('save'), ('brands'), ('beacon'), ('feed')) c(w)"
FETCHES = "(VALUES ('parts', 'PUT', true), ('parts', 'GET', false), ('commented', 'GET', false)) c(w, method, seen)"
HOSTS = "(VALUES (0), (1)) h(base)"
E01 = f"""SELECT w, method, base, seen AND base = 0 AS method_observed, type, CASE base WHEN 0 THEN 'high' ELSE 'medium' END AS confidence, 0 AS extractor FROM {CALLS}, {HOSTS}
UNION ALL SELECT w, 'GET', 0, false, 'REST', k, 0 FROM {PATHS}, (VALUES ('low'), ('medium')) t(k) UNION ALL SELECT 'api', 'GET', 0, false, 'REST', 'medium', 0
UNION ALL SELECT 'base', 'GET', 1, false, 'Unknown', k, 0 FROM (VALUES ('high'), ('medium'), ('low')) t(k) UNION ALL SELECT 'more', 'GET', 1, false, 'Unknown', 'high', 1
UNION ALL SELECT w, method, base, seen, 'REST', 'high', 2 FROM {FETCHES}, {HOSTS} UNION ALL SELECT 'save', 'POST', 0, true, 'REST', 'high', 3
UNION ALL SELECT 'socket', 'ANY', 2, false, 'WebSocket', 'high', e FROM (VALUES (0), (0), (4), (4)) t(e)"""
E01_CTE = f"""WITH z AS (SELECT p_partkey AS p, p_size AS size FROM part), r AS ({E01}),
e AS (SELECT method, CASE base WHEN 0 THEN 'https://www.example.com' WHEN 1 THEN 'https://api' || (p % 8) || '.example.com' ELSE 'wss://live.example.com' END || {SAID} AS url, method_observed, type, confidence, p AS artifact_id, extractor FROM z, r)"""


@query(f"{E01_CTE} SELECT * FROM e")
def e01_e15_analyze(spark, d):
    return extract.analyze(scripts(spark, d)).select("method", "url", "method_observed", "type", "confidence", F.col("seq.artifact").alias("artifact_id"), F.col("seq.extractor").alias("extractor"))


@query(f"{J} SELECT artifact_id, 'https://www.example.com/' || r AS url FROM j, (SELECT 'catalog' AS r UNION ALL SELECT 'items/list' UNION ALL SELECT 'home')")
def e11_spa_routes(spark, d):
    s = scripts(spark, d).withColumn("body", F.concat("body", F.lit(" routes=[{path: 'catalog', x:1},{path:'items/list'},{redirectTo: '/home'},{path: 'a.b'},{path: 'null'}]")))
    return extract.spa_routes(s)


@query(f"{J} SELECT artifact_id, 'https://www.example.com/js/maps/' || artifact_id || '.map' AS map_url FROM j WHERE artifact_id % 3 <> 0")
def e12_source_map_references(spark, d):
    own = F.when(F.col("artifact_id") % 3 == 0, "data:application/json;base64,e30=").otherwise(F.concat(F.lit("maps/"), "artifact_id", F.lit(".map")))
    return extract.source_map_references(scripts(spark, d).withColumn("body", F.concat("body", F.lit("\n//# sourceMappingURL=old.map\n//# sourceMappingURL="), own)))


@query(f"{J} SELECT artifact_id, CASE WHEN artifact_id % 2 = 0 THEN 'https://www.example.com/own/graphql' ELSE 'https://www.example.com/graphql' END AS url, 'graphql:api,mutation:Save,query:Parts' AS tags, 'Parts,Save' AS params FROM j")
def e13_graphql_operations(spark, d):
    own = F.when(F.col("artifact_id") % 2 == 0, ' fetch("/own/graphql")').otherwise("")
    s = scripts(spark, d).withColumn("body", F.concat("body", F.lit(" gql`query Parts { id }` gql`mutation Save { ok }`")))
    s = s.withColumn("body", F.concat(F.lit("/* */"), own, F.lit("\n"), "body"))
    return extract.graphql_operations(s).select("artifact_id", "url", F.array_join("tags", ",").alias("tags"), F.array_join("params", ",").alias("params"))


@query(f"{K_CTE} SELECT id, {NORM} AS url, type, 'GET' AS method FROM k WHERE {NORM} IS NOT NULL")
def e17_endpoint_of(spark, d):
    found = urls(spark, d).select("id", extract.endpoint_of(F.col("url"), F.lit("Manual")).alias("e")).where("e is not null")
    return found.select("id", "e.url", "e.type", "e.method")


@query(
    f"""{J} SELECT DISTINCT 'base' AS bucket, regexp_extract(body, '"(https://[^"]+)"', 1) AS url FROM j UNION SELECT 'schema', 'https://www.example.com/docs/' || (artifact_id % 4) || '/swagger.json' FROM j
UNION SELECT 'schema', 'https://api' || (artifact_id % 8) || '.example.com/docs/' || (artifact_id % 4) || '/swagger.json' FROM j
UNION SELECT 'route', 'https://www.example.com/r' || (artifact_id % 9) FROM j UNION SELECT 'map', 'https://www.example.com/js/m' || (artifact_id % 5) || '.map' FROM j
UNION SELECT 'asset', 'https://www.example.com/docs/' || (artifact_id % 4) || '/swagger.json' FROM j UNION SELECT 'asset', 'https://api' || (artifact_id % 8) || '.example.com/docs/' || (artifact_id % 4) || '/swagger.json' FROM j"""
)
def e19_absorbed(spark, d):
    part = lambda n: (F.col("artifact_id") % n).cast("string")
    more = F.concat(F.lit('; go("/docs/'), part(4), F.lit("/swagger.json\"); r=[{path: 'r"), part(9), F.lit("'}]\n//# sourceMappingURL=m"), part(5), F.lit(".map"))
    s = scripts(spark, d).withColumn("body", F.concat(F.regexp_replace("body", " // fetch.*$", ""), more))
    return crawl.absorbed(extract.analyze(s), s, "https://www.example.com/")


def described(spark, d, body, name: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.select(F.col("n_nationkey").cast("long").alias("artifact_id"), F.concat(F.lit("https://n"), "n_nationkey", F.lit(f".example.com/{name}")).alias("url"), F.lit("json").alias("kind"), body.alias("body"))


@query("SELECT 'https://n' || n_nationkey || '.example.com/' || x.p AS url, 'GET' AS method, 'robots.txt' AS source FROM nation, (SELECT 'api/private' AS p UNION ALL SELECT 'admin/list/') x")
def m01_robots(spark, d):
    a = described(spark, d, F.lit("User-agent: *\nDisallow: /api/private*\nAllow: /admin/list/$\nDisallow: /\nSitemap: /sitemap.xml\n"), "robots.txt")
    return documents.expand(a).select("url", "method", "source")


@query("SELECT 'https://n' || n_nationkey || '.example.com/sitemap.xml' AS url FROM nation")
def m01_sitemap_links(spark, d):
    a = described(spark, d, F.lit("User-agent: *\nSitemap: /sitemap.xml\n"), "robots.txt")
    return documents.sitemap_links(a).select("url")


@query("SELECT 'https://n' || n_nationkey || '.example.com/p/' || i AS url FROM nation, range(3) t(i)")
def m02_sitemaps(spark, d):
    locs = F.concat(*[F.concat(F.lit("<url><loc>https://n"), "artifact_n", F.lit(f".example.com/p/{i}</loc></url>")) for i in range(3)])
    n = spark.read.parquet(f"{d}/nation.parquet").withColumn("artifact_n", F.col("n_nationkey").cast("string"))
    body = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), locs, F.lit("</urlset>"))
    a = n.select(F.col("n_nationkey").cast("long").alias("artifact_id"), F.concat(F.lit("https://n"), "artifact_n", F.lit(".example.com/sitemap.xml")).alias("url"), F.lit("xml").alias("kind"), body.alias("body"))
    return documents.expand(a).select("url")


@query(
    """SELECT 'https://n' || n_nationkey || '.example.com' || v.path AS url, v.method, v.type, 'manifest.json' AS source FROM nation, (SELECT '/app' AS path, 'GET' AS method, 'Unknown' AS type UNION ALL SELECT '/', 'GET', 'Unknown'
  UNION ALL SELECT '/share', 'POST', 'Unknown' UNION ALL SELECT '/new', 'GET', 'Unknown') v
UNION ALL SELECT 'https://id.example.com/' || v.path, v.method, v.type, 'well-known' FROM nation, (SELECT '' AS path, 'GET' AS method, 'Unknown' AS type UNION ALL SELECT 'oauth/token', 'POST', 'Authentication') v"""
)
def m04_m07_manifest_well_known(spark, d):
    a = described(spark, d, F.lit('{"start_url": "/app", "scope": "/", "share_target": {"action": "/share"}, "shortcuts": [{"url": "/new"}]}'), "manifest.json")
    b = described(spark, d, F.lit('{"issuer": "https://id.example.com/", "token_endpoint": "https://id.example.com/oauth/token"}'), ".well-known/openid-configuration").withColumn("artifact_id", F.col("artifact_id") + 1000)
    return documents.expand(a.unionByName(b)).select("url", "method", "type", "source")


@query("SELECT 'https://n' || n_nationkey || '.example.com/' AS source_url, u.url, u.confidence FROM nation, (SELECT 'https://api.example.com/' AS url, 'low' AS confidence UNION ALL SELECT 'wss://live.example.com/', 'low' UNION ALL SELECT 'https://graph.example.com/graphql', 'high') u")
def m05_headers(spark, d):
    h = F.create_map(F.lit("Content-Security-Policy"), F.lit("default-src 'self'; connect-src https://*.api.example.com wss://live.example.com"), F.lit("X-GraphQL-URL"), F.lit("https://graph.example.com/graphql"))
    a = described(spark, d, F.lit(""), "").withColumn("headers", h)
    return documents.header_endpoints(a).select("source_url", "url", "confidence")


@query("SELECT 'https://n' || n_nationkey || '.example.com/' AS source_url, 'https://api.example.com/v1/me' AS url, 'cookie:sid' AS tag FROM nation")
def m06_cookies(spark, d):
    a = described(spark, d, F.lit(""), "").withColumn("cookies", F.create_map(F.lit("sid"), F.lit("x|https://api.example.com/v1/me"), F.lit("theme"), F.lit("dark")))
    return documents.cookie_endpoints(a).select("source_url", "url", "tag")


OPENAPI = '{"openapi": "3.0.0", "info": {"title": "T"}, "servers": [{"url": "https://api.example.com/v1"}], "paths": {"/parts/{id}": {"parameters": [{"name": "id", "in": "path"}], "get": {"operationId": "one", "tags": ["p"]}, "delete": {}}, "/parts": {"post": {}}}}'


@query("SELECT v.method, v.url, v.params, 'https://n' || n_nationkey || '.example.com/openapi.json' AS source_url FROM nation, (SELECT 'GET' AS method, 'https://api.example.com/v1/parts/{id}' AS url, 'id:path' AS params UNION ALL SELECT 'DELETE', 'https://api.example.com/v1/parts/{id}', 'id:path' UNION ALL SELECT 'POST', 'https://api.example.com/v1/parts', '') v")
def p01_p03_openapi(spark, d):
    a = described(spark, d, F.lit(OPENAPI), "openapi.json")
    return documents.expand(a).select("method", "url", F.array_join("params", ",").alias("params"), "source_url")


@query("SELECT 'https://n' || n_nationkey || '.example.com/arcgis/rest/services/' || v.u AS url, v.type FROM nation, (SELECT 'Roads/MapServer' AS u, 'ArcGIS REST' AS type UNION ALL SELECT 'Photo/ImageServer', 'Image Service' UNION ALL SELECT 'Utilities', 'ArcGIS REST') v")
def a02_arcgis_catalogue(spark, d):
    a = described(spark, d, F.lit('{"currentVersion": 10.9, "folders": ["Utilities"], "services": [{"name": "Roads", "type": "MapServer"}, {"name": "X/Photo", "type": "ImageServer"}]}'), "arcgis/rest/services")
    return documents.expand(a).select("url", "type")


@query("SELECT 'https://n' || n_nationkey || '.example.com/geoserver/ows' AS url, v.operation, v.n_layers FROM nation, (SELECT 'operation:GetMap' AS operation, 0 AS n_layers UNION ALL SELECT 'layers', 2) v")
def o01_o05_capabilities(spark, d):
    body = F.concat(
        F.lit('<WMS_Capabilities xmlns:xlink="http://www.w3.org/1999/xlink"><Capability><Request><GetMap><DCPType><HTTP><Get><OnlineResource xlink:href="https://n'),
        F.col("n_nationkey").cast("string"),
        F.lit('.example.com/geoserver/ows?SERVICE=WMS&amp;"/></Get></HTTP></DCPType></GetMap></Request><Layer><Layer><Name>a</Name></Layer><Layer><Name>b</Name></Layer></Layer></Capability></WMS_Capabilities>'),
    )
    a = described(spark, d, body, "geoserver/ows")
    return documents.expand(a).select("url", F.element_at("tags", 1).alias("operation"), F.size("params").alias("n_layers"))


OGC_PAIRS = """list_filter(string_split(q, '&'), lambda g: g LIKE '%=%' AND g NOT LIKE '%=' AND lower(regexp_extract(g, '^([^=]*)', 1)) NOT IN ('service', 'request', 'version', 'layers', 'layer', 'styles', 'style', 'format',
  'srs', 'crs', 'bbox', 'width', 'height', 'transparent', 'typename', 'typenames', 'outputformat', 'tilematrixset', 'tilematrix', 'tilerow', 'tilecol'))"""
OGC_BASE = f"{RAW} || '://' || a || p || CASE WHEN len({OGC_PAIRS}) = 0 THEN '' ELSE '?' || array_to_string({OGC_PAIRS}, '&') END"


@query(f"{U_CTE} SELECT id, {OGC_BASE} AS base FROM x")
def o02_ogc_base(spark, d):
    return urls(spark, d).select("id", extract.ogc_base(F.col("url")).alias("base"))


@query(
    f"""{U_CTE}, b AS (SELECT id, {OGC_BASE} AS base, CASE WHEN regexp_matches(lower(url), '[?&]service=(wms|wmts|wfs|wcs|csw|wps)(&|$)') THEN upper(regexp_extract(lower(url), '[?&]service=(wms|wmts|wfs|wcs|csw|wps)(&|$)', 1))
  WHEN contains(lower(p), '/wmts') THEN 'WMTS' WHEN contains(lower(p), '/wms') THEN 'WMS' WHEN contains(lower(p), '/wfs') THEN 'WFS' WHEN contains(lower(p), '/wcs') THEN 'WCS' WHEN contains(lower(p), '/csw') THEN 'CSW' WHEN contains(lower(p), '/wps') THEN 'WPS'
  WHEN regexp_matches(lower(p), '/(geoserver|ows|mapserv|qgis)([^a-z0-9]|$)') THEN 'WMS' END AS service FROM x)
SELECT id, base || CASE WHEN contains(base, '?') THEN '&' ELSE '?' END || 'service=' || service || '&request=GetCapabilities&version=' ||
  CASE service WHEN 'WMS' THEN '1.3.0' WHEN 'WMTS' THEN '1.0.0' WHEN 'WFS' THEN '2.0.0' WHEN 'WCS' THEN '2.0.1' WHEN 'CSW' THEN '2.0.2' ELSE '1.0.0' END AS address FROM b"""
)
def o03_capabilities_url(spark, d):
    return urls(spark, d).select("id", extract.capabilities_url(F.col("url")).alias("address"))


@query("SELECT n_nationkey AS artifact_id, v.name, v.origin FROM nation, (SELECT 'src/app.js' AS name, 'origin:app.js' AS origin UNION ALL SELECT 'src/lib/net.js', 'origin:net.js') v")
def x01_x02_source_maps(spark, d):
    body = '{"version": 3, "sources": ["src/app.js", "node_modules/a.js"], "sourcesContent": ["fetch(1)", "x"], "sections": [{"map": {"sources": ["src/lib/net.js"], "sourcesContent": ["y"]}}]}'
    a = described(spark, d, F.lit(body), "app.js.map").withColumn("kind", F.lit("map"))
    return documents.source_map_files(a).select("artifact_id", "name", "origin").withColumn("artifact_id", F.col("artifact_id").cast("int"))


@query(f"{K_CTE} SELECT id AS request_id, {NORM} AS url, type FROM k WHERE s IN ('http', 'https', 'ws', 'wss') AND NOT {any_sql('lower(p)', V.INFRASTRUCTURE)} AND (type <> 'Unknown' OR id % 2 = 0)")
def n01_network_log(spark, d):
    log = urls(spark, d).select(F.col("id").alias("request_id"), "url", F.lit("GET").alias("method"), F.when(F.col("id") % 2 == 0, "xhr").otherwise("document").alias("resource_type"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("content_type"))
    return documents.network_endpoints(log).select("request_id", "url", "type")


@query(f"{U_CTE} SELECT id, regexp_extract(url, '(?i)^(.*?/(mapserver|imageserver))(/|$)', 1) AS root, lower(regexp_extract(url, '(?i)/(mapserver|imageserver)(/|$)', 1)) AS kind FROM x WHERE id % 20 IN (4, 18)")
def a01_arcgis_service(spark, d):
    return urls(spark, d).select("id", detect.arcgis_service(F.col("url")).alias("s")).where("s is not null").select("id", "s.root", "s.kind")


@query(f"{U_CTE} SELECT id, (regexp_matches(rtrim(lower(p), '/'), '(/graphql|/gql)$') OR regexp_matches(lower(p), '/graphiql|/altair|/playground|/voyager')) AS graphql, {any_sql('lower(url)', V.SWAGGER)} AS swagger FROM x")
def g01_p04_service_documents(spark, d):
    return urls(spark, d).select("id", detect.is_graphql(F.col("url")).alias("graphql"), detect.looks_like_swagger(F.col("url")).alias("swagger"))


@query("SELECT o_orderkey AS id, 'https://a.example.com/docs/' || (o_orderkey % 5) || '/' || n.name AS candidate FROM orders, (SELECT 'swagger.json' AS name UNION ALL SELECT 'openapi.json' UNION ALL SELECT 'v1/swagger.json' UNION ALL SELECT 'swagger/v1/swagger.json') n")
def p04_schema_candidates(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    page = F.concat(F.lit("https://a.example.com/docs/"), F.col("o_orderkey") % 5, F.lit("/index.html"))
    return o.select(F.col("o_orderkey").alias("id"), F.explode(detect.schema_candidates(page)).alias("candidate"))


@query("SELECT n_nationkey AS artifact_id, 'https://n' || n_nationkey || '.example.com/src/' || v.f AS source FROM nation, (SELECT 'app.js' AS f UNION ALL SELECT 'lib/net.js') v")
def x03_original_sources(spark, d):
    body = '{"sourceRoot": "/src/", "sources": ["app.js", "lib/net.js", "webpack://x/y.js", "node_modules/a.js"]}'
    return detect.original_sources(described(spark, d, F.lit(body), "js/app.js.map")).withColumn("artifact_id", F.col("artifact_id").cast("int"))


@query("SELECT p_partkey AS artifact_id, v.name FROM part, (SELECT 'React' AS name, 0 AS k UNION ALL SELECT 'Axios', 1 UNION ALL SELECT 'D3', 2) v WHERE p_partkey % 3 = v.k")
def h11_source_technologies(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey") % 3
    return detect.source_technologies(p.select(F.col("p_partkey").alias("artifact_id"), F.when(k == 0, "x=react-dom").when(k == 1, "throw new AxiosError").otherwise("d3.select(1)").alias("body")))


@query("SELECT p_partkey AS page_id, 'https://api.example.com/v1/' || v.k AS url FROM part, (SELECT 1 AS k UNION ALL SELECT 2) v")
def s16_stored_urls(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return detect.stored_urls(p.select(F.col("p_partkey").alias("page_id"), F.lit(0).alias("ord"), F.lit('{"a":"https://api.example.com/v1/1","b":["https://api.example.com/v1/2","https://api.example.com/v1/1"]}').alias("value")))


@query("SELECT page_id, page_id % 3 <> 2 AS textual FROM pages")
def s10_textual(spark, d):
    kind = F.element_at(F.array(F.lit("text/html; charset=utf-8"), F.lit(None).cast("string"), F.lit("image/png")), (F.col("page_id") % 3 + 1).cast("int"))
    return pages(spark, d).select("page_id", crawl.textual(kind, F.col("html")).alias("textual"))


@query(f"{M_CTE} SELECT method, url, CASE WHEN status_code IS NULL AND method = 'GET' AND url LIKE '%7' THEN 204 ELSE status_code END AS status_code, (status_code IS NULL AND method = 'GET' AND url LIKE '%7') AS checked FROM m")
def c10_verified(spark, d):
    m = merged(spark, d)
    r = m.where("url like '%7'").select("url", F.lit(204).alias("status_code"), F.lit("text/plain").alias("content_type"), F.lit(None).cast("string").alias("error"))
    return scan.verified(m, r).select("method", "url", "status_code", F.array_contains("tags", "verified").alias("checked"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/?#]*', 0), '^http', 'ws') AS socket FROM pages")
def u21_to_websocket(spark, d):
    return pages(spark, d).select("page_id", U.to_websocket(U.origin(F.col("url"))).alias("socket"))


@query(
    f"""{E01_CTE}, o AS (SELECT method, url, method_observed, type, confidence FROM e UNION ALL SELECT m, 'https://api.example.com/v1/parts' || p, true, 'REST', 'high' FROM (VALUES ('GET', '/{{id}}'), ('DELETE', '/{{id}}'), ('POST', '')) t(m, p)),
m AS (SELECT method, url, bool_or(method_observed) AS method_observed, CASE WHEN url LIKE '%/api/feed/%' THEN 'Stream/SSE' ELSE coalesce(max(type) FILTER (type <> 'Unknown'), 'Unknown') END AS type,
  CASE max(CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM o GROUP BY method, url)
SELECT method, url, type, confidence, method_observed FROM m WHERE method_observed OR url NOT IN (SELECT url FROM m WHERE method_observed)"""
)
def scan_end_to_end(spark, d):
    none = spark.createDataFrame([], "url string")
    a = described(spark, d, F.lit(OPENAPI), "openapi.json").withColumn("source_kind", F.lit("JSON"))
    shape = ["artifact_id", "url", "kind", "source_kind", "body"]
    found = scan.scan(pages(spark, d), scripts(spark, d).select(*shape).unionByName(a.select(*shape)), none)
    return found.select("method", "url", "type", "confidence", "method_observed")


SITEMAP = '<?xml version="1.0"?><{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


@query(
    """SELECT 'https://n' || n_nationkey || '.example.com/' || v.page AS url, 'https://n' || n_nationkey || '.example.com/' || v.map AS source_url, v.type, v.method
FROM nation, (SELECT 'api/a' AS page, 'a.xml' AS map, 'REST' AS type, 'GET' AS method UNION ALL SELECT 'login', 'a.xml', 'Authentication', 'POST' UNION ALL SELECT 'feed.json', 'b.xml', 'Static JSON', 'GET') v"""
)
def m03_sitemap_pages(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("https://n"), "n_nationkey", F.lit(".example.com/")).alias("host"), F.col("n_nationkey").cast("long").alias("k"))
    loc = lambda *paths: F.concat(*[F.concat(F.lit("<x><loc>"), F.col("host"), F.lit(p + "</loc></x>")) for p in paths])
    document = lambda k, name, root, body: n.select((F.col("k") * 4 + k).alias("artifact_id"), F.concat("host", F.lit(name)).alias("url"), F.concat(F.lit(SITEMAP.format(root=root)), body, F.lit(f"</{root}>")).alias("body"))
    docs = document(0, "sitemap.xml", "sitemapindex", loc("a.xml", "b.xml", "gone.xml")).unionByName(document(1, "a.xml", "urlset", loc("api/a", "about", "login")))
    docs = docs.unionByName(document(2, "b.xml", "urlset", loc("feed.json", "contact"))).unionByName(document(3, "c.xml", "urlset", loc("api/never")))
    return crawl.sitemap_pages(n.select(F.concat("host", F.lit("sitemap.xml")).alias("url"), F.col("k").alias("ord")), docs, docs=None)


@query(
    """SELECT 'https://n' || n_nationkey || '.example.com' || v.path AS url, v.method, v.type FROM nation, (SELECT '/v1/p' AS path, 'GET' AS method, 'REST' AS type UNION ALL SELECT '/v1/p', 'PUT', 'REST' UNION ALL SELECT '/docs/swagger.json', 'GET', 'Swagger/OpenAPI'
  UNION ALL SELECT '/arcgis/rest/services/R/MapServer/7', 'GET', 'ArcGIS REST' UNION ALL SELECT '/arcgis/rest/services/R/MapServer/7/query', 'GET', 'ArcGIS REST' UNION ALL SELECT '/arcgis/rest/services/R/MapServer/' || o, 'GET', 'ArcGIS REST'
  FROM (VALUES ('export'), ('identify'), ('find'), ('legend'), ('layers')) t(o)) v"""
)
def p05_schema_stage(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("https://n"), "n_nationkey", F.lit(".example.com")).alias("host"), F.col("n_nationkey").cast("long").alias("k"))
    at = lambda bucket, path: n.select(F.lit(bucket).alias("bucket"), F.concat("host", F.lit(path)).alias("url"))
    found = at("schema", "/docs/swagger-ui").unionByName(at("arcgis", "/arcgis/rest/services/R/MapServer"))
    document = lambda k, path, body: n.select((F.col("k") * 3 + k).alias("artifact_id"), F.concat("host", F.lit(path)).alias("url"), F.lit("json").alias("kind"), F.lit(body).alias("body"))
    captured = document(0, "/docs/swagger.json", '{"swagger": "2.0", "basePath": "/v1", "paths": {"/p": {"get": {}, "put": {}}}}').unionByName(document(1, "/arcgis/rest/services/R/MapServer?f=json", '{"currentVersion": 11, "layers": [{"id": 7}]}'))
    captured = captured.unionByName(document(2, "/other/swagger.json", '{"swagger": "2.0", "paths": {"/never": {"get": {}}}}'))
    return crawl.schema_stage(found, captured, "https://www.example.com/").select("url", "method", "type")


@query(f"{U_CTE} SELECT id, CASE WHEN s IN ('http', 'https') THEN {NORM} END AS target, 'https://' || h || '/' AS bare FROM x")
def s01_normalise_target(spark, d):
    u = urls(spark, d)
    return u.select("id", U.normalise_target(F.concat(F.lit("  "), "url")).alias("target"), U.normalise_target(U.host_of(F.col("url"))).alias("bare"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN chr(65533) || 'ab' WHEN 1 THEN left(html, 100) ELSE html END AS body FROM (SELECT page_id, regexp_replace(html, '[^\\x00-\\x7F]', '?', 'g') AS html FROM pages)")
def s04_decoded_bodies(spark, d):
    p = pages(spark, d).withColumn("html", F.regexp_replace("html", "[^\\x00-\\x7F]", "?")).withColumn("k", F.col("page_id") % 3)
    raw = F.when(F.col("k") == 0, F.unhex(F.lit("FF6162"))).otherwise(F.col("html").cast("binary"))
    return p.select("page_id", crawl.decoded(raw, F.when(F.col("k") == 1, 100)).alias("body"))


@query(
    """SELECT CAST(n_nationkey AS VARCHAR) AS file, v.name, v.value, v.domain FROM nation, (SELECT 0 AS k, 'sid' AS name, 'a' AS value, 'x.com' AS domain UNION ALL SELECT 0, 'id', '2', '' UNION ALL SELECT 1, 'k', 'v', '' UNION ALL SELECT 2, 'sid', 'abc', 'x.com') v
WHERE n_nationkey % 3 = v.k"""
)
def s15_cookie_files(spark, d):
    bodies = ('[{"name": "sid", "value": "a", "domain": ".x.com"}, {"name": "id", "value": 1}, {"name": "id", "value": 2}, {"value": 3}]', '{"k": "v", "o": {}}', "# c\n#HttpOnly_.x.com\tTRUE\t/\tTRUE\t0\tsid\tabc\nshort\n")
    n = spark.read.parquet(f"{d}/nation.parquet")
    files = n.select(F.col("n_nationkey").cast("string").alias("file"), F.get(F.array(*map(F.lit, bodies)), F.col("n_nationkey") % 3).alias("body"))
    return cookies.merged(cookies.read_cookies(files)).select("file", "name", "value", "domain")


@query(
    """SELECT 'https://www.example.com/api/s/' || v.n AS url, 'origin:' || v.f AS origin, count(*) AS n FROM nation, (SELECT 'one' AS n, 'app.js' AS f UNION ALL SELECT 'two', 'net.js') v GROUP BY ALL
UNION ALL SELECT 'https://api' || (page_id % 5) || '.example.com/api/blob', '', count(*) FROM pages GROUP BY ALL"""
)
def x02_e16_embedded_texts(spark, d):
    body = '{"sources": ["src/app.js", "lib/net.js", "node_modules/n.js"], "sourcesContent": ["fetch(\\"/api/s/one\\")", "fetch(\\"/api/s/two\\")", "fetch(\\"/api/s/no\\")"]}'
    n = spark.read.parquet(f"{d}/nation.parquet")
    a = n.select(F.col("n_nationkey").cast("long").alias("artifact_id"), F.lit("https://www.example.com/app.js.map").alias("url"), F.lit("map").alias("kind"), F.lit("SourceMap").alias("source_kind"), F.lit(body).alias("body"))
    p = pages(spark, d).withColumn("html", F.concat("html", F.lit('<script type="application/json">{"u": "https://api'), (F.col("page_id") % 5).cast("string"), F.lit('.example.com/api/blob"}</script>')))
    found = scan.observations(p, a).where("(source = 'SourceMap' and confidence = 'high') or url like 'https://api%/api/blob'")
    origin = F.coalesce(F.get(F.filter("tags", lambda t: t.startswith("origin:")), F.lit(0)), F.lit(""))
    return found.select("seq", "url", origin.alias("origin")).dropDuplicates(["url", "origin", "seq"]).groupBy("url", "origin").agg(F.countDistinct(F.struct("seq.stage", "seq.artifact")).alias("n"))


@query(
    f"""{K_CTE}, w AS (SELECT {NORM} AS url, type, method, id, s, url AS raw FROM (SELECT *, {VERB} AS method FROM k))
SELECT id AS capture_id, url, 'ANY' AS method, 'WebSocket' AS type, 'WebSocketFrame' AS source, 'high' AS confidence FROM w WHERE s IN ('ws', 'wss')
UNION ALL SELECT id, 'https://www.example.com/sw' || (id % 7) || '.js', 'GET', 'Unknown', 'ServiceWorker', 'high' FROM w
UNION ALL SELECT id, url, 'GET', type, 'JavaScript', 'low' FROM w WHERE regexp_matches(raw, '^https?://') AND type <> 'Unknown'"""
)
def n02_e10_captures(spark, d):
    u = urls(spark, d)
    worker = F.concat(F.lit("https://www.example.com/sw"), (F.col("id") % 7).cast("string"), F.lit(".js"))
    stored = F.concat(F.lit('{"a": "'), "url", F.lit('", "b": ["'), "url", F.lit('"]}'))
    c = u.select(F.col("id").alias("capture_id"), F.lit("https://www.example.com/").alias("page_url"), F.array("url").alias("sockets"), F.array(worker).alias("workers"), F.array(stored).alias("storage"), F.lit(None).cast("string").alias("html"))
    return captures.observations(c).select(F.col("seq.artifact").alias("capture_id"), "url", "method", "type", "source", "confidence")


@query(f"{ANCHORS}, e AS (SELECT DISTINCT url, h, p FROM anchors) SELECT DISTINCT url FROM e WHERE {EXT} IN ('', 'html', 'htm', 'php', 'asp', 'aspx', 'jsp', 'do', 'action') AND {DOMAIN} = 'example.com'")
def n02_rendered_routes(spark, d):
    p = pages(spark, d).select(F.col("page_id").alias("capture_id"), F.col("url").alias("page_url"), "html")
    return captures.rendered_routes(p, "https://www.example.com/")


@query(f"{ANCHORS} SELECT page_id, url, CAST(min(k) + 2 AS INTEGER) AS ord FROM anchors GROUP BY ALL")
def h13_all_resources(spark, d):
    return html.all_resources(html.resources(pages(spark, d))).select("page_id", "url", "ord")


@query(f"{K_CTE} SELECT id, type = 'Swagger/OpenAPI' AS documented FROM k")
def c04_is_documentation(spark, d):
    return urls(spark, d).select("id", C.is_documentation(C.classify(F.col("url"))).alias("documented"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(least(event_id % 50, 30) AS DOUBLE) ELSE least(pow(2.0, event_id % 6) + (event_id % 5) / 10.0, 15.0) END AS delay FROM events"""
)
def t02_retry_delay(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")
    asked = F.when(k % 4 == 0, (k % 50).cast("string")).when(k % 4 == 1, "Wed, 21 Oct")
    return e.select("event_id", crawl.retry_delay(k % 6, asked, (k % 5) / F.lit(10.0)).alias("delay"))


@query("SELECT 'https://www.example.com/c' || n_nationkey || '-' || i || '.js' AS url FROM nation, range(5) t(i)")
def s11_t05_asset_rounds(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    name = lambda i: F.concat(F.lit("https://www.example.com/c"), F.col("k").cast("string"), F.lit("-"), i.cast("string"), F.lit(".js"))
    a = n.select((F.col("k") * 10 + F.col("i")).alias("artifact_id"), name(F.col("i")).alias("url"), F.lit("js").alias("kind"), F.lit("JavaScript").alias("source_kind"), F.concat(F.lit('import("'), name(F.col("i") + 1), F.lit('")')).alias("body"))
    start = n.where("i = 0").select(name(F.col("i")).alias("url"))
    return crawl.asset_rounds(start, a, "https://www.example.com/", 4, None)


@query("SELECT 'https://n' || n_nationkey || '.example.com/app.js.map' AS url, 'src/a.js' AS name FROM nation WHERE n_nationkey < 6")
def t06_source_map_batches(spark, d):
    a = described(spark, d, F.lit('{"sources": ["src/a.js"], "sourcesContent": ["x"]}'), "app.js.map").withColumn("kind", F.lit("map"))
    maps = a.select("url", F.col("artifact_id").alias("ord"))
    return crawl.source_map_batches(maps, a, 2, 3).select("url", "name")
