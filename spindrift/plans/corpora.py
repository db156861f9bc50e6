"""Test corpora made from the driver's tables, as SQL that Spark and DuckDB both run.

Each is a SELECT over base tables; `frame` runs it in Spark, and an oracle puts it in a WITH clause.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: URLs of all kinds from orders: id, url (normal form already but for rows 1, 2 and 15).
URLS = """
SELECT o_orderkey AS id, CASE o_orderkey % 20
  WHEN 0 THEN 'https://shop' || (o_custkey % 50) || '.example.com/api/v1/orders/' || o_orderkey || '?status=' || o_orderstatus || '&page=' || (o_orderkey % 7)
  WHEN 1 THEN 'HTTPS://WWW.Example.ORG:443//catalog///items/' || o_custkey || '#top'
  WHEN 2 THEN 'http://www.example.co.uk:8080/users/' || o_custkey || '/profile?'
  WHEN 3 THEN 'https://data' || (o_custkey % 9) || '.example.net/graphql'
  WHEN 4 THEN 'https://maps.example.com/arcgis/rest/services/Layer' || (o_custkey % 30) || '/MapServer/' || (o_orderkey % 5)
  WHEN 5 THEN 'https://geo.example.com/geoserver/ows?service=WFS&request=GetFeature&typename=t' || (o_custkey % 30)
  WHEN 6 THEN 'https://tiles.example.com/tiles/{z}/{x}/{y}.pbf'
  WHEN 7 THEN 'https://id.example.com/oauth2/token'
  WHEN 8 THEN 'wss://live.example.com/socket/' || (o_custkey % 11)
  WHEN 9 THEN 'https://static.example.com/data/feed' || (o_custkey % 13) || '.json'
  WHEN 10 THEN 'https://cdn.example.com/img/logo' || (o_custkey % 17) || '.png'
  WHEN 11 THEN 'https://api.example.com/swagger.json'
  WHEN 12 THEN 'https://api.example.com/events/stream'
  WHEN 13 THEN 'https://api.example.com/ws/service.asmx?wsdl'
  WHEN 14 THEN 'https://api.example.com/v2/items/create'
  WHEN 15 THEN 'ftp://files.example.com/pub/' || o_orderkey
  WHEN 16 THEN 'https://app.example.com.tr/session/0123456789abcdef' || (o_custkey % 10) || '/view'
  WHEN 17 THEN 'https://app.example.com/cdn-cgi/trace'
  WHEN 18 THEN 'https://img.example.com/arcgis/rest/services/Photo/ImageServer'
  ELSE 'https://10.0.0.' || (o_custkey % 200) || '/page/' || o_orderkey || '/' END AS url
FROM orders
"""

#: Three waves of observations of the same URLs, with an order.
OBSERVATIONS = """
SELECT CASE WHEN w.k = 2 THEN 'POST' ELSE 'GET' END AS method,
  'https://api' || (o_custkey % 40) || '.example.com/v1/things/' || (o_orderkey % 500) AS url,
  (w.k = 2 OR o_orderkey % 11 = 0) AS method_observed,
  CASE WHEN (o_orderkey + w.k) % 3 = 0 THEN 'Unknown' WHEN o_orderkey % 5 = 0 THEN 'GraphQL' ELSE 'REST' END AS type,
  CASE w.k WHEN 0 THEN 'HTML' WHEN 1 THEN 'JavaScript' ELSE 'Network' END AS source,
  'https://www.example.com/p/' || (o_custkey % 25) AS source_url,
  'seen ' || o_orderkey || ' wave ' || w.k AS evidence,
  CASE (o_orderkey + w.k) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN (o_orderkey + w.k) % 7 = 0 THEN 200 END AS status_code,
  CASE WHEN (o_orderkey + w.k) % 7 = 0 THEN 'application/json' END AS content_type,
  'p' || (o_orderkey % 4) AS param, 'wave:' || w.k AS tag, o_orderkey * 10 + w.k AS seq
FROM orders CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) AS w
"""

#: JavaScript artefacts from parts: artifact_id, url, kind, source_kind, body.
SCRIPTS = """
SELECT p_partkey AS artifact_id, 'https://www.example.com/js/app' || p_partkey || '.js' AS url, 'js' AS kind, 'JavaScript' AS source_kind,
  'var apiUrl = "https://api' || (p_partkey % 8) || '.example.com/base"; fetch("/api/parts/' || p_partkey || '", {method: "PUT"}); ' ||
  'axios.get("/api/sizes/' || p_size || '"); var x = new XMLHttpRequest(); x.open("POST", "/api/save/' || (p_partkey % 100) || '"); ' ||
  '$.getJSON("/api/brands/' || (p_partkey % 25) || '"); navigator.sendBeacon("/api/beacon"); new EventSource("/api/feed/' || (p_partkey % 3) || '"); ' ||
  'new WebSocket("wss://live.example.com/s/' || (p_partkey % 5) || '"); load(apiUrl + "/more/' || (p_partkey % 50) || '"); // fetch("/api/commented/' || p_partkey || '")' AS body
FROM part
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a corpus in Spark over the driver's tables."""
    names = sorted(set(re.findall(r"\b(?:FROM|JOIN)\s+(region|nation|customer|supplier|part|orders|lineitem|events|documents|pages|conversations)\b", sql)))
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    text = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **tables)
