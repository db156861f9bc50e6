"""Report queries: groups, counts, degrees, history differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U


def group_routes(urls: DataFrame) -> DataFrame:
    """Counts of URLs by host and route template."""
    route = U.templatize(F.col("url"))
    return urls.groupBy(U.host_of(F.col("url")).alias("host"), route.alias("route")).agg(F.count("*").alias("n"))


def group_by_host(urls: DataFrame) -> DataFrame:
    host = U.host_of(F.col("url"))
    return urls.groupBy(F.when(host == "", "?").otherwise(host).alias("host")).agg(F.count("*").alias("n"))


def type_counts(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("type").agg(F.count("*").alias("n"))


def summarize(endpoints: DataFrame) -> DataFrame:
    """One row: endpoints, hosts, routes, high confidence, observed."""
    return endpoints.agg(
        F.count("*").alias("total"),
        F.countDistinct(U.host_of(F.col("url"))).alias("hosts"),
        F.countDistinct(U.templatize(F.col("url"))).alias("routes"),
        F.count_if(F.col("confidence") == "high").alias("high_confidence"),
        F.count_if(F.col("status_code").isNotNull()).alias("observed"),
    )


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("category").agg(F.count("*").alias("n"))


def edges(endpoints: DataFrame) -> DataFrame:
    """source -> url, each pair once."""
    return endpoints.where("source_url is not null").select(F.col("source_url").alias("src"), F.col("url").alias("dst"), F.col("source").alias("relation")).groupBy("src", "dst").agg(F.max("relation").alias("relation"))


def top_sources(endpoints: DataFrame, limit: int = 10) -> DataFrame:
    """Sources by the number of different URLs they name; a source that is an endpoint itself is none."""
    pairs = endpoints.where("source_url is not null").select(F.col("source_url").alias("src"), "url").distinct()
    own = endpoints.select(F.col("url").alias("src")).distinct()
    return pairs.join(own, "src", "left_anti").groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(limit)


def facets(endpoints: DataFrame) -> DataFrame:
    """Different types and methods, and the number of sources."""
    kinds = endpoints.select(F.lit("type").alias("facet"), F.col("type").alias("value")).distinct()
    verbs = endpoints.select(F.lit("method").alias("facet"), F.col("method").alias("value")).distinct()
    count = endpoints.agg(F.lit("sources").alias("facet"), F.countDistinct("source_url").cast("string").alias("value"))
    return kinds.unionByName(verbs).unionByName(count)


def scan_counters(artifacts: DataFrame) -> DataFrame:
    """Documents and bytes by kind."""
    return artifacts.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).cast("long").alias("n_bytes"))


def history_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Endpoints that came and went between two scans."""
    keys = ["method", "url"]
    came = new.select(*keys).distinct().join(old.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("added"))
    went = old.select(*keys).distinct().join(new.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("removed"))
    return came.unionByName(went)
