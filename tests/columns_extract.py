"""Extraction of observations by column expressions, a row to each match: what extract.analyze is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import url as U
from spindrift.functions.classify import classify, guess_method
from spindrift.operators.extract import BASES, COMMENTED, FANOUT, is_noise


def has_api_signal(url: Column) -> Column:
    return U.any_of(F.lower(url), U.API_MARKERS)


def base_urls(matches: DataFrame) -> DataFrame:
    """artifact_id and bases: the first different absolute URLs among configuration values."""
    value = U.clean_candidate(F.col("value"))
    found = U.bind(matches.where("extractor = 0 and rule like 'config:%'"), "v", value).where("(v like 'http://%' or v like 'https://%') and instr(v, '${') = 0")
    found = U.bind(found, "base", U.normalize(F.regexp_replace("v", "/+$", ""))).where("base is not null").groupBy("artifact_id", "base").agg(F.min("ord").alias("ord"))
    listed = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "base"))), 1, BASES), lambda b: b["base"])
    return found.groupBy("artifact_id").agg(listed.alias("bases"))


def _observation(m: DataFrame, url: Column, kind: Column, method: Column, observed: Column, confidence: Column, tags: Column, base: Column) -> DataFrame:
    seq = F.struct(F.lit(2).alias("stage"), F.col("artifact_id").alias("artifact"), F.col("extractor").alias("extractor"), F.col("ord").alias("ord"), base.alias("base"))
    none = lambda t: F.lit(None).cast(t)
    return m.select(
        method.alias("method"), url.alias("url"), observed.alias("method_observed"), kind.alias("type"), F.col("source_kind").alias("source"), F.col("source_url"),
        F.coalesce(F.nullif(F.col("evidence"), F.lit("")), F.col("value")).alias("evidence"), confidence.alias("confidence"), none("int").alias("status_code"),
        none("string").alias("content_type"), F.array().cast("array<string>").alias("params"), tags.alias("tags"), seq.alias("seq"),
    )


def from_matches(artifacts: DataFrame, matches: DataFrame) -> DataFrame:
    """Observations of the general sweep: every match on its own artefact, and proven call sites on up to FANOUT bases."""
    about = artifacts.select("artifact_id", F.col("url").alias("source_url"), "source_kind")
    m = matches.where("extractor = 0").join(about, "artifact_id").join(base_urls(matches), "artifact_id", "left")
    m = m.where(~(F.col("in_comment") & F.col("source_kind").isin(COMMENTED)))
    m = U.bind(m, "raw", U.clean_candidate(F.col("value"))).where(U.is_probably_url(F.col("raw")))
    m = U.bind(m, "cand", U.strip_placeholders(F.col("raw")))
    fan = F.when(F.col("cand").startswith("/") & (F.col("confidence") == "high"), F.slice(F.coalesce("bases", F.array().cast("array<string>")), 1, FANOUT)).otherwise(F.array().cast("array<string>"))
    first = U.absolutize(F.col("source_url"), F.col("cand"))
    others = F.transform(fan, lambda b: U.absolutize(b, F.col("cand")))
    m = m.withColumn("resolved", F.array_distinct(F.array_compact(F.concat(F.array(first), others))))
    m = U.bind(m.select("*", F.posexplode("resolved").alias("base", "full")), "norm", U.normalize(F.col("full")))
    m = m.where("norm is not null").where(~is_noise(F.col("norm"), F.col("evidence")))
    m = U.bind(m, "kind", classify(F.col("norm"), F.col("rule")))
    m = m.where(~((F.col("kind") == "Unknown") & (F.col("confidence") == "low") & ~has_api_signal(F.col("norm"))))
    inferred = F.col("base") > 0
    tags = F.concat(F.array(F.concat(F.lit("rule:"), F.col("rule"))), F.when(inferred, F.array(F.lit("base:inferred"))).otherwise(F.array().cast("array<string>")))
    return _observation(
        m, F.col("norm"), F.col("kind"), guess_method(F.col("norm"), F.col("kind"), F.col("method")), F.col("method").isNotNull() & ~inferred,
        F.when(inferred, "medium").otherwise(F.col("confidence")), tags, F.col("base"),
    )


def from_calls(artifacts: DataFrame, matches: DataFrame) -> DataFrame:
    """Fetches on all bases at high confidence, opens, and sockets: neither comments nor noise are filtered here."""
    about = artifacts.select("artifact_id", F.col("url").alias("source_url"), "source_kind")
    calls = matches.where("rule in ('fetch', 'XMLHttpRequest', 'new WebSocket', 'ws-url') or rule like 'var:%'").join(about, "artifact_id").join(base_urls(matches), "artifact_id", "left")
    calls = calls.withColumn("extractor", F.when(F.col("rule") == "fetch", 2).when(F.col("rule").isin("new WebSocket", "ws-url"), 4).otherwise(3))
    calls = U.bind(calls, "cand", U.strip_placeholders(U.clean_candidate(F.col("value")))).where(U.is_probably_url(F.col("cand")))
    fan = F.when((F.col("rule") == "fetch") & F.col("cand").startswith("/"), F.coalesce("bases", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    own = U.absolutize(F.col("source_url"), F.col("cand"))
    own = F.when((F.col("extractor") == 4) & ~F.col("cand").rlike("(?i)^wss?://"), U.to_websocket(own)).otherwise(own)
    calls = calls.select("*", F.posexplode(F.array_distinct(F.array_compact(F.concat(F.array(own), F.transform(fan, lambda b: U.absolutize(b, F.col("cand"))))))).alias("base", "full"))
    calls = U.bind(calls, "norm", U.normalize(F.col("full"))).where("norm is not null and (extractor <> 4 or norm like 'ws%')")
    calls = U.bind(calls, "kind", classify(F.col("norm"), F.col("rule")))
    observed = F.when(F.col("extractor") == 4, F.lit(False)).otherwise(F.col("method").isNotNull())
    return _observation(calls, F.col("norm"), F.col("kind"), guess_method(F.col("norm"), F.col("kind"), F.col("method")), observed, F.col("confidence"), F.array(F.concat(F.lit("rule:"), F.col("rule"))), F.col("base"))


def from_concatenations(artifacts: DataFrame, matches: DataFrame) -> DataFrame:
    """base + "/path" where the base resolves in the same text: joined as written, not as a reference."""
    about = artifacts.select("artifact_id", F.col("url").alias("source_url"), "source_kind")
    m = matches.where("rule like 'concat:%'").join(about, "artifact_id")
    halves = F.split("value", "\0")
    m = U.bind(m, "norm", U.normalize(F.concat(F.get(halves, F.lit(0)), U.strip_placeholders(F.get(halves, F.lit(1)))))).where("norm is not null")
    m = U.bind(m, "kind", classify(F.col("norm"), F.lit("concat")))
    tags = F.array(F.lit("rule:concat"), F.concat(F.lit("base:"), F.substring("rule", 8, 100)))
    return _observation(m, F.col("norm"), F.col("kind"), guess_method(F.col("norm"), F.col("kind")), F.lit(False), F.col("confidence"), tags, F.lit(0))
