"""The order-aware merge of observations into endpoints.

Observations of one (method, url) are folded in the order of `seq`; Spark has no row order, so each
rule is an aggregate that says which row it means. All are minima and maxima but for the lists, which are sets of the different
arrays; all combine before the shuffle, so that an endpoint that every script names is a few rows, however often it was seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import confidence_rank

RANKS = ("low", "medium", "high")


def _first(value: Column | str, order: Column, where: Column | None = None) -> Column:
    """Value of the first row in the order, of those that satisfy `where`."""
    value = F.col(value) if isinstance(value, str) else value
    return F.min_by(value, order if where is None else F.when(where, order))


def merge_observations(obs: DataFrame, seq: str = "seq") -> DataFrame:
    """One row a (method, url). `seq` orders the observations of a scan; ties would be ambiguous."""
    order, rank = F.col(seq), confidence_rank(F.col("confidence"))
    status = F.col("status_code").isNotNull()
    # evidence changes only at a strictly higher confidence, and then only to a text that isn't empty, so that
    # nothing but the first row of each confidence can be told
    firsts = [F.min(F.when(rank == r, F.struct(order.alias("seq"), F.lit(r).alias("rank"), F.col("evidence").alias("evidence")))) for r in range(len(RANKS))]
    start = F.struct(F.lit(-1).alias("rank"), F.lit(None).cast("string").alias("evidence"))
    told = F.aggregate(
        F.array_sort(F.array_compact(F.array(*firsts))),
        start,
        lambda acc, r: F.when(
            r["rank"] > acc["rank"],
            F.struct(r["rank"].alias("rank"), F.when((acc["rank"] < 0) | (r["evidence"] != ""), r["evidence"]).otherwise(acc["evidence"]).alias("evidence")),
        ).otherwise(acc),
    )
    union = lambda c: F.when(F.count("*") == 1, F.first(c)).otherwise(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))))
    first_status, any_status = _first("status_code", order), F.max(F.when(status, True))
    late = first_status.isNull() & any_status.isNotNull()
    return obs.groupBy("method", "url").agg(
        F.bool_or("method_observed").alias("method_observed"),
        F.coalesce(_first("type", order, F.col("type") != "Unknown"), F.lit("Unknown")).alias("type"),
        F.when(late, _first("source", order, status)).otherwise(_first("source", order)).alias("source"),
        F.when(late, F.coalesce(F.nullif(_first("source_url", order, status), F.lit("")), _first("source_url", order))).otherwise(_first("source_url", order)).alias("source_url"),
        told["evidence"].alias("evidence"),
        F.element_at(F.array(*map(F.lit, RANKS)), F.max(rank) + 1).alias("confidence"),
        _first("status_code", order, status).alias("status_code"),
        _first("content_type", order, F.col("content_type").isNotNull()).alias("content_type"),
        union("params").alias("params"),
        union("tags").alias("tags"),
        F.count("*").alias("n_observations"),
    )
