"""Connected components by alternating large and small stars.

Each step takes a minimum for every node by partial aggregation and a join back,
which adaptive execution splits where a node is a hub; nothing is gathered on the
driver, and each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release

ROUNDS = 60  # far beyond the logarithmic need; reached only by a fault


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def star_forest(edges: DataFrame) -> DataFrame:
    """From edges (a, b): one row (a, b) for each node a that isn't its component's smallest, with b the smallest."""
    now = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    for _ in range(ROUNDS):
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if not mark["n"] or (mark["n"], mark["h"]) == seen:
            return now
        seen = (mark["n"], mark["h"])
        last, now = now, materialize(_small_star(_large_star(now)), "edges")
        release(last)  # the new table needs nothing of it
    raise RuntimeError("components did not settle")
