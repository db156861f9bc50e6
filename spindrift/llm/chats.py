"""Logged conversations: collapsing snapshots, and rendering.

Chat logs often hold a conversation once for each turn, every snapshot being a prefix of
the next. A rolling hash of each turn prefix (the exclusive or of position-salted hashes
of the turns so far, twice 64 bits) names it. A conversation whose last prefix is a proper
prefix of a longer one goes, by an anti-join on those names; of equal conversations the one with
the smallest id stays. What is left is rendered turn by turn.

Everything is DataFrame expressions. Prefixes are aggregated before the join, so a first
turn that everyone shares is one row.

Defined results: turns are ordered by turn, ties by role and text; equal rows are turns each; a null
role or text is its own value and renders empty; rows with a null conv_id belong to no conversation
and are left out; null turns come first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with its position and the name of the prefix it ends: conv_id, pos, role, text, x, y."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null")
    each = each.withColumn("pos", F.row_number().over(order))
    # nulls are told apart from empty strings by their flags
    parts = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    hashed = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "pos", *parts)).over(so_far)
    return each.select("conv_id", "pos", "role", "text", hashed(1).alias("x"), hashed(2).alias("y"))


def maximal(named: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations to keep."""
    last = Window.partitionBy("conv_id")
    ends = named.select("conv_id", "pos", "x", "y").withColumn("n_turns", F.max("pos").over(last))
    whole = ends.where("pos = n_turns").groupBy("x", "y", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = ends.where("pos < n_turns").groupBy("x", "y", F.col("pos").alias("n_turns")).agg(F.lit(1).alias("_one"))
    return whole.join(proper, ["x", "y", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and rendered of every maximal conversation."""
    named = materialize(prefixes(turns), "prefixes")
    kept = maximal(named)
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    shown = named.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("_turns"))
    return shown.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.transform("_turns", lambda t: t["line"]), "").alias("rendered"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, pos, n_turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
           OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown
  FROM t
), w AS (
  SELECT shown, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies
  FROM p WHERE pos = n_turns GROUP BY shown, n_turns
)
SELECT conv_id, n_turns, n_copies, shown AS rendered FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.pos = w.n_turns AND p.shown = w.shown)
"""
