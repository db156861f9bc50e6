"""A left join that no hot key can slow down: keys that many rows share are broadcast, and only those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_HOT = 1000


def left_join_split(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, spread: list[Column], most_hot: int = MOST_HOT) -> DataFrame:
    """`rows` left joined to `table`, whose keys `on` are unique and not null; `weight` says how many rows have a key.

    Keys of more than total / most_hot rows are fewer than `most_hot`, whatever the table holds, so that they are broadcast
    safely; their rows are dealt by `spread` in the shuffle of all others, in which no key has more rows than that.
    """
    values = [c for c in table.columns if c not in on]
    hot = F.col(weight) * most_hot > total
    few = table.where(hot).select(*on, F.struct(*values).alias("_few"))
    rest = table.where(~hot).select(*on, F.lit(0).cast("long").alias("_deal"), F.struct(*values).alias("_rest"))
    marked = rows.join(F.broadcast(few), on, "left")
    dealt = marked.withColumn("_deal", F.when(F.col("_few").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*spread)))
    # the rest grows with the corpus: one plan at every size, and never a broadcast
    joined = dealt.join(rest.hint("merge"), [*on, "_deal"], "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col("_few")[c], F.col("_rest")[c]).alias(c) for c in values])
