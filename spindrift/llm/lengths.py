"""Token counts through an exact histogram of encoded lengths.

Each text is encoded whole and the documents are aggregated by length at once, so what is
stored is a row to each length and, where asked for, each group. Suffix sums over the
histogram then answer, exactly and for every context limit c: how many documents and tokens
are longer than c, all tokens with documents cut at c, and any quantile of the lengths. A suffix
sum is the group's total less the running sum, so that one pass over the sorted lengths gives all.

Defined results: null and empty texts have length 0; repeated rows count each; null groups are a
group; an empty table gives an empty histogram and no report rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .arrowio import slices
from .tokens import public_path, word_bpe

TOKENIZER = "word_bpe_49k.json"
SHARES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
SUMS = ("context_limit", "n_docs", "docs_within", "tokens_within", "docs_over", "tokens_over", "tokens_truncated")


def histogram(docs: DataFrame, by: list[Column] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """length and n_docs, with the columns `by` before them."""
    by = by or []
    names = [f"by{k}" for k in range(len(by))]
    kinds = ", ".join(f"{n} string" for n in names)

    def run(batches):
        encoder = word_bpe(public_path(tokenizer))
        for batch in batches:
            for part in slices(batch, 4 << 20):
                ids = encoder.batch([t or "" for t in part.column(0).to_pylist()])
                lengths = pa.array(np.asarray([len(b) // 4 for b in ids], np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lengths], names=[*names, "length"])

    given = docs.select(F.col("text").cast("string").alias("text"), *[c.cast("string").alias(n) for c, n in zip(by, names)])
    lengths = given.mapInArrow(run, f"{kinds}, length long" if names else "length long")
    return lengths.groupBy(*names, "length").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame, by: list[str]) -> DataFrame:
    """For each length c that occurs: the answers at context limit c.

    One running sum over a group's lengths serves all limits; a group has at most as many rows as lengths.
    """
    up = Window.partitionBy(*by).orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    tokens = F.col("length") * F.col("n_docs")
    within, tokens_within = F.sum("n_docs").over(up), F.sum(tokens).over(up)
    return hist.select(
        *by,
        F.col("length").alias("context_limit"),
        "n_docs",
        within.alias("docs_within"),
        tokens_within.alias("tokens_within"),
        (F.sum("n_docs").over(whole) - within).alias("docs_over"),
        (F.sum(tokens).over(whole) - tokens_within).alias("tokens_over"),
    ).withColumn("tokens_truncated", F.col("tokens_within") + F.col("docs_over") * F.col("context_limit"))


def at_limit(hist: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Totals for one limit, which needn't be a length that occurs: the sums at the largest length that is within it."""
    sums = limits(hist, by)
    answer = F.max_by(F.struct("docs_within", "tokens_within", "docs_over"), F.when(F.col("context_limit") <= limit, F.col("context_limit")))
    each = sums.groupBy(*by).agg(F.sum("n_docs").alias("n_docs"), F.sum(F.col("context_limit") * F.col("n_docs")).alias("n_tokens"), answer.alias("_a"))
    over = F.coalesce(F.col("_a.docs_over"), F.col("n_docs"))
    return each.select(*by, "n_docs", "n_tokens", (F.coalesce(F.col("_a.tokens_within"), F.lit(0)) + over * limit).alias("tokens_truncated"), over.alias("docs_over"))


def quantiles(hist: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """Per group and share q: the smallest length that at least q of the documents don't exceed."""
    sums = limits(hist, by).withColumn("_all", F.col("docs_within") + F.col("docs_over"))
    each = sums.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return each.where(F.col("docs_within") >= F.col("share") * F.col("_all")).groupBy(*by, "share").agg(F.min("context_limit").alias("length"))


def report(docs: DataFrame, tokenizer: str = TOKENIZER, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """For each source, null being one, and for all documents together (all_sources): a row to each limit and to each quantile.

    Rows of kind `limit` leave share null; rows of kind `quantile` answer at the quantile's length, which is a limit too.
    """
    own = materialize(histogram(docs, [F.col("source")], tokenizer), "lengths")
    whole = own.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    both = own.withColumn("all_sources", F.lit(False)).unionByName(whole.select(F.lit(None).cast("string").alias("by0"), "length", "n_docs", F.lit(True).alias("all_sources")))
    by = ["all_sources", "by0"]
    sums = materialize(limits(both, by), "limits").withColumn("_all", F.col("docs_within") + F.col("docs_over"))
    # a limit answers the shares between the documents below it and those within it
    below = F.col("docs_within") - F.col("n_docs")
    of = F.filter(F.array(*[F.lit(float(s)) for s in shares]), lambda s: (F.col("docs_within") >= s * F.col("_all")) & (below < s * F.col("_all")))
    rows = sums.withColumn("share", F.explode(F.concat(F.array(F.lit(None).cast("double")), of)))
    return rows.select(F.when(F.col("share").isNull(), "limit").otherwise("quantile").alias("kind"), "all_sources", F.col("by0").alias("source"), "share", *SUMS)
