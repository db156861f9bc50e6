"""A corpus pipeline: stages over documents, each written and read again by the next.

Quality rules, near-duplicate removal, removal of repeated passages, mixing, packing. Each
stage takes all that the one before kept; all but the last return the columns of documents.

Defined results, for every stage: a null text is empty, and its document goes at the first stage, which asks for ten words; a
null id, source or other column is carried along; rows given twice are one document to near-dedup, which keeps one; unlike texts
under one id are documents of their own; of near copies the smallest id stays, null last; further columns are kept; an empty
table gives an empty one. The near-dedup stage has its own limits (copies.py), and the passage stage its own match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import mixing, packing, quality, repeats, simhash
from spindrift.session import materialize, release, ship

#: 99 % of all runs of 51 words in the sf0.1 documents have as many bytes or more (op6 keeps its 400).
PASSAGE_BYTES, PASSAGE_GRAM = 240, 60


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees fitted on the labels."""
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    ship(spark)
    return simhash.keep_one_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats elsewhere; a character cut in two goes, and so do documents of which no word is left."""
    ship(spark)
    found = repeats.remove_repeats(docs, PASSAGE_BYTES, PASSAGE_GRAM, carry=docs.columns)
    text = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("rest.text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    columns = [F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col(f"rest.`{c}`")).alias(c) if c in new else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return found.where(text.rlike(mixing.WORD)).select(*columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or cut so that sources come to their targets."""
    return mixing.mixed_documents(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences."""
    ship(spark)
    return packing.pack(spark, docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("mixing to target weights", source_mix),
    ("best-fit packing", best_fit),
]
#: Hashes, fitted trees and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(*stored)  # the new table needs nothing of the one before
        stored = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
