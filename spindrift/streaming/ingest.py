"""Artefacts as a stream: observations are appended, and merged endpoints are kept up by the keys a batch touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, merge


def start(artifacts: DataFrame, observations: str, checkpoint: str, available_now: bool = True):
    """Analyse each batch of artefacts and append its observations as parquet, by batch."""

    def one(batch: DataFrame, batch_id: int) -> None:
        # a batch that is repeated after a failure overwrites its own folder
        extract.analyze(batch).write.mode("overwrite").parquet(f"{observations}/batch={batch_id}")

    writer = artifacts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged(spark: SparkSession, observations: str) -> DataFrame:
    """Endpoints of all batches so far."""
    return merge.merge_observations(spark.read.parquet(observations))


def host_counts(pages: DataFrame, ts: str, watermark: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Pages by host and event-time window, late rows dropped beyond the watermark."""
    from ..functions.url import host_of

    timed = pages.withWatermark(ts, watermark)
    return timed.groupBy(F.window(ts, window), host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


__all__ = ["start", "merged", "host_counts"]
