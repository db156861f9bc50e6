"""Small helpers for functions that Spark maps over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def utf8_column(name: str, alias: str = "body"):
    """The column's UTF-8 bytes; null stays null."""
    return F.col(name).cast("string").cast("binary").alias(alias)


def map_rows(df: DataFrame, one_batch: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """Apply a batch-to-batch function, slicing what Spark hands over so memory follows bytes and not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = one_batch(part)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch in runs of rows of about `most_bytes` (a single row may be larger)."""
    n = batch.num_rows
    if not n:
        return
    rows = max(1, int(n * most_bytes / max(1, batch.nbytes)))
    for at in range(0, n, rows):
        yield batch.slice(at, rows)
