"""Session helpers: shipping the package to executors and shared scratch tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}
_own_scratch: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers on every executor.

    The package is zipped once per Spark application and served by the
    driver, so workers don't depend on their working directory.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spindrift-")
    target = os.path.join(folder, "spindrift_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(target)
    _shipped[app] = target


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor can see, as `spark.checkpoint.dir` names it.

    Where the setting is missing a local run uses a folder of its own; a cluster,
    whose executors don't share one, must name it.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="spindrift-scratch-")
    return _own_scratch[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context may be gone; the folder is scratch space
        pass


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{scratch_dir(spark)}/spindrift/{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Cuts the lineage, so that what follows survives lost executors without
    repeating what came before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._spindrift_path = path
    return stored


def stored_at(stored: DataFrame) -> str:
    """Where a table that `materialize` gave lies."""
    return stored._spindrift_path


def release(*stored: DataFrame) -> None:
    """Delete tables that `materialize` gave, once nothing that will still run reads them."""
    for df in stored:
        _forget(df.sparkSession, df._spindrift_path)
