"""Session settings the jobs are written for."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Repeated keys in a log line are legal JSON; the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "turnledger", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The cluster's shared scratch folder; a temporary one of our own only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured or not spark.sparkContext.master.startswith("local"):
        return configured
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; all of an application's lie under its own name."""
    root = shared_folder(spark)
    if not root:
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    return f"{root.rstrip('/')}/turnledger-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Several readers of an expensive frame (a scan of raw logs) then read a small columnar table
    instead of repeating the work, and a lost executor costs one re-read. The folder of an
    application can be dropped when it ends. A cluster that names no shared folder gets a
    persisted frame, which keeps its lineage.
    """
    spark = df.sparkSession
    if not shared_folder(spark):
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = work_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``staged`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files or "/turnledger-" not in files[0]:
        df.unpersist()
        return
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Add a broadcast hint only after counting at most ``max_rows + 1`` rows of ``df``.

    A larger frame is returned without the hint, so Spark picks a shuffled join.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return df.hint("broadcast")
    return df
