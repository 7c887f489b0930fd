"""Stage tables in the cluster's shared folder.

The table-wide limits, averages and thresholds need further passes over a stage. A written
table gives each of those passes column pruning, is computed once however many passes follow,
and outlives a lost executor.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folders written by this driver and not released yet.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names, else a folder of its warehouse.

    Both are on the file system that driver and executors share.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return folder.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let iterative training cut its lineage in the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_folder(spark)}/ferrowatch/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Writes in here delete what they shuffled as soon as they end, not when the driver collects garbage.

    Only for writes: nothing can read the shuffles of a write again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as parquet to a new directory of the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what this driver has staged; returns the number of folders.

    For callers that have read their results: frames built on a stage cannot be read afterwards.
    """
    released = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        released += bool(system.delete(path, True))
    return released
