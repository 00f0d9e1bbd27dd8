"""Intermediate tables in the folder that all executors share.

A written table cuts lineage: what follows starts from files, survives lost
executors without a second parse, and reads only the columns that it needs.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one is made only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="codexferry-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


#: Spark's setting to remove the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
_writing: dict[SparkSession, int] = {}
_before: dict[SparkSession, str | None] = {}


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that begin here go when these end, not when the driver happens to collect its garbage.

    The session's own setting comes back with the last of several writes side by side.
    """
    with _lock:
        if not _writing.get(spark):
            _before[spark] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writing[spark] = _writing.get(spark, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _writing[spark] -= 1
            if not _writing[spark]:
                del _writing[spark]
                before = _before.pop(spark)
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def scratch(spark: SparkSession) -> str:
    """A new shared folder for tables that ``remove`` takes away again."""
    return f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Take away a ``scratch`` folder once what was read from its tables is written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, uri: str | None = None, by: str | None = None) -> DataFrame:
    """Write a table and read it back; to ``uri`` or to a new shared folder.

    ``by`` is a column of few values that becomes a directory level.
    """
    spark = df.sparkSession
    uri = uri or f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    with _shuffles_removed(spark):
        (writer.partitionBy(by) if by else writer).parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def together(*jobs: Callable[[], DataFrame]) -> list[DataFrame]:
    """Run jobs that do not depend on each other side by side; each gives a table."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for an input of few partitions; a large input stays as it is."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, key) if df.rdd.getNumPartitions() < tasks else df
