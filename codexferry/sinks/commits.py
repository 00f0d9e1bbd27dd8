"""A log of numbered commits: small files that are there whole or not at all, each written once."""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``kind`` is "delta" (rows to merge), "snapshot" (all rows up to commit ``upto``) or "clear".
COMMIT_SCHEMA = "version long, kind string, folder string, upto long"


def put_if_absent(spark: SparkSession, uri: str, text: str) -> bool:
    """Make a file with this text, or say that there is one already.

    The text is written under a name of its own, which readers skip, and gets the final name
    in one step that fails if that name is taken: a link in shared folders, a rename elsewhere
    (atomic where the store's rename refuses existing names, as HDFS does).
    """
    if urlsplit(uri).scheme in ("", "file"):
        path = re.sub(r"^file:/*(?=/)", "", uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}")
        with open(own, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(own, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(own)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    own = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(own, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not files.exists(path) and files.rename(own, path):
        return True
    files.delete(own, False)
    return False


def commits(spark: SparkSession, base: str) -> DataFrame | None:
    """All commits of a log, None if there is no log."""
    try:
        return spark.read.schema(COMMIT_SCHEMA).json(f"{base}/commits")
    except AnalysisException:
        return None


def newest(spark: SparkSession, base: str) -> int:
    log = commits(spark, base)
    return 0 if log is None else log.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def commit(spark: SparkSession, base: str, kind: str, folder: str | None, least: int = 1, upto: int | None = None) -> int:
    """Take the next free number, at least ``least``; a number that another writer takes first is left to it.

    Without ``upto`` a snapshot or clear stands for everything up to its own number.
    """
    version = max(newest(spark, base) + 1, least)
    while True:
        row = {"version": version, "kind": kind, "folder": folder, "upto": version if upto is None else upto}
        if put_if_absent(spark, posixpath.join(base, "commits", f"{version:020d}.json"), json.dumps(row)):
            return version
        version += 1
