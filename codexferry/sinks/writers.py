"""Documents, indexes, transfer lists, manifests and ledgers on storage."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterable
from itertools import groupby
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.operators.provision import LEDGER_COLUMNS
from codexferry.sinks.commits import commit
from codexferry.sources.archives import SERVED, new_file
from codexferry.sources.tables import ledger_state, ledger_version, read_ledger


def write_documents(documents: DataFrame, uri: str) -> None:
    """Documents (``path``, ``content``) as a table."""
    documents.select("path", "content").write.mode("overwrite").parquet(uri)


def export_files(files: DataFrame, root: str) -> None:
    """Each ``path`` of ``path, content`` as a file below ``root``.

    ``root`` is an address that the executors' file systems serve: a folder that all of them
    share, or an object store. With a ``part`` column the parts of a path make one file, in
    order: they are sorted by path and appended as they stream by, so that no file has to
    fit into memory. A file appears once it is whole; a task that runs again replaces its files.
    """
    scheme = urlsplit(root).scheme
    if scheme not in SERVED:
        raise ValueError(f"{root}: no file system of the executors serves {scheme}:")
    home = root.rstrip("/") if scheme else os.path.abspath(root)

    def write(rows: Iterable) -> None:
        for path, parts in groupby(rows, key=lambda row: row["path"]):
            target = posixpath.normpath(path)
            if target.split("/")[0] in ("", ".", ".."):
                raise ValueError(f"path leaves the folder: {path}")
            with new_file(f"{home}/{target}") as out:
                for row in parts:
                    data = row["content"]
                    out.write(data.encode("utf-8") if isinstance(data, str) else data)

    if "part" in files.columns:
        files = files.repartition("path").sortWithinPartitions("path", "part")
    files.select("path", "content").foreachPartition(write)


def write_index(files: DataFrame, uri: str) -> None:
    """Indexes (``path``, ``part``, ``content``) as a table.

    A directory or file per notebook would make the commit as slow as there are
    notebooks; :func:`export_files` makes real files where they are needed.
    """
    files.select("path", "part", "content").write.mode("overwrite").parquet(uri)


def write_transfer_manifest(transfer: DataFrame, uri: str) -> None:
    """Transfer rows as CSV; each part has the header and is a list of its own."""
    (
        transfer.select(*C.TRANSFER_COLUMNS)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(uri)
    )


def write_manifest(tables: dict[str, DataFrame], totals: DataFrame | None, uri: str) -> None:
    """Child tables as parquet and the totals as one line of JSON.

    Without ``totals`` they are measured as the tables are written: no child is read twice for
    its count. Only the owners of the notebooks, which have to be told apart, are counted after.
    """
    base = uri.rstrip("/")
    if totals is not None:
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{base}/{name}")
        totals.write.mode("overwrite").json(f"{base}/totals")
        return
    seen = {name: Observation(f"{name}-{uuid.uuid4().hex}") for name in tables}
    for name, table in tables.items():
        counts = [F.count(F.lit(1)).alias("n")]
        if name == "sources":
            counts.append(F.count_if(F.col("source_url") != "").alias("urls"))
        table.observe(seen[name], *counts).write.mode("overwrite").parquet(f"{base}/{name}")
    spark = tables["notebooks"].sparkSession
    n = {name: observed.get for name, observed in seen.items()}
    row = {
        "notebook_count": n["notebooks"]["n"],
        "total_sources": n["sources"]["n"],
        "total_urls_recovered": n["sources"]["urls"],
        "total_notes": n["notes"]["n"],
        "total_artifacts": n["artifacts"]["n"],
        "total_errors": n["errors"]["n"] if "errors" in n else 0,
    }
    owners = spark.read.parquet(f"{base}/notebooks").select(
        F.greatest(F.count_distinct("owner_email"), F.lit(1)).alias("user_count"),
        *(F.lit(v).cast("long").alias(k) for k, v in row.items()),
    )
    owners.write.mode("overwrite").json(f"{base}/totals")


def write_nested_manifest(nested: DataFrame, uri: str) -> None:
    """Notebooks with nested children as JSON lines; nulls are kept."""
    nested.write.mode("overwrite").option("ignoreNullFields", False).json(uri)


#: Deltas of a ledger that a reader merges; more are compacted when entries are saved.
COMPACT_AFTER = 20


def write_ledger(ledger: DataFrame, uri: str, version: int = 1, upto: int | None = None) -> int:
    """Commit all entries of a ledger in place of what was there; gives the commit's number.

    Readers follow the commits, so a write that breaks off changes nothing for them. With
    ``upto`` the entries stand for the commits up to that one only.
    """
    base = uri.rstrip("/")
    folder = f"snapshot-{uuid.uuid4().hex}"
    ledger.select(*LEDGER_COLUMNS).write.parquet(f"{base}/entries/{folder}")
    return commit(ledger.sparkSession, base, "snapshot", folder, version, upto)


def save_entries(entries: DataFrame, uri: str, version: int = 1) -> int:
    """Add new entries to the ledger; gives the commit's number, ``version`` or the next free one.

    Only the new entries are written. Of several writers at once each gets a number of its own
    and no entry is lost: readers merge what was committed, the latest entry of a key wins.
    """
    spark, base = entries.sparkSession, uri.rstrip("/")
    folder = f"delta-{uuid.uuid4().hex}"
    entries.select(*LEDGER_COLUMNS).write.parquet(f"{base}/entries/{folder}")
    number = commit(spark, base, "delta", folder, version)
    if len(ledger_state(spark, base)[1]) > COMPACT_AFTER:
        compact_ledger(spark, base)
    return number


def compact_ledger(spark: SparkSession, uri: str) -> int | None:
    """Write what the deltas so far merge to as a snapshot; reads give the same before and after.

    Commits that others make meanwhile stay on top of it.
    """
    base = uri.rstrip("/")
    upto = ledger_version(spark, base)
    if not upto:
        return None
    return write_ledger(read_ledger(spark, base, upto), base, upto + 1, upto)


def clear_ledger(spark: SparkSession, uri: str, version: int = 1) -> int:
    """Commit that nothing is left of the entries so far."""
    return commit(spark, uri.rstrip("/"), "clear", None, version)
