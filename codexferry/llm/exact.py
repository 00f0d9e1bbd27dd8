"""Exact duplicates by a 128-bit content hash and a comparison of bytes within groups.

A text is compared as it reads: every run of white space counts as one space, a null text as an
empty one. Rows are grouped by the 128-bit hash of that text; of a group, the row with the smallest
key stays. Hash and digest are computed once and written as a narrow table; texts are not moved.

The hash alone would merge texts that collide. So the bytes are compared as well: the least and the
greatest text of a hash are equal only if all its texts are. Both are summed up per task before the
shuffle, so a group of any size sends one row per task, and a large group is no large task. Only
texts of hashes with several rows take part as long as those hashes are few enough to be sent to
all tasks. Texts that share a hash and differ are grouped by the text itself.

Only DataFrame functions: no Python runs on the executors.

Defined results: one row per input row. Nulls and empty texts are one group, as are texts of white
space only (they read as one space). Of rows with an equal key and text, one stays. A null key is
never the smallest; of a group that has null keys only, one row stays and ``keep_id`` is null. An
empty table gives an empty one. Other columns do no harm, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexferry.llm.common import BROADCAST_KEYS, unused_name
from codexferry.storage import materialize

#: White space that is not one space already.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normal(text: Column) -> Column:
    """The text with each run of white space as one space; empty for a null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", hashed: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) per row of ``df``."""
    found = _grouped(df.select(F.col(key).alias("key"), F.col(text).alias("text")), F.monotonically_increasing_id(), hashed)
    return found.select(F.col("key").alias(key), F.col("keep.key").alias("keep_id"), "group_size", "kept", "text_sha256")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    row = unused_name(df, "row")
    numbered = materialize(df.withColumn(row, F.monotonically_increasing_id()))
    narrow = numbered.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(row).alias("number"))
    dropped = _grouped(narrow, F.col("number"), content_hash).where("not kept").select(F.col("row").alias(row))
    return numbered.join(dropped, row, "left_anti").drop(row)


def _grouped(rows: DataFrame, row: Column, hashed: Callable[[Column], Column]) -> DataFrame:
    """(key, row, keep, group_size, kept, text_sha256) of rows ``key, text``."""
    texts = rows.withColumn("row", row).withColumn("text", normal(F.col("text"))).withColumn("hash", hashed(F.col("text")))
    # What the row number gives is frozen here: later steps read it.
    narrow = materialize(texts.select("key", "row", "hash", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")))
    sizes = narrow.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(sizes.select("hash"))
    compared = texts.select("hash", "text")
    if shared.count() <= BROADCAST_KEYS:
        compared = compared.join(F.broadcast(shared), "hash", "left_semi")
    differ = compared.groupBy("hash").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least < most")
    differ = materialize(differ.select("hash"))
    # Equal bytes: the hash names the group. Otherwise the digest of the text joins it, and the text decides.
    if differ.isEmpty():
        return _kept(narrow, ["hash"])
    same = _kept(narrow.join(differ, "hash", "left_anti"), ["hash"])
    mixed = texts.join(differ, "hash", "left_semi").withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    return same.unionByName(_kept(materialize(mixed), ["hash", "text"]))


def _kept(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with size and smallest row of their group; groups of one row need no join."""
    order = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    groups = rows.groupBy(*by).agg(F.count("*").alias("size"), F.min(order).alias("keep")).where("size > 1")
    groups = materialize(groups)
    if groups.count() <= BROADCAST_KEYS and "text" not in by:
        groups = F.broadcast(groups)
    keep = F.coalesce("keep", order)
    out = rows.join(groups, by, "left").withColumn("keep", keep).withColumn("group_size", F.coalesce("size", F.lit(1)).cast("long"))
    return out.withColumn("kept", F.col("keep.row") == F.col("row")).select("key", "row", "keep", "group_size", "kept", "text_sha256")
