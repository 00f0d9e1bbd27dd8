"""Positions, lists and pairings that stay even when one key holds most rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexferry.storage import materialize

CHUNK_ITEMS = 1000
# Rows of one key that a single task may sort.
MAX_GROUP = 1_000_000


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """1-based position of each row within its key, in the given (unique) order.

    Group sizes are measured first. If none is above ``max_group``, a window by key
    does it in one shuffle. Else a hot key would be sorted in one task, so the rows
    are ranged by key and order and counted range by range.
    """
    if keys and _groups_within(df, keys, max_group):
        by_key = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(by_key).cast("long"))
    return _number_by_range(df, keys, order, name)


def _groups_within(df: DataFrame, keys: Sequence[str], bound: int) -> bool:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("n") > bound).isEmpty()


def _number_by_range(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """A hot key spans many ranges; each starts where the ranges before it ended.

    The ranged rows are written because counts and rows must see the same ranges.
    """
    tagged = materialize(
        df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    )
    ranges = tagged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # Only a key that crosses a range edge has an offset: fewer rows than ranges,
    # whatever the size of the data, so they may be broadcast.
    offsets = (
        ranges.withColumn("_offset", F.sum("_n").over(before))
        .where(F.col("_offset") > 0)
        .select(
            *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
            F.col("_range").alias("_offset_range"),
            "_offset",
        )
    )
    local = W.partitionBy("_range", *keys).orderBy(*order)
    match = F.col("_range") == F.col("_offset_range")
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_key_{i}"))
    offset = F.coalesce(F.col("_offset"), F.lit(0).cast("long"))
    return (
        tagged.withColumn("_local", F.row_number().over(local).cast("long"))
        .join(F.broadcast(offsets), match, "left")
        .withColumn(name, F.col("_local") + offset)
        .select(*df.columns, name)
    )


def chunk_of(position: Column, size: int = CHUNK_ITEMS) -> Column:
    return F.floor((position - 1) / size).cast("int")


def nest_chunks(
    df: DataFrame,
    keys: Sequence[str],
    item: Column,
    position: str = "position",
    name: str = "items",
    size: int = CHUNK_ITEMS,
) -> DataFrame:
    """Ordered lists per key, at most ``size`` items per row.

    A key of ordinary size has the single chunk 0; a hot key has many, so no row
    and no task holds an unbounded list.
    """
    pairs = F.struct(F.col(position).alias("position"), item.alias("item"))
    return (
        df.select(*keys, chunk_of(F.col(position), size).alias("chunk"), pairs.alias("_pair"))
        .groupBy(*keys, "chunk")
        .agg(
            F.transform(F.array_sort(F.collect_list("_pair")), lambda p: p["item"]).alias(name)
        )
    )


def pair_all(
    left: DataFrame, right: DataFrame, left_id: Sequence[str], right_id: Sequence[str]
) -> DataFrame:
    """Every left row with every right row, for an operator whose result is just that.

    Rows are placed on a grid of equal cells and joined by cell, so no side has to fit
    into a task and the result is spread evenly. There are a few cells per shuffle
    partition, and each side has its share of the grid's lines by its number of rows: a
    single row meets a line of many cells, not a square of which it fills one column.
    """
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, columns = grid(left.count(), right.count(), 4 * partitions)

    def cell(ids, lines):
        return F.pmod(F.xxhash64(*ids), F.lit(lines)).cast("int")

    def every(lines):
        return F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))

    low = left.withColumn("_row", cell(left_id, rows)).withColumn("_column", every(columns))
    high = right.withColumn("_column", cell(right_id, columns)).withColumn("_row", every(rows))
    return low.join(high, ["_row", "_column"]).drop("_row", "_column")


def grid(n_left: int, n_right: int, cells: int) -> tuple[int, int]:
    """Lines of a grid of about ``cells`` cells, in proportion to the sides, at most one per row."""
    rows = round(math.sqrt(cells * max(1, n_left) / max(1, n_right)))
    rows = min(max(1, rows), max(1, n_left), cells)
    columns = min(-(-cells // rows), max(1, n_right))
    return rows, columns
