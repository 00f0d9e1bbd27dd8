"""Hard negatives by exact integer scores, multiplied modulo small primes.

Components are whole numbers (``floor(scale * x)``), and a score is their inner product. A matrix
product in 32-bit floats is exact only below 2^24, so the components are taken modulo several
primes, with residues around zero: along a run of ``RUN`` components a product of residues stays
below 2^24. The products of the primes are put together by Chinese remaindering in mixed radix
with signed digits, which gives the exact signed score. The number of primes follows from the
largest component.

An anchor's positives are its first other rows of the same label, its negatives the first rows of
other labels whose score lies between ``low`` per cent of a positive's score and that score. Both
orders are by score, the higher first, then by id.

How it is laid out. Anchors and rows are dealt into blocks of bounded bytes, by row number, so that
no key decides their size. Each pair of an anchor block and a row block is a task's group: it
multiplies in tiles, keeps the first few per anchor (or per anchor and positive), and a window
chooses among what the blocks give. Neither side is broadcast; the blocks grow with the number of
rows up to ``MOST_BYTES``, so that few copies of either side travel.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite
component take no part. Only vectors of equal length meet; empty ones have the score 0. A repeated
row counts again, as anchor, positive and negative, but a row with the anchor's id is neither its
positive nor its negative; ties of score and id come in any order. A positive with a negative score
has no negatives (the range is empty). Scores must fit into 60 bits: larger components raise an
error that says so. An empty table gives an empty one. Other columns do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexferry.storage import materialize

#: Components along which products of residues are summed in 32-bit floats, and the largest residue for that.
RUN = 64
LARGEST = math.isqrt((2**24 - 1) // RUN)
#: Rows of a tile, least rows and most bytes of a block.
TILE, LEAST_ROWS, MOST_BYTES = 2048, 2048, 32 << 20
#: Scores of this size and above are refused.
TOO_LARGE = 2**60

POSITIVES = "anchor long, anchor_id long, positive long, positive_id long, positive_score long"
NEGATIVES = POSITIVES + ", negative long, negative_id long, negative_score long"


def primes(bound: int) -> list[int]:
    """The largest odd primes with small residues whose product exceeds twice ``bound``."""
    found: list[int] = []
    p = 2 * LARGEST + 1
    while math.prod(found) <= 2 * bound + 1:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
        p -= 2
    return found


def signed(values: np.ndarray, p: int) -> np.ndarray:
    """Residues around zero."""
    rest = values % p
    return rest - p * (rest > p // 2)


def products(a: np.ndarray, b: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    digits: list[np.ndarray] = []
    score = np.zeros((len(a), len(b)), np.int64)
    weight = 1
    for p in moduli:
        left, right = signed(a, p).astype(np.float32), signed(b, p).astype(np.float32)
        total = np.zeros(score.shape, np.int64)
        for at in range(0, a.shape[1], RUN):
            total += (left[:, at : at + RUN] @ right[:, at : at + RUN].T).astype(np.int64)
        # The next digit in mixed radix: what the digits so far leave of this residue.
        known, place = np.zeros(score.shape, np.int64), 1
        for q, digit in zip(moduli, digits, strict=False):
            known += digit * place
            place = place * q % p
        digits.append(signed((total - known) % p * pow(place, -1, p), p))
        # Weights beyond 64 bits wrap around, and so does the sum, to the right score.
        with np.errstate(over="ignore"):
            score += digits[-1] * np.uint64(weight % 2**64).astype(np.int64)
        weight *= p
    return score


def _matrix(values: pa.ListArray, length: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(values), length)


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].combine_chunks().to_numpy(zero_copy_only=False)


def _tiles(rows: pa.Table) -> Iterator[tuple[pa.Table, int]]:
    """Rows of one length by id, in tiles."""
    lengths = _column(rows, "length")
    for length in np.unique(lengths):
        own = rows.filter(pa.array(lengths == length)).sort_by([("id", "ascending"), ("row", "ascending")])
        for at in range(0, len(own), TILE):
            yield own.slice(at, TILE), int(length)


def _sides(cell: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Anchors and rows of a cell."""
    anchor = cell["anchor"].combine_chunks()
    return cell.filter(anchor), cell.filter(pc.invert(anchor))


def _first(scores: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of each line's first allowed columns: by score, then as they stand."""
    ranked = np.where(allowed, -scores, np.iinfo(np.int64).max)
    order = np.argsort(ranked, axis=1, kind="stable")[:, :count]
    line = np.repeat(np.arange(len(scores)), order.shape[1])
    column = order.reshape(-1)
    good = allowed[line, column]
    return line[good], column[good]


def _positives(moduli: list[int], count: int):
    names = [x.split()[0] for x in POSITIVES.split(", ")]
    empty = pa.table([pa.array([], pa.int64())] * len(names), names)

    def run(cell: pa.Table) -> pa.Table:
        anchors, rows = _sides(cell)
        out = []
        for tile, length in _tiles(rows):
            labels = _column(tile, "label")
            for own, own_length in _tiles(anchors):
                if own_length != length:
                    continue
                own_labels = _column(own, "label")
                for label in np.intersect1d(labels, own_labels):
                    a, b = own.filter(pa.array(own_labels == label)), tile.filter(pa.array(labels == label))
                    scores = products(_matrix(a["values"].combine_chunks(), length), _matrix(b["values"].combine_chunks(), length), moduli)
                    line, column = _first(scores, _column(a, "id")[:, None] != _column(b, "id")[None], count)
                    found = [_column(a, "row")[line], _column(a, "id")[line], _column(b, "row")[column], _column(b, "id")[column], scores[line, column]]
                    out.append(pa.table([pa.array(x, pa.int64()) for x in found], names))
        return pa.concat_tables([empty, *out])

    return run


def _negatives(moduli: list[int], count: int, low: int):
    names = [x.split()[0] for x in NEGATIVES.split(", ")]
    empty = pa.table([pa.array([], pa.int64())] * len(names), names)

    def run(cell: pa.Table) -> pa.Table:
        anchors, rows = _sides(cell)
        out = []
        for tile, length in _tiles(rows):
            labels, ids, numbers = (_column(tile, c) for c in ("label", "id", "row"))
            b = _matrix(tile["values"].combine_chunks(), length)
            for own, own_length in _tiles(anchors):
                if own_length != length:
                    continue
                scores = products(_matrix(own["values"].combine_chunks(), length), b, moduli)
                other = (_column(own, "label")[:, None] != labels[None]) & (_column(own, "id")[:, None] != ids[None])
                given = own["positives"].combine_chunks()
                line = np.repeat(np.arange(len(own)), np.diff(given.offsets.to_numpy()))
                given = given.flatten()
                most = given.field("score").to_numpy(zero_copy_only=False)
                # Positives of one place in their anchor's list at a time: as many lines as anchors.
                place = np.arange(len(line)) - np.searchsorted(line, line)
                for k in range(int(place.max(initial=-1)) + 1):
                    at = np.flatnonzero(place == k)
                    part, top = scores[line[at]], most[at][:, None]
                    # low * positive <= 100 * negative, in whole numbers
                    least = -((-low * top) // 100)
                    i, column = _first(part, other[line[at]] & (part <= top) & (part >= least), count)
                    anchor = line[at][i]
                    found = [
                        _column(own, "row")[anchor], _column(own, "id")[anchor],
                        given.field("row").to_numpy(zero_copy_only=False)[at][i], given.field("id").to_numpy(zero_copy_only=False)[at][i], most[at][i],
                        numbers[column], ids[column], part[i, column],
                    ]
                    out.append(pa.table([pa.array(x, pa.int64()) for x in found], names))
        return pa.concat_tables([empty, *out])

    return run


def prepared(df: DataFrame, key: str, vector: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """(id, label, anchor, length, values) of the rows that take part, components as whole numbers."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    values = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("double"))
    rows = df.select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.size(x).alias("length"), values.alias("values"), good.alias("good"),
    )
    return rows.where("id is not null and label is not null and good").drop("good")


def hard_negatives(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", anchors: Column | None = None,
    scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` says which rows are anchors, in terms of the columns of ``df``; all if it is none.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = prepared(df, key, vector, label, F.lit(True) if anchors is None else anchors, scale)
    # The number of a row is frozen by writing it.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    largest = F.coalesce(F.array_max(F.transform("values", F.abs)), F.lit(0.0))
    size = rows.agg(
        F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(largest).alias("largest"), F.max("length").alias("length")
    ).first()
    bound = int(size.largest or 0) ** 2 * (size.length or 0)
    if bound >= TOO_LARGE:
        raise ValueError(f"scores up to {bound} do not fit into 60 bits: scale the vectors or lower scale={scale}")
    moduli = primes(bound)
    kind = "smallint" if (size.largest or 0) < 2**15 else "long"
    rows = rows.withColumn("values", F.col("values").cast(f"array<{kind}>"))

    most = max(LEAST_ROWS, MOST_BYTES // (8 * max(1, size.length or 0)))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    block = min(most, max(LEAST_ROWS, size.n // (4 * cores)))
    across, down = max(1, math.ceil(size.n / block)), max(1, math.ceil(size.anchors / most))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row_blocks = rows.withColumn("anchor", F.lit(False)).withColumn("across", dealt(across)).withColumn("down", every(down))

    def cells(anchor_rows: DataFrame):
        anchor_blocks = anchor_rows.withColumn("down", dealt(down)).withColumn("across", every(across))
        return anchor_blocks.unionByName(row_blocks, allowMissingColumns=True).groupBy("down", "across")

    anchor_rows = rows.where("anchor")
    found = cells(anchor_rows).applyInArrow(_positives(moduli, positives), POSITIVES)
    order = W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    # At most ``positives`` of them in a list.
    item = F.struct(F.col("positive").alias("row"), F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
    found = materialize(found.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(item).alias("positives")))
    found = cells(anchor_rows.join(found, "row")).applyInArrow(_negatives(moduli, negatives, low), NEGATIVES)
    order = W.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id", "negative")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
