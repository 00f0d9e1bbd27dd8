"""Near-duplicate vectors by spherical caps with random product codes.

Every filter is a direction; a vector belongs to the filters with which its cosine reaches a
threshold (it lies in their caps). Directions are a product code: a vector is cut into two parts,
each part has a codebook of random unit vectors, and a direction is any pair of codewords. So
``k`` codewords a part give k^2 filters, and a vector's list of filters is decoded without looking
at all of them: only codewords of the first part whose product, with the best of the second, can
reach the threshold are paired.

Threshold and number of filters follow from the number of vectors: a filter holds about ``LOAD``
unrelated vectors, and two vectors with the least linked cosine share ``SHARED`` filters on the
average, so the chance to share none is about exp(-SHARED). Where a vector is in fewer than
``LEAST`` caps, its threshold falls until it is in so many. A test measures the recall.

Vectors with equal components are one class with a size. The members of a filter are compared in
blocks of ``BLOCK``; a filter with more has a task for each pair of its blocks, so that a hot
filter is many tasks. A task gives sums and its local components, never pairs: per class how many
vectors it links to (a pair counts in the smallest filter that both share) and the smallest class
it reaches. Cosines are exact and in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing: no links, their own component. Vectors of different lengths never link. Every row
counts as a vector of its own, also if its id is repeated. Null ids are never the smallest of a
component; a component without ids has a null one and nothing kept. Other columns do no harm.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexferry.llm.common import components
from codexferry.storage import materialize

LOAD, SHARED, LEAST, BLOCK = 200, 16, 24, 1000


def plan(vectors: int, cosine: float) -> tuple[int, float]:
    """Codewords per part, and the threshold in standard deviations of a random cosine."""
    share = min(0.05, LOAD / max(1, vectors))
    normal = NormalDist()
    z = normal.inv_cdf(1 - share)
    # The chance that a vector at this cosine is in a cap, given that the other one is.
    v = np.linspace(z, z + 8, 4001)
    density = np.exp(-v * v / 2)
    inside = np.array([1 - normal.cdf((z - cosine * x) / math.sqrt(1 - cosine * cosine)) for x in v])
    both = float((density * inside).sum() / density.sum())
    return max(4, math.ceil(math.sqrt(SHARED / both / share))), z


@lru_cache(maxsize=8)
def codebooks(length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two codebooks of k random unit vectors, for the halves of a vector."""
    draw = np.random.default_rng([length, k, 77])
    books = [draw.standard_normal((k, n)) for n in (length // 2, length - length // 2) ]
    return tuple(b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300) for b in books)


def decode(vectors: np.ndarray, k: int, z: float) -> list[np.ndarray]:
    """The sorted filters of each unit vector."""
    length = vectors.shape[1]
    first, second = codebooks(length, k)
    a, b = vectors[:, : length // 2] @ first.T, vectors[:, length // 2 :] @ second.T
    # Codeword pairs are directions of length sqrt(2); vectors of length one are short in few dimensions.
    least = min(z / math.sqrt(length), 0.95) * math.sqrt(2)
    row, i = np.nonzero(a + b.max(axis=1, keepdims=True) >= least)
    out = [[] for _ in range(len(vectors))]
    for start in range(0, len(row), 4096):
        r, c = row[start : start + 4096], i[start : start + 4096]
        n, j = np.nonzero(a[r, c][:, None] + b[r] >= least)
        for x, f in zip(r[n].tolist(), (c[n] * k + j).tolist(), strict=True):
            out[x].append(f)
    best = min(LEAST, k)
    for x in [x for x, f in enumerate(out) if len(f) < LEAST]:
        # The best sums of a pair are among the best of either part.
        i, j = np.argsort(-a[x], kind="stable")[:best], np.argsort(-b[x], kind="stable")[:best]
        sums = (a[x][i][:, None] + b[x][j]).reshape(-1)
        top = np.argsort(-sums, kind="stable")[:LEAST]
        out[x] = (i[top // best] * k + j[top % best]).tolist()
    return [np.array(sorted(f), np.int64) for f in out]


def _classes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, class, values): class and values are null for vectors that link with nothing."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, kept = [], []
            for x in batch["v"]:
                x = None if x.as_py() is None else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                good = x is not None and len(x) > 0 and np.isfinite(x).all() and np.abs(x).max() > 0
                raw = x.tobytes() if good else None
                kept.append(raw)
                names.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(names, pa.binary()), pa.array(kept, pa.binary())], ["vec_id", "class", "values"])

    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"vec_id {kind}, class binary, values binary")


def _unit(values: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(values)).reshape(len(values), -1)
    # Scaled first: squares of very large or small components stay in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(classes: DataFrame, k: int, z: float) -> DataFrame:
    """(class, length, filters) of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch["values"].to_pylist()
            lengths = np.array([len(v) for v in values], np.int64)
            found: list = [None] * len(values)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                for start in range(0, len(at), 512):
                    part = at[start : start + 512]
                    for i, f in zip(part, decode(_unit([values[x] for x in part]), k, z), strict=True):
                        found[i] = f
            cuts = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch["class"], pa.array(lengths), lists], ["class", "length", "filters"])

    return classes.select("class", "values").mapInArrow(run, "class binary, length long, filters array<long>")


def _compared(cosine: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        own, left, right = key[0].as_py(), key[2].as_py(), key[3].as_py()
        rows = rows.sort_by("class")
        side = rows["side"].to_numpy()
        a, b = np.flatnonzero(side == left), np.flatnonzero(side == right)
        x = _unit(rows["values"].to_pylist())
        close = x[a] @ x[b].T >= cosine
        if left == right:
            np.fill_diagonal(close, False)
        i, j = np.nonzero(close)
        hit = np.unique(np.concatenate([a[i], b[j]]))
        if not len(hit):
            return EMPTY
        # A pair counts where its smallest shared filter is.
        lists = rows["filters"]
        owner = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy())
        values = pc.list_flatten(lists).to_numpy()
        smaller = values < own
        _, column = np.unique(values[smaller], return_inverse=True)
        members = np.zeros((len(rows), int(column.max(initial=-1)) + 1), np.float32)
        members[owner[smaller], column] = 1
        first = close & (members[a] @ members[b].T == 0)
        sizes = rows["size"].to_numpy().astype(np.int64)
        links = np.zeros(len(rows), np.int64)
        links[a] += first @ sizes[b]
        if left != right:
            links[b] += first.T @ sizes[a]
        root = np.arange(len(rows))
        p, q = a[i], b[j]
        while True:
            before = root.copy()
            np.minimum.at(root, p, root[q])
            np.minimum.at(root, q, root[p])
            root = root[root]
            if (root == before).all():
                break
        return pa.table([rows["class"].take(pa.array(hit)), pa.array(links[hit]), rows["class"].take(pa.array(root[hit]))], EMPTY.schema)

    return run


EMPTY = pa.table([pa.array([], pa.binary()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["class", "links", "root"])


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``df``."""
    rows = _classes(df, key, vector)
    rows = materialize(rows)
    full = rows.where("class is not null")
    classes = full.groupBy("class").agg(F.count("*").alias("size"), F.min("vec_id").alias("head"), F.first("values").alias("values"))
    classes = materialize(classes)
    k, z = plan(classes.count(), cosine)
    filters = materialize(_filters(classes, k, z))

    members = filters.select("class", "length", F.explode("filters").alias("filter"))
    counts = members.groupBy("length", "filter").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"))
    members = members.join(counts.where("n > 1"), ["length", "filter"])
    own = F.pmod(F.xxhash64("class"), F.col("blocks").cast("long")).cast("int")
    members = members.withColumn("side", own)
    # A block meets itself and every other block of its filter.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    members = members.select("class", "length", "filter", "side", other)
    members = members.select("class", "length", "filter", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    wide = members.join(classes.select("class", "size", "values"), "class").join(filters.select("class", "filters"), "class")
    found = wide.groupBy("filter", "length", "i", "j").applyInArrow(_compared(cosine), "class binary, links long, root binary")
    found = materialize(found)

    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select("class", "size", "head").join(links, "class", "left").join(parts.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("part", F.coalesce("component", "class"))
    least = named.groupBy("part").agg(F.min("head").alias("component_id"))
    n_links = (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    named = named.join(least, "part").select("class", n_links, "component_id")
    out = rows.select("vec_id", "class").join(named, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False))
    return out.select(F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), kept.alias("kept"))
