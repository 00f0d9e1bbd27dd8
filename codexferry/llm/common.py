"""What several of these operators share: words, hashes, bounded slices, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexferry.storage import materialize

#: Bytes of text that a Python task works on at a time; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20

#: Separators of the words: space and the control characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"

ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has such a column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no slice has more than about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - 1) // limit
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:], strict=False):
            yield batch.slice(start, end - start)
        del batch
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker serves many stages, and what it keeps of one adds to the next."""
    pa.default_memory_pool().release_unused()
    # The C library's own way, where it has one.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-case A-Z and split at white space.

    Gives the number of words per text, the words' codes in order, and the distinct words that
    the codes point to. A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    parents = pc.list_parent_indices(lists).to_numpy()
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    encoded = flat.filter(full).dictionary_encode()
    parents = parents[full.to_numpy(zero_copy_only=False)]
    counts = np.bincount(parents, minlength=len(texts)).astype(np.int64)
    return counts, encoded.indices.to_numpy(), encoded.dictionary


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash per string, the same in every process: the sum of its runs of 8 bytes, each mixed with its place."""
    if not len(values):
        return np.empty(0, np.uint64)
    values = pa.concat_arrays([values]).cast(pa.large_binary())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    lengths = np.diff(offsets)
    out = mixed(lengths.astype(np.uint64) + ODD)
    full = np.flatnonzero(lengths)
    if len(full):
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        place = np.arange(len(raw), dtype=np.int64) - np.repeat(offsets[:-1] - offsets[0], lengths)
        runs = np.flatnonzero((place & 7) == 0)
        packed = np.add.reduceat(raw.astype(np.uint64) << ((place & 7) << 3).astype(np.uint64), runs)
        each = mixed(packed * ODD + (place[runs] >> 3).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        first = np.cumsum((lengths[full] + 7) >> 3) - ((lengths[full] + 7) >> 3)
        out[full] += np.add.reduceat(each, first)
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits (multiply and shift, wrapping)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as the first and the gaps, in as few whole bytes as the largest needs."""
    gaps = np.diff(values)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    narrow = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + values[:1].astype("<u8").tobytes() + narrow.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    """The values of ``pack_sorted``."""
    width = blob[0]
    narrow = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(narrow), 8), np.uint8)
    gaps[:, :width] = narrow
    return np.cumsum(np.concatenate([np.frombuffer(blob, "<u8", 1, 1), gaps.view("<u8").reshape(-1)]), dtype=np.uint64)


#: Keys up to which the key side of a semi-join is sent to all tasks (16 MB); more are shuffled.
BROADCAST_KEYS = 1_000_000


def semi_join(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key is (or, ``left_anti``, isn't) among ``keys``; wide rows stay where they are if the keys are few."""
    keys = materialize(keys.select(key))
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, how)


#: Links up to which the smallest neighbours of all nodes are sent to all tasks, not shuffled.
FEW_LINKS = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links, as (node, component).

    ``component`` is the smallest node reachable. Only nodes that have a link to another node
    appear, the smallest node of each component excepted. Large-star and small-star steps
    alternate until the set of links is a star per component; each round is written to the shared
    folder, so that lost executors repeat one round only. Null ends and loops count for nothing.
    Of few links a round is few tasks: the driver keeps a record of each task of a session.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = edges.where(F.col(a) != F.col(b)).select(u, v).distinct()
    links, sign = _written(links)
    while sign[0]:
        near = F.broadcast if sign[0] <= FEW_LINKS else lambda least: least
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(near(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(near(least), "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        links, now = _written(moved.select("e.u", "e.v").where("u != v").distinct())
        if now == sign:
            break
        sign = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    out = materialize(links)
    return out, tuple(out.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
