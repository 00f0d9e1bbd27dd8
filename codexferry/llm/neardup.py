"""Near-duplicate documents: SetSketch registers, bands, joint likelihood, exact check.

A text's set is its distinct shingles of ``width`` words (fewer words: the whole sequence as one).
Equal sets are one class, known by a 128-bit digest, so a group of copies costs one row from here
on. Each class has ``BANDS * ROWS`` SetSketch registers: register i is
``floor(1 - log_b(min over the set of x_i))``, cut to 0..q+1, for x_i exponentially distributed;
registers of a union are the greater ones, so sketches merge. Bands of registers propose pairs:

1. In each bucket every class is compared with one pivot; what links forms components. Only
   buckets that still hold several components go on.
2. Of each class left, the shingles that some other class left has too are counted. A link needs
   ``percent / (100 + percent)`` of both sizes in common, so a class without so many, whatever
   partner its buckets hold, is out: a bound, not a guess. In a large group of variants of one text
   this drops the variants that changed too much to link with any other, without pairing them.
3. The class that shares most is the next pivot. Then buckets that hold several components even
   now compare the classes of different components, block by block; a bitmap of each set bounds
   what two of them can have in common, and only likely pairs come out. After that every pair of a
   bucket is in one component, has been compared, or is ruled out by its sizes, by step 2 or by
   the bitmaps.

A proposed pair first passes sizes (their ratio bounds the similarity) and the likelihood of its
register comparison: similarity is estimated from the number of registers that are greater,
smaller and equal, given both exact sizes, and the pair goes on if the estimate is not far below
the threshold (``SLACK``, over four standard errors). Both full sets then decide:
``100 * common >= percent * union``. With similarity s, a pair is missed with probability
(1 - s^ROWS)^BANDS, 3e-6 at 0.8; a component with several links is missed less.

Defined results: texts without words, empty or null, have no set, link with nothing and form
their own component. Rows with one doc_id share nothing by that alone; each row has its text's
component. A null doc_id is never a smallest one: its component is null if nothing else is in it,
and it is not kept. Only the key and the text are read, so other columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexferry.llm.common import BROADCAST_KEYS, components, hash_strings, mixed, semi_join, slices, split_words
from codexferry.storage import materialize

BANDS, ROWS = 32, 5
BASE, TOP = 1.02, 2**16 - 2  # b and q + 1 of the sketch
SLACK = 0.15
BLOCK = 2000
BITS = 2048

_DRAW = np.random.default_rng(20_011)
_ODD = _DRAW.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _DRAW.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    counts, codes, words = split_words(texts)
    hashes = mixed(hash_strings(words))[codes] if len(words) else np.empty(0, np.uint64)
    factors = [np.uint64(pow(0x9E3779B97F4A7C15, i, 2**64)) for i in range(width)]
    ends = np.cumsum(counts)
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        rolled = mixed(sum(hashes[i : i + n] * f for i, f in enumerate(factors)))
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= width:
            yield np.unique(rolled[end - count : end - width + 1])
        elif count:
            whole = (hashes[end - count : end] * np.array(factors[:count])).sum(keepdims=True)
            yield mixed(whole + np.uint64(count))
        else:
            yield np.empty(0, np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 1024):
        x = hashes[None, start : start + 1024] * _ODD[:, None]
        x += _ADD[:, None]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=1), out=least)
    spaced = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2**-53))
    return np.clip(np.floor(1 - np.log(spaced) / np.log(BASE)), 0, TOP).astype(np.uint16)


def bitmap(hashes: np.ndarray) -> bytes:
    """A set as ``BITS`` bits; bits that another set lacks witness as many elements that it lacks."""
    bits = np.zeros(BITS, bool)
    bits[(hashes >> np.uint64(20)) % np.uint64(BITS)] = True
    return np.packbits(bits).tobytes()


def merge_registers(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum.reduce(sketches)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The most likely similarity of each row's two sketches, on a grid of 0.01.

    With u = size_a / (size_a + size_b), a register of a is greater with probability
    p(u - v s) and smaller with p(v - u s), p(x) = -log_b(1 - x (b - 1) / b).
    """
    greater, smaller = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (size_a / (size_a + size_b))[:, None]
    grid = np.linspace(0, 1, 101)[None, :]
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - (1 - u) * grid), p((1 - u) - u * grid)
    same = np.maximum(1 - up - down, 1e-12)
    fit = greater * np.log(up) + smaller * np.log(down) + (a.shape[1] - greater - smaller) * np.log(same)
    fit[(grid > np.minimum(u / (1 - u), (1 - u) / u) + 1e-9)] = -np.inf
    return grid[0][fit.argmax(axis=1)]


def sketch(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n_shingles, class digest, registers) per row; no digest without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = list(shingle_sets(batch[text], width))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            known: dict = {}
            for name, s in zip(names, sets, strict=True):
                if name is not None and name not in known:
                    known[name] = registers(s).tobytes(), bitmap(s)
            found = [known.get(n, (None, None)) for n in names]
            regs, bits = (pa.array([f[i] for f in found], pa.binary()) for i in range(2))
            yield pa.RecordBatch.from_arrays([batch[key], sizes, pa.array(names, pa.binary()), regs, bits], fields)

    fields = ["doc_id", "n_shingles", "class", "regs", "bits"]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, n_shingles long, class binary, regs binary, bits binary")


def _buckets(regs: list[bytes]) -> np.ndarray:
    """The bucket of each band of each sketch."""
    bands = np.frombuffer(b"".join(regs), np.uint16).reshape(len(regs), BANDS, ROWS)
    return mixed((bands.astype(np.uint64) * _ODD[:ROWS]).sum(axis=2) + _ADD[:BANDS]).view(np.int64)


def _bands(classes: DataFrame) -> DataFrame:
    """(bucket, class) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = _buckets(batch["regs"].to_pylist())
            own = batch["class"].take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            bucket = pa.array(sums.reshape(-1))
            yield pa.RecordBatch.from_arrays([bucket, own], ["bucket", "class"])

    return classes.select("class", "regs").mapInArrow(run, "bucket long, class binary")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and registers allow the similarity."""
    side = lambda x: classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [
                np.frombuffer(b"".join(batch[f"regs_{x}"].to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                for x in "ab"
            ]
            sizes = [batch[f"n_{x}"].to_numpy().astype(float) for x in "ab"]
            found = np.concatenate(
                [estimate(*(r[i : i + 2000] for r in regs), *(s[i : i + 2000] for s in sizes)) for i in range(0, batch.num_rows, 2000)]
            )
            yield batch.select(["a", "b"]).filter(pa.array(found >= percent / 100 - SLACK))

    return sized.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(class, hashes) of the wanted (head, class) rows, from their texts.

    A class without a key is looked for among the rows without one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = list(shingle_sets(batch[text], width))
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            cuts = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            hashes = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), hashes], ["class", "hashes"])

    texts = docs.select(F.col(key).alias("head"), text)
    rows = semi_join(texts, wanted.where("head is not null").select("head").distinct(), "head")
    if not wanted.where("head is null").isEmpty():
        rows = rows.unionByName(texts.where("head is null"))
    found = rows.select(text).mapInArrow(run, "class binary, hashes array<long>")
    # A repeated key brings several texts; only the wanted class counts, once.
    return found.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar."""
    side = lambda x: sets.select(F.col("class").alias(x), F.col("hashes").alias(f"set_{x}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", common)
    union = F.size("set_a") + F.size("set_b") - F.col("common")
    return both.where(F.col("common") * 100 >= union * percent).select("a", "b")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _star(left: DataFrame, order: Column) -> DataFrame:
    """Each bucket's classes paired with its first one in the given order."""
    pivot = F.min_by(F.struct("class", "part"), F.struct(order, "class"))
    star = left.groupBy("bucket").agg(pivot.alias("pivot"))
    pairs = left.join(star, "bucket").where("part != pivot.part and class != pivot.class")
    return pairs.select(*_ordered("class", "pivot.class")).distinct()


def _across(left: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in one bucket but not in one component that sizes, shared shingles and registers allow.

    A bucket of more than ``BLOCK`` classes has a task for each pair of its blocks; only the pairs
    that pass leave a task.
    """
    counts = left.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks").cast("long")).cast("int").alias("side")
    rows = left.join(counts, "bucket").select("bucket", "class", "part", "n", "shared", "blocks", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("bucket", "class", "part", "n", "shared", "side", other)
    rows = rows.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other")
    rows = rows.join(classes.select("class", "regs", "bits"), "class")

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        here, left, right = (k.as_py() for k in key)
        names, side = rows["class"].to_pylist(), rows["side"].to_numpy()
        parts = np.unique(np.array(rows["part"].to_pylist(), object), return_inverse=True)[1]
        n, shared = rows["n"].to_numpy().astype(float), rows["shared"].to_numpy().astype(float)
        regs = np.frombuffer(b"".join(rows["regs"].to_pylist()), np.uint16).reshape(len(names), -1)
        buckets = _buckets(rows["regs"].to_pylist())
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(names), -1)
        # Members of the largest component meet the others only.
        largest = np.bincount(parts).argmax()
        found = set()
        for x in np.flatnonzero(parts != largest):
            y = np.flatnonzero((parts != parts[x]) & ((side != side[x]) | (left == right)))
            y = y[np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent]
            y = y[np.minimum(shared[x], shared[y]) * (100 + percent) >= (n[x] + n[y]) * percent]
            # A pair counts in the first bucket that it shares.
            common = buckets[y] == buckets[x]
            y = y[buckets[x][common.argmax(axis=1)] == here]
            # No more can be in common than one set has less what the other surely lacks.
            lacks = np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1)
            more = np.bitwise_count(bits[y] & ~bits[x]).sum(axis=1)
            most = np.minimum(n[x] - lacks, n[y] - more)
            y = y[most * (100 + percent) >= (n[x] + n[y]) * percent]
            # Half of the registers alike is far less than the likelihood below asks for.
            y = y[(regs[y] == regs[x]).mean(axis=1) >= 0.5]
            if len(y):
                own = np.broadcast_to(regs[x], (len(y), regs.shape[1]))
                y = y[estimate(own, regs[y], np.full(len(y), n[x]), n[y]) >= percent / 100 - SLACK]
                found.update((min(names[x], names[i]), max(names[x], names[i])) for i in y)
        columns = zip(*sorted(found), strict=True) if found else ([], [])
        return pa.table([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary").distinct()


def _unsettled(left: DataFrame, parts: DataFrame) -> DataFrame:
    """The buckets in which several components are left, with each class's component as ``part``."""
    named = left.drop("part").join(parts.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("part", F.coalesce("component", "class")).drop("component")
    several = named.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q")
    return named.join(several.select("bucket"), "bucket")


def _shared_shingles(sets: DataFrame, left: DataFrame) -> DataFrame:
    """(class, shared): how many of a class's shingles another class left has as well."""
    own = sets.join(left.select("class").distinct(), "class", "left_semi")
    alone = own.select("class", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("class").alias("class"))
    alone = alone.where("c = 1").groupBy("class").agg(F.count("*").alias("alone"))
    return own.select("class", F.size("hashes").alias("all")).join(alone, "class", "left").select("class", (F.col("all") - F.coalesce("alone", F.lit(0))).alias("shared"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class, part) per row of ``docs``.

    ``class`` is the digest of the text's set and ``part`` that of its component, null without words.
    """
    rows = materialize(sketch(docs, key, text, width))
    full = rows.where("class is not null")
    heads = full.groupBy("class").agg(F.min("doc_id").alias("head"), F.min("n_shingles").alias("n"))
    classes = materialize(heads.join(full.select("class", "regs", "bits").dropDuplicates(["class"]), "class"))
    bands = materialize(_bands(classes))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    left = bands.join(shared, "bucket").withColumn("part", F.col("class"))
    left = materialize(left.join(classes.select("class", "n"), "class"))
    wanted = materialize(classes.select("class", "head").join(left.select("class").distinct(), "class", "left_semi"))
    sets = materialize(_sets(docs, wanted, key, text, width))

    def compared(pairs: DataFrame, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(pairs tried so far, those of these pairs that link)."""
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        likely = materialize(_likely(pairs, classes, percent))
        return likely if tried is None else tried.unionByName(likely), materialize(_verified(likely, sets, percent))

    tried, links = compared(_star(left, F.xxhash64("class")), None)
    parts = components(links)
    left = materialize(_unsettled(left, parts))
    left = materialize(left.join(_shared_shingles(sets, left), "class"))
    smallest = left.groupBy("bucket").agg(F.min("n").alias("least_n"))
    needed = (F.col("n") + F.greatest(F.col("n") * percent / 100, F.col("least_n"))) * percent
    left = left.join(smallest, "bucket").where(F.col("shared") * (100 + percent) >= needed).drop("least_n")
    left = materialize(_unsettled(left, parts))

    tried, found = compared(_star(left, -F.col("shared") / F.col("n")), tried)
    links = links.unionByName(found)
    parts = components(links)
    left = materialize(_unsettled(left, parts))

    _, found = compared(_across(left, classes, percent), tried)
    parts = components(links.unionByName(found))

    parts = classes.select("class", "head").join(parts.withColumnRenamed("node", "class"), "class", "left")
    parts = parts.select("class", "head", F.coalesce("component", "class").alias("part"))
    least = parts.groupBy("part").agg(F.min("head").alias("component_id"))
    parts = parts.join(least, "part").select("class", "component_id", "part")
    out = rows.select("doc_id", "n_shingles", "class").join(parts, "class", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "class", "part")


def _classed(rows: DataFrame, width: int) -> DataFrame:
    """Rows (key, text, row) with their class digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch["text"], width)
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["row"], pa.array(names, pa.binary())], ["key", "row", "class"])

    schema = T.StructType([rows.schema["key"], rows.schema["row"], T.StructField("class", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def deduplicated(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near-duplicates.

    The row with the smallest key of a group stays; of several with that key, or if the group has
    no key, one of the smallest class. Rows whose text has no words stay.
    """
    found = materialize(near_duplicates(docs, key, text, width, percent))
    # Rows are told apart by key. Null and repeated keys can't be: they are few, and are grouped by text.
    odd = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("odd"))
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("odd")).unionByName(odd).distinct()
    odd, gone = materialize(odd), materialize(gone)
    match = F.col("key").eqNullSafe(F.col("odd"))
    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_KEYS else x
    # A row travels as one value: its columns may have any names.
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    plain = rows.join(small(gone), match, "left_anti")
    rest = _classed(rows.join(small(odd), match, "left_semi"), width)
    groups = found.where("class is not null").select("class", "part", "component_id").distinct()
    rest = rest.join(groups, "class", "left").where(F.col("class").isNull() | F.col("key").eqNullSafe(F.col("component_id")))
    first = F.row_number().over(Window.partitionBy("part").orderBy("class"))
    once = rest.where("class is not null").withColumn("first", first).where("first = 1")
    return plain.select("row.*").unionByName(once.select("row.*")).unionByName(rest.where("class is null").select("row.*"))
