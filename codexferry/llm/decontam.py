"""Benchmark decontamination by spaced seeds; DataFrame functions only.

Texts and items are lower-cased (A-Z) and split at white space. A leak is a stretch of an item in
a text, word for word at the same places, of ``WINDOW`` words (a shorter item: all its words) in
which at most ``tolerance(length)`` words differ: two of thirteen.

Seeds find the places. A mask looks at some of the words in a span and ignores the others; texts
and items are hashed under each mask at each position and joined. The two masks are chosen such
that every way to place the tolerated substitutions leaves one mask position untouched
(``tolerance`` computes for which number that holds), so the seeds lose nothing. Items shorter
than the masks are looked for whole. Each hit names a diagonal (place in the text minus place in
the item), and the words along it are compared.

The seeds of the items are sent to all tasks if they are at most ``BROADCAST_SEEDS`` and are
joined by shuffle otherwise. Texts are exploded to positions within one stage and only hits go on.

Defined results: one row per (key, item) with the most equal words of a window. Rows of one key
are one document: a leak in any of them is a leak of the key. Null and empty texts and items have
no words and no leaks; repeated items are items of their own; a null key or item id is reported as
null. Only the named columns are read, so other columns do no harm.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexferry.llm.common import unused_name
from codexferry.storage import materialize

WINDOW = 13
#: Offsets of the words that each mask looks at, in a span of eight.
MASKS = ((0, 2, 5, 6, 7), (0, 3, 4, 5, 7))
SPAN = 8
BROADCAST_SEEDS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache(None)
def tolerance(length: int) -> int:
    """How many substitutions in a window of ``length`` words the masks are sure to survive."""
    if length < SPAN:
        return 0
    for count in range(1, length):
        for changed in map(set, combinations(range(length), count)):
            if not any(changed.isdisjoint(at + o for o in mask) for mask in MASKS for at in range(length - SPAN + 1)):
                return count - 1
    return 0


def words(text: str) -> Column:
    """Lower-case words; one empty word for a text without any."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.split(F.btrim(lower, F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")


def _windows(df: DataFrame, span: int) -> DataFrame:
    """A row per position, with ``span`` words from there as fields of ``z``."""
    size = F.greatest(F.size("w") - span + 1, F.lit(0))
    shifted = [F.slice("w", i + 1, size).alias(f"w{i}") for i in range(span)]
    rest = [c for c in df.columns if c != "w"]
    return df.where(F.size("w") >= span).select(*rest, F.posexplode(F.arrays_zip(*shifted)).alias("at", "z"))


def _seeds(df: DataFrame, lengths: list[int]) -> DataFrame:
    """(..., at, seed): the hash under each mask, and of whole runs of the short lengths."""
    rest = [c for c in df.columns if c != "w"]
    own = lambda k, offsets: F.xxhash64(F.lit(k), *(F.col(f"z.w{o}") for o in offsets))
    both = F.array(*(own(-i - 1, mask) for i, mask in enumerate(MASKS)))
    out = _windows(df, SPAN).select(*rest, "at", F.explode(both).alias("seed"))
    for n in lengths:
        out = out.unionByName(_windows(df, n).select(*rest, "at", own(n, range(n)).alias("seed")))
    return out


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item, equal, window) of each item that leaks into a document."""
    tests = items.select(F.col(item).alias("item"), words(item_text).alias("w")).where("w[0] != ''")
    tests = materialize(tests)
    lengths = [r[0] for r in tests.where(F.size("w") < SPAN).select(F.size("w")).distinct().collect()]
    long_ones = _seeds(tests.where(F.size("w") >= SPAN), [])
    short_ones = [_windows(tests.where(F.size("w") == n), n).select("item", "at", F.xxhash64(F.lit(n), *(F.col(f"z.w{o}") for o in range(n))).alias("seed")) for n in lengths]
    for more in short_ones:
        long_ones = long_ones.unionByName(more)
    seeds = materialize(long_ones.distinct())
    few = seeds.count() <= BROADCAST_SEEDS
    rows = docs.select(F.col(key).alias("key"), words(text).alias("w"))
    hits = _seeds(rows, lengths).withColumnRenamed("at", "place").join(F.broadcast(seeds) if few else seeds, "seed")
    hits = materialize(hits.select("key", "item", (F.col("place") - F.col("at")).alias("shift")).distinct())

    keys = hits.select("key").distinct()
    keys = materialize(keys)
    few = keys.count() <= BROADCAST_SEEDS
    # The words of each hit document meet its hits: texts without a hit go no further.
    right = (F.broadcast(keys) if few else keys).alias("k")
    texts = rows.alias("r").join(right, F.col("r.key").eqNullSafe(F.col("k.key")), "left_semi").withColumnRenamed("key", "own")
    met = hits.join(texts, F.col("key").eqNullSafe(F.col("own")))
    met = met.join(tests.select(F.col("item").alias("t"), F.col("w").alias("iw")), F.col("item").eqNullSafe(F.col("t")))
    n = F.size("iw")
    length = F.least(n, F.lit(WINDOW))
    there = lambda i: F.coalesce(F.get("w", i + F.col("shift")) == F.get("iw", i), F.lit(False)).cast("int")
    met = met.withColumn("same", F.transform(F.sequence(F.lit(0), n - 1), there)).withColumn("window", length)
    sums = F.transform(
        F.sequence(F.lit(1), n - F.col("window") + 1),
        lambda j: F.aggregate(F.slice("same", j, F.col("window")), F.lit(0), lambda a, x: a + x),
    )
    met = met.select("key", "item", "window", F.array_max(sums).alias("equal"))
    allowed = F.element_at(F.array(*(F.lit(tolerance(i)) for i in range(1, WINDOW + 1))), F.col("window"))
    found = met.where(F.col("equal") >= F.col("window") - allowed)
    found = found.groupBy("key", "item", "window").agg(F.max("equal").alias("equal"))
    return found.select(F.col("key").alias(key), F.col("item").alias(item), "equal", "window")


def clean(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of documents without a leak."""
    leaking = unused_name(docs, "leaking")
    bad = materialize(found.select(F.col(key).alias(leaking)).distinct())
    few = bad.count() <= BROADCAST_SEEDS
    return docs.join(F.broadcast(bad) if few else bad, F.col(key).eqNullSafe(F.col(leaking)), "left_anti")
