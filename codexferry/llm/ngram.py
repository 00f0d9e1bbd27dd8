"""Language-model scores by deleted interpolation.

A token's probability is a mixture of the maximum-likelihood estimates of all orders up to
``order`` and of the uniform distribution over the V training types and one unknown type. The
weights depend on how often the token's context was seen: the longest context with a count, by
powers of two. They are learned by expectation-maximisation on held-out counts: a tenth of the
training texts is kept apart, the weights are fitted to it under counts of the other nine tenths,
and the scores then use the counts of all training texts.

How it is laid out. Texts are put into packs of about ``PACK`` bytes, written once. Each pack asks
for its distinct n-grams (64-bit hashes, sorted, cut by range into buckets) and sends its own
counts along; a bucket adds up all packs' counts and answers each pack in the same order. So an
n-gram crosses the network once per pack and not once per occurrence, a frequent one is no larger
than a rare one, and nothing is gathered whole anywhere: the number of packs and of buckets grows
with the text. The held-out tokens reach the driver as counts of cells (context class, quarter
octave of each estimate's ratio to the uniform one), whose number does not depend on the input.

Defined results: null texts are empty, and every text ends with one end token, so an empty text
has one token. A null key counts as the empty string where keys are hashed. Each row is scored for
itself; repeated rows count again. Without training texts N and V are 0 and the uniform
distribution is left. Only the named columns are read, so other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexferry.llm.common import ODD, hash_strings, mixed, pack_sorted, slices, split_words, unpack_sorted
from codexferry.storage import materialize

PACK = 4 << 20
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: EM: rounds, cells per octave, tokens that the weights over all contexts count for in a context.
ROUNDS, CELLS, PRIOR = 40, 4, 10.0
FLOOR = 1e-4


def packed(docs: DataFrame) -> DataFrame:
    """(pack, dev, size, texts, blob): texts of one task together, the held-out ones apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        waiting = {True: ([], 0), False: ([], 0)}

        def emit(dev: bool) -> pa.RecordBatch:
            parts, size = waiting[dev]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(parts).combine_chunks())
            waiting[dev] = ([], 0)
            texts = sum(pc.sum(p["train"]).as_py() or 0 for p in parts)
            row = [(task << 32) + number, dev, size, texts, sink.getvalue().to_pybytes()]
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array([v], k) for v, k in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["pack", "dev", "size", "texts", "blob"])

        for batch in slices(batches, "text", PACK):
            for dev in (True, False):
                own = batch.filter(batch["dev"] if dev else pc.invert(batch["dev"]))
                if not own.num_rows:
                    continue
                parts, size = waiting[dev]
                waiting[dev] = ([*parts, own], size + own["text"].nbytes)
                if waiting[dev][1] >= PACK:
                    yield emit(dev)
                    number += 1
        for dev in (True, False):
            if waiting[dev][0]:
                yield emit(dev)
                number += 1

    return docs.mapInArrow(run, "pack long, dev boolean, size long, texts long, blob binary")


class Tokens:
    """A pack's texts as hashed n-grams, the same each time it is read."""

    def __init__(self, blob, order: int):
        self.rows = pa.ipc.open_stream(blob).read_all().combine_chunks()
        texts = self.rows["text"].combine_chunks() if self.rows.num_rows else pa.array([], pa.string())
        counts, codes, words = split_words(texts)
        self.lengths = counts + 1
        ends = np.cumsum(self.lengths)
        self.first = ends - self.lengths
        tokens = np.full(int(ends[-1]), END)
        inner = np.ones(len(tokens), bool)
        inner[ends - 1] = False
        tokens[inner] = mixed(hash_strings(words))[codes] if len(words) else tokens[inner]
        self.row_of = np.repeat(np.arange(len(counts)), self.lengths)
        self.distinct, self.place = [], []
        key, back = tokens.copy(), tokens
        for level in range(1, order + 1):
            if level > 1:
                back = np.concatenate([[START], back[:-1]])
                back[self.first] = START
                key = key + back * np.uint64(pow(int(ODD), level, 2**64))
            distinct, place = np.unique(mixed(key), return_inverse=True)
            self.distinct.append(distinct)
            self.place.append(place)

    def previous(self, values: np.ndarray, at_start: float) -> np.ndarray:
        """Each token's value of the token before; ``at_start`` at a text's first token."""
        out = np.concatenate([[at_start], values[:-1]])
        out[self.first] = at_start
        return out


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count; 255 stands for the next of the large ones at the end."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return len(counts).to_bytes(8, "little") + small.tobytes() + counts[small == 255].astype("<i8").tobytes()


def _unpack_counts(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    counts = np.frombuffer(blob, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<i8", offset=8 + n)
    return counts


def asked(packs: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, pack, level, dev, keys, counts): what each pack asks for and adds."""
    bounds = np.array([(2**64 * i + buckets - 1) // buckets for i in range(1, buckets)], dtype=np.uint64)
    names = ["bucket", "pack", "level", "dev", "keys", "counts"]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Tokens(batch["blob"][i].as_buffer(), order)
                train = own.rows["train"].to_numpy().astype(float)[own.row_of]
                for level, (keys, place) in enumerate(zip(own.distinct, own.place, strict=True), 1):
                    counts = np.bincount(place, weights=train, minlength=len(keys)).astype(np.int64)
                    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                    found = [
                        (k, batch["pack"][i].as_py(), level, batch["dev"][i].as_py(), pack_sorted(keys[a:b]), _pack_counts(counts[a:b]))
                        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
                        if b > a
                    ]
                    arrays = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return packs.select("pack", "dev", "blob").mapInArrow(
        run, "bucket int, pack long, level int, dev boolean, keys binary, counts binary"
    )


ANSWER = "pack long, level int, bucket int, total binary, kept binary, types long, tokens long, dev_tokens long"


def _answer(requests: pa.Table) -> pa.Table:
    """Counts over all packs for each pack's keys; with pack -1 the bucket's types and tokens."""
    out = []
    for level in sorted(set(requests["level"].to_pylist())):
        rows = requests.filter(pc.equal(requests["level"], level)).to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in rows]
        counts = [_unpack_counts(r["counts"]) for r in rows]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
        dev = np.bincount(place, weights=np.concatenate([c * r["dev"] for c, r in zip(counts, rows, strict=True)])).astype(np.int64)
        cuts = np.cumsum([0, *map(len, keys)])
        for r, a, b in zip(rows, cuts, cuts[1:], strict=False):
            mine = place[a:b]
            kept = _pack_counts((total - dev)[mine]) if r["dev"] else None
            out.append((r["pack"], level, r["bucket"], _pack_counts(total[mine]), kept, 0, 0, 0))
        out.append((-1, level, rows[0]["bucket"], None, None, int((total > 0).sum()), int(total.sum()), int(dev.sum())))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*out, strict=True)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in ANSWER.split(", ")])


def _levels(own: Tokens, answers: pa.Table, column: str) -> list[np.ndarray]:
    """Each token's count at each level."""
    found = []
    for level, place in enumerate(own.place, 1):
        rows = answers.filter(pc.equal(answers["level"], level)).sort_by("bucket")
        counts = np.concatenate([_unpack_counts(x.as_py()) for x in rows[column]])
        found.append(counts[place].astype(float))
    return found


def _estimates(own: Tokens, counts: list[np.ndarray], tokens: float, texts: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Maximum-likelihood estimates from order 1 up, and the class of each token's context."""
    estimates = [counts[0] / tokens if tokens else np.zeros(len(counts[0]))]
    classes = np.zeros(len(counts[0]), np.int64)
    for level in range(1, len(counts)):
        context = own.previous(counts[level - 1], texts)
        estimates.append(np.divide(counts[level], context, out=np.zeros(len(context)), where=context > 0))
        octave = np.frexp(context)[1]
        classes = np.where(context > 0, 64 * level + np.minimum(octave, 63), classes)
    return estimates, classes


def _cells(estimates: list[np.ndarray], classes: np.ndarray, types: int) -> tuple[np.ndarray, np.ndarray]:
    uniform = 1.0 / (types + 1)
    columns = [classes]
    for p in estimates:
        with np.errstate(divide="ignore"):
            octaves = np.round(CELLS * np.log2(p / uniform))
        columns.append(np.where(p > 0, octaves, -9999).astype(np.int64))
    return np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)


def fit_weights(cells: np.ndarray, counts: np.ndarray, order: int) -> dict[int, np.ndarray]:
    """Weights of the uniform distribution and of each order, per class of contexts; -1: any other."""

    def em(ratios: np.ndarray, n: np.ndarray, start: np.ndarray, prior: float) -> np.ndarray:
        weights = start
        for _ in range(ROUNDS):
            shares = ratios * weights
            shares /= shares.sum(axis=1, keepdims=True)
            weights = (shares * n[:, None]).sum(axis=0) + prior * start
            weights /= weights.sum()
        return weights

    ratios = np.where(cells[:, 1:] == -9999, 0.0, 2.0 ** (cells[:, 1:] / CELLS))
    ratios = np.concatenate([np.ones((len(cells), 1)), ratios], axis=1)
    start = np.full(order + 1, 1.0 / (order + 1))
    weights = {-1: em(ratios, counts, start, 1.0) if len(cells) else start}
    for c in np.unique(cells[:, 0]) if len(cells) else ():
        mine = cells[:, 0] == c
        weights[int(c)] = em(ratios[mine], counts[mine], weights[-1], PRIOR)
    return {c: (1 - FLOOR) * w + FLOOR / (order + 1) for c, w in weights.items()}


def scores(docs: DataFrame, train: Column, dev: Column, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """Score every row's whole text under the model of the rows for which ``train`` holds.

    ``dev`` says which of the training rows the mixture weights are learned on. Gives (key,
    n_tokens, n_known, train_tokens, base_score, score): all in log10, the base being the
    unigram estimate with one added.
    """
    kind = docs.schema[key].dataType.simpleString()
    train, dev = F.coalesce(train, F.lit(False)), F.coalesce(dev, F.lit(False))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), train.alias("train"), (train & dev).alias("dev"))
    packs = materialize(packed(rows))
    size, dev_texts, texts = _sizes(packs)
    buckets = max(4, -(-size // PACK))
    # A bucket is one group; as many partitions as buckets, or the session's own number.
    answers = materialize(asked(packs, order, buckets).groupBy("bucket").applyInArrow(_answer, ANSWER))
    types, tokens, dev_tokens = (int(x or 0) for x in answers.where("pack = -1 and level = 1").agg(F.sum("types"), F.sum("tokens"), F.sum("dev_tokens")).first())
    answers = answers.where("pack >= 0").select("pack", "level", "bucket", "total", "kept")

    def held_out(pack: pa.Table, found: pa.Table) -> pa.Table:
        own = Tokens(pack["blob"][0].as_buffer(), order)
        counts = _levels(own, found, "kept")
        cells, n = _cells(*_estimates(own, counts, tokens - dev_tokens, texts - dev_texts), types)
        return pa.table([pa.array(cells.tolist(), pa.list_(pa.int64())), pa.array(n)], ["cell", "n"])

    cells = packs.where("dev").select("pack", "blob").groupBy("pack")
    cells = cells.cogroup(answers.where("kept is not null").groupBy("pack")).applyInArrow(held_out, "cell array<long>, n long")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    grid = np.array(cells["cell"].tolist(), np.int64).reshape(len(cells), order + 1)
    at = np.lexsort(grid.T)
    weights = fit_weights(grid[at], cells["n"].to_numpy(float)[at], order)

    def scored(pack: pa.Table, found: pa.Table) -> pa.Table:
        own = Tokens(pack["blob"][0].as_buffer(), order)
        counts = _levels(own, found, "total")
        estimates, classes = _estimates(own, counts, tokens, texts)
        seen, place = np.unique(classes, return_inverse=True)
        mix = np.array([weights.get(int(c), weights[-1]) for c in seen])[place]
        p = mix[:, 0] / (types + 1) + sum(mix[:, i + 1] * e for i, e in enumerate(estimates))
        n = len(own.lengths)
        add = lambda x: np.bincount(own.row_of, weights=x, minlength=n)
        base = add(np.log10((counts[0] + 1) / (tokens + types + 1)))
        known = add(counts[0] > 0).astype(np.int64)
        columns = [own.rows["key"], own.lengths, known, np.full(n, tokens), base, add(np.log10(p))]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names)

    names = [key, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packs.select("pack", "blob").groupBy("pack").cogroup(answers.select("pack", "level", "bucket", "total").groupBy("pack")).applyInArrow(scored, schema)


def _sizes(packs: DataFrame) -> tuple[int, int, int]:
    """Bytes of text, held-out texts and training texts."""
    row = packs.agg(F.sum("size"), F.sum(F.when(F.col("dev"), F.col("texts"))), F.sum("texts")).first()
    return tuple(int(x or 0) for x in row)
