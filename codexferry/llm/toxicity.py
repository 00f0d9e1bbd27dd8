"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of the labelled rows: about ``EXAMPLES`` of them, chosen by the hash
of the key, all if there are fewer. Terms are words and word beginnings of four and five letters,
and each of them again where it fills 4, 8 or 16 per mille of a text (unit length forgets how much
of a text a term fills); the ``TERMS`` whose document frequency differs most between the labels (and by at least
``LEAST_Z`` standard errors) span the space. Texts are vectors of (1 + ln tf) * idf of unit length.

The index is inverted by blocks: examples stand in blocks of ``BLOCK`` and each term knows its
greatest weight per block. A text's greatest possible cosine with a block is a sum of those; blocks
are opened in its order until the next one cannot reach the ``NEAREST``-th best, so that the
neighbours are exact. Where bounds rule out so little that the blocks left to open hold more entries
than the text's terms have in all examples, the terms' entries are summed instead. Ties go to the earlier example. Neighbours vote with the square of their
cosine, against a prior vote at the examples' base rate whose weight is the one that scores the
examples best when each is left out (log loss): the result is a calibrated share. The neighbours
come along as evidence.

Bounded by parameters: what reaches the driver and all tasks (examples x their chosen terms). All
texts are scored whole, a slice of each partition at a time.

Defined results: null and empty texts, and texts without a chosen term, have no neighbour and get
the base rate; without any usable label that is 0. Labels other than 0 and 1, null labels and
labels without a text are not used; of repeated keys one row is. Rows are scored independently,
null keys stay. Only the named columns are read, so other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexferry.llm.common import give_back, slices, split_words
from codexferry.storage import materialize

EXAMPLES, TERMS, LEAST_Z, LEAST_DF = 20_000, 4096, 3.5, 3
BLOCK, NEAREST = 64, 15
DENSE = (4, 8, 16)
#: A term that one in so many examples has is kept as a column, of so many at most; the error of a cosine in 32 bits.
WIDE, COLUMNS, OFF = 24, 500, 1e-5
#: Examples that are left out in turn to choose the prior's weight.
CALIBRATE = 2000
PUNCTUATION = ".,;:!?()[]{}<>\"'|*%#$&/\\-_=+~`…«»¿¡„“”‘’"


def terms_of(words: pa.Array) -> list[pa.Array]:
    """The terms of each different word: itself, its first four and its first five letters."""
    bare = pc.utf8_trim(pc.utf8_lower(words), PUNCTUATION)
    enough = lambda n: pc.if_else(pc.greater_equal(pc.utf8_length(bare), n), pc.utf8_slice_codeunits(bare, 0, n), None)
    tag = lambda t, x: pc.binary_join_element_wise(t, x, ":")
    whole = pc.if_else(pc.not_equal(bare, ""), bare, None)
    return [tag("w", whole), tag("4", enough(4)), tag("5", enough(5))]


def levels(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The highest level a term has in a text: 0, or how many of ``DENSE`` it reaches per mille."""
    dense = sum((1000 * tf >= d * length).astype(np.int64) for d in DENSE)
    return np.where(tf >= 2, dense, 0)


def occurrences(texts: pa.Array, chosen: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) of the chosen terms, by text and term; a level counts once."""
    # No word holds a blank: it parts a term from its level.
    names = [(*t.split(" "), "0")[:2] for t in chosen.to_pylist()]
    bases = {}
    for base, _ in names:
        bases.setdefault(base, len(bases))
    at = np.full((len(bases) + 1, len(DENSE) + 1), -1, np.int64)
    for i, (base, level) in enumerate(names):
        at[bases[base], int(level)] = i
    counts, codes, words = split_words(texts)
    rows, found = np.repeat(np.arange(len(texts)), counts), []
    for terms in terms_of(words):
        place = pc.fill_null(pc.index_in(terms, value_set=pa.array(list(bases), pa.string())), -1).to_numpy()[codes] if len(words) else np.empty(0, np.int32)
        found.append(rows[place >= 0] * len(at) + place[place >= 0])
    pairs, tf = np.unique(np.concatenate(found).astype(np.int64), return_counts=True)
    row, base = pairs // len(at), pairs % len(at)
    highest = levels(tf, counts[row])
    out = [(row, at[base, 0], tf)]
    out += [(row[highest >= k], at[base[highest >= k], k], np.ones((highest >= k).sum(), np.int64)) for k in range(1, len(DENSE) + 1)]
    row, term, tf = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((term, row))
    order = order[term[order] >= 0]
    return row[order], term[order], tf[order]


def unit(rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    norms = np.sqrt(np.bincount(rows, weights=weights * weights, minlength=n))
    return weights / norms[rows]


@dataclass
class Model:
    """Terms, idf, and the examples by block; what a task needs to score texts."""

    terms: list[str]
    idf: np.ndarray
    starts: np.ndarray  # of each example's terms; examples in order
    places: np.ndarray
    weights: np.ndarray
    labels: np.ndarray
    refs: np.ndarray
    base: float
    prior: float = 0.5

    def __post_init__(self):
        blocks = -(-len(self.labels) // BLOCK)
        self.greatest = np.zeros((len(self.terms), blocks))
        owner = np.repeat(np.arange(len(self.labels)), np.diff(self.starts))
        np.maximum.at(self.greatest, (self.places, owner // BLOCK), self.weights)
        # The same entries by term, and how many there are before each block and term.
        order = np.argsort(self.places, kind="stable")
        self.owners, self.by_term = owner[order].astype(np.int32), self.weights[order].astype(np.float32)
        self.term_starts = np.searchsorted(self.places[order], np.arange(len(self.terms) + 1))
        self.entries = np.diff(self.starts[np.minimum(np.arange(blocks + 1) * BLOCK, len(self.labels))])
        # The most frequent terms are columns over all examples as well; the rest of the work is short lists.
        lengths = np.diff(self.term_starts)
        wide = np.argsort(-lengths, kind="stable")[:COLUMNS]
        wide = wide[WIDE * lengths[wide] >= max(1, len(self.labels))]
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[wide] = np.arange(len(wide))
        self.columns = np.zeros((len(wide), len(self.labels)), np.float32)
        for i, term in enumerate(wide.tolist()):
            own = slice(self.term_starts[term], self.term_starts[term + 1])
            self.columns[i, self.owners[own]] = self.by_term[own]

    def __getstate__(self) -> dict:
        """What is sent; each worker makes the index from it."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def nearest(self, places: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the best ``NEAREST`` with a positive cosine."""
        at, cosines = np.empty(0, np.int64), np.empty(0)
        if not len(self.labels) or not len(places):
            return at, cosines
        bound = weights @ self.greatest[places]
        order = np.argsort(-bound, kind="stable")
        query = np.zeros(len(self.terms))
        query[places] = weights
        order, opened, step = order[: int((bound > 0).sum())], 0, 4
        while opened < len(order):
            least = cosines[NEAREST - 1] if len(cosines) >= NEAREST else 0.0
            order = order[: opened + int((bound[order[opened:]] >= least - 1e-12).sum())]
            blocks = order[opened : opened + step]
            if not len(blocks):
                break
            if opened and self.entries[order[opened:]].sum() > (self.term_starts[places + 1] - self.term_starts[places]).sum():
                return self._summed(places, weights, without)
            own = (blocks[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
            own = own[own < len(self.labels)]
            found = self._cosines(own, query)
            hit = np.flatnonzero((found > 0) & (own != without))
            at, cosines = self._best(np.concatenate([at, own[hit]]), np.concatenate([cosines, found[hit]]))
            opened, step = opened + step, step * 2
        return at, cosines

    def _summed(self, places: np.ndarray, weights: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
        """The same result from the entries of the text's terms in all examples.

        Sums in 32 bits say which examples may be among the best; their cosines are then exact.
        """
        near = np.zeros(len(self.labels), np.float32)
        for place, weight, column in zip(places.tolist(), weights.astype(np.float32), self.column[places].tolist(), strict=True):
            if column >= 0:
                near += weight * self.columns[column]
                continue
            own = slice(self.term_starts[place], self.term_starts[place + 1])
            # An example has a term once.
            near[self.owners[own]] += weight * self.by_term[own]
        if without >= 0:
            near[without] = 0
        least = np.partition(near, len(near) - NEAREST)[len(near) - NEAREST] if len(near) > NEAREST else 0.0
        # No sum of products of unit vectors is off by more than this.
        at = np.flatnonzero((near >= least - 2 * OFF) & (near > 0))
        query = np.zeros(len(self.terms))
        query[places] = weights
        return self._best(at, self._cosines(at, query))

    def _cosines(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The exact products of some examples with a text's weights."""
        if not len(at):
            return np.empty(0)
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        entry = np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - lengths), lengths)
        return np.add.reduceat(query[self.places[entry]] * self.weights[entry], ends - lengths)

    @staticmethod
    def _best(at: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Rounded, so that equal cosines tie whatever the order of their sums.
        best = np.lexsort((at, -np.round(cosines, 12)))[:NEAREST]
        return at[best], cosines[best]

    def vote(self, at: np.ndarray, cosines: np.ndarray, prior: float | None = None) -> float:
        prior = self.prior if prior is None else prior
        power = cosines * cosines
        return float((power @ self.labels[at] + prior * self.base) / (power.sum() + prior))

    def calibrate(self) -> None:
        """The prior weight of the least log loss when each example is left out."""
        tried, losses = [0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0], np.zeros(7)
        for i in range(0, len(self.labels), -(-len(self.labels) // CALIBRATE) or 1):
            own = slice(self.starts[i], self.starts[i + 1])
            found = self.nearest(self.places[own], self.weights[own], without=i)
            for k, prior in enumerate(tried):
                p = np.clip(self.vote(*found, prior), 1e-6, 1 - 1e-6)
                losses[k] -= np.log(p if self.labels[i] else 1 - p)
        self.prior = tried[int(losses.argmin())]


def examples(docs: DataFrame, labels: DataFrame, train: Column, label: str, key: str, text: str, limit: int) -> DataFrame:
    """(ref, text, y) of the labelled sample, at most one row per key."""
    known = labels.where(train & F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.groupBy(key).agg(F.max(label).alias("y"))
    total = known.count()
    share = min(1.0, limit / max(1, total))
    known = materialize(known.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    # About `limit` narrow rows at most: a bounded broadcast.
    found = docs.select(F.col(key).alias("ref"), F.col(text).alias("text")).where("text is not null")
    found = found.join(F.broadcast(known.select(F.col(key).alias("ref"), "y")), "ref")
    return materialize(found.groupBy("ref").agg(F.min("text").alias("text"), F.max("y").cast("long").alias("y")))


def choose_terms(sample: DataFrame, limit: int) -> DataFrame:
    """(term, df) of the terms that tell the labels apart best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, codes, words = split_words(batch["text"])
            rows, y = np.repeat(np.arange(len(counts)), counts), batch["y"].to_numpy()
            for terms in terms_of(words):
                coded = terms.dictionary_encode()
                own = pc.fill_null(coded.indices, -1).to_numpy()[codes] if len(words) else np.empty(0, np.int64)
                n = len(coded.dictionary)
                pairs, tf = np.unique(rows[own >= 0] * (n + 1) + own[own >= 0], return_counts=True)
                row, term = pairs // (n + 1), pairs % (n + 1)
                highest = levels(tf, counts[row])
                for level in range(len(DENSE) + 1):
                    here = highest >= level
                    df, ones = np.bincount(term[here], minlength=n), np.bincount(term[here], weights=y[row[here]], minlength=n)
                    name = pc.binary_join_element_wise(coded.dictionary, str(level), " ") if level else coded.dictionary
                    batch_ = pa.RecordBatch.from_arrays([name, pa.array(df), pa.array(ones.astype(np.int64))], ["term", "df", "ones"])
                    yield batch_.filter(pa.array(df > 0))

    total = sample.agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    counts = sample.select("text", "y").mapInArrow(run, "term string, df long, ones long")
    counts = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ones").alias("ones")).where(F.col("df") >= LEAST_DF)
    rate = total.select((F.col("ones") / F.col("n")).alias("rate"))
    counts = counts.join(F.broadcast(rate.where("rate > 0 and rate < 1")), F.lit(True))
    z = F.abs(F.col("ones") - F.col("df") * F.col("rate")) / F.sqrt(F.col("df") * F.col("rate") * (1 - F.col("rate")))
    return counts.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(limit).select("term", "df")


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", key: str = "doc_id", text: str = "text", limit: int = EXAMPLES) -> Model:
    """Learn from the labels for which ``train`` holds."""
    sample = examples(docs, labels, train, label, key, text, limit)
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    rows = choose_terms(sample, TERMS).toPandas().sort_values("term")
    chosen = pa.array(rows["term"].tolist(), pa.string())
    idf = np.log((1 + n) / (1 + rows["df"].to_numpy(float))) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, term, tf = occurrences(batch["text"], chosen)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch["ref"], batch["y"], *lists], ["ref", "y", "term", "tf"])

    kind = sample.schema["ref"].dataType.simpleString()
    vectors = sample.mapInArrow(run, f"ref {kind}, y long, term array<long>, tf array<long>")
    vectors = vectors.where("size(term) > 0").toPandas().sort_values("ref")
    # Examples of one weightiest term stand together: blocks are alike and their bounds tight.
    weighty = [int(t[((1 + np.log(f)) * idf[t]).argmax()]) for t, f in zip(vectors["term"], vectors["tf"], strict=True)]
    vectors = vectors.iloc[np.argsort(np.array(weighty, np.int64), kind="stable")]
    lengths = vectors["term"].map(len).to_numpy(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    join = lambda c: np.concatenate(vectors[c].tolist()) if len(vectors) else np.empty(0, np.int64)
    places = join("term").astype(np.int64)
    weights = (1 + np.log(join("tf"))) * idf[places]
    weights = unit(np.repeat(np.arange(len(lengths)), lengths), weights, len(lengths)) if len(lengths) else weights
    model = Model(rows["term"].tolist(), idf, starts, places, weights, vectors["y"].to_numpy(float), vectors["ref"].to_numpy(), ones / n if n else 0.0)
    model.calibrate()
    # The driver keeps the model only, not what it was made from: later stages would carry it along.
    del vectors, places, weights, weighty
    give_back()
    return model


def _votes(texts: pa.Array, m: Model) -> tuple[np.ndarray, list]:
    """Each text's score, and its neighbours with their cosines."""
    row, term, tf = occurrences(texts, pa.array(m.terms, pa.string()))
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    weights = unit(row, (1 + np.log(tf)) * m.idf[term], len(texts))
    found = [m.nearest(term[a:b], weights[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.array([m.vote(*f) for f in found]), found


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted, evidence) per row; evidence: nearest examples, cosines, labels."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    evidence = pa.list_(pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text):
            votes, found = _votes(batch[text], m)
            shown = [[{"example": str(m.refs[i]), "cosine": float(c), "label": int(m.labels[i])} for i, c in zip(*f, strict=True)] for f in found]
            arrays = [batch[key], pa.array(votes), pa.array((votes >= 0.5).astype(np.int32)), pa.array(shown, evidence)]
            yield pa.RecordBatch.from_arrays(arrays, [key, "score", "predicted", "evidence"])

    schema = f"`{key}` {kind}, score double, predicted int, evidence array<struct<example:string,cosine:double,label:int>>"
    return docs.select(key, text).mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(pa.array(_votes(batch[text], shared.value)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
