"""Collocations: phrases that stand together more often than their parts would by chance.

Texts are cut into pieces at punctuation and line ends and into words at blanks, all per language.
Phrases of 2 to ``longest`` words that occur at least ``least`` times are candidates; a candidate
is cut where ``1000 * a * n / (l * r)`` (floored) is lowest, with its count ``a``, the counts ``l``
and ``r`` of the two parts and the number ``n`` of words of the language. Candidates that never
occur outside a longer candidate are dropped; the first ``top`` of each language are returned.

The search is Apriori's, level by level. A phrase of m words can only be frequent if the m-1 words
it begins and ends with are. Candidates of a level go into double-array tries, at most about
``LIMIT`` phrases each; a trie is broadcast, so its size has a bound whatever the data (more
candidates are more tries, one pass for each). In each shard of text numpy advances the states of
all positions together, word by word, and counts the accepting states; the shards' counts are
summed by Spark. In the same pass, a shard proposes the next level: every state that accepts, with
the frequent word that follows it.

Proposals are safe, not sampled: a language has S shards, so a phrase with ``least`` occurrences
has ``ceil(least / S)`` of them in at least one shard, and a shard may leave out what it holds less
often. With the most that the silent shards may hold added, a phrase that cannot reach ``least``
is no candidate. What is left is counted exactly by the tries.

How it is laid out. The words of a shard (about ``SHARD`` bytes of one language) are dictionary
codes, written once. Dictionaries, not words, are shuffled to count words: each shard sends its
words in buckets by hash, a bucket counts the words of all shards and answers each shard with the
numbers of the frequent ones. Every other word and every end of a piece is a 0, which no phrase
passes. A frequent word is one item per shard that holds it, however often it occurs.
Counts beyond 64 bits cannot arise in sums; products are decimals of 38 digits.

Defined results: a null text is empty, a null language ``und``. Repeated rows count again. Ties are
broken by count, then by the phrase's bytes. A language without candidates has no rows; an empty
table gives an empty one. Only the named columns are read, so other columns do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexferry.llm.common import BROADCAST_KEYS, ODD, give_back, hash_strings, mixed, slices
from codexferry.storage import materialize

#: Bytes of words of a shard; of all waiting shards of a task; phrases of a trie.
SHARD, WAITING, LIMIT = 16 << 20, 48 << 20, 400_000
#: Words of all shards' dictionaries that are counted together.
BUCKET_WORDS = 500_000
#: Places of all shards whose proposals are added up together, at most one for each place.
BUCKET_PLACES = 2_000_000
#: Places of a shard that advance together.
PLACES = 250_000

#: Classes of bytes: 1 blank, 2 end of a piece, 0 part of a word.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, 0x09]] = 1
CLASSES[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


# --- words of a shard ----------------------------------------------------------


def split_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts in order, and which of them begin a piece."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    size = int(ends[-1]) if len(ends) else 0
    _, _, data = pa.concat_arrays([texts]).buffers()
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if size else 0
    raw = np.frombuffer(data, np.uint8)[first : first + size] if size else np.empty(0, np.uint8)
    kinds = CLASSES[raw]
    inside = kinds == 0
    # A text starts a piece of its own.
    begins = np.zeros(size + 1, bool)
    begins[0] = True
    begins[ends] = True
    begins = begins[:size]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | begins[1:]
    at = np.flatnonzero(starts)
    if not len(at):
        return pa.array([], pa.string()), np.empty(0, bool)
    lengths = np.add.reduceat(inside, at, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(LOWER[raw[inside]]))
    piece = np.cumsum((kinds == 2) | begins, dtype=np.int32)[at]
    return words, np.diff(piece, prepend=-1) != 0


def shards(docs: DataFrame) -> DataFrame:
    """(shard, lang, words, counts, codes) of rows ``text, lang``: words by number from 1, 0 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        waiting: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            parts = waiting.pop(lang)
            sizes.pop(lang)
            coded = pa.chunked_array([w for w, _ in parts], pa.string()).dictionary_encode().combine_chunks()
            codes = coded.indices.to_numpy()
            begin = np.concatenate([b for _, b in parts])
            out = np.zeros(len(codes) + int(begin.sum()), np.int32)
            out[np.arange(len(codes)) + np.cumsum(begin)] = codes + 1
            counts = np.bincount(codes, minlength=len(coded.dictionary))
            whole = pa.array([0, len(counts)], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, x) for x in (coded.dictionary, pa.array(counts))]
            row = [pa.array([(task << 32) + number]), pa.array([lang], pa.string()), *lists, pa.array([out.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["shard", "lang", "words", "counts", "codes"])

        for batch in slices(batches, "text"):
            langs = batch["lang"].dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                words, begin = split_pieces(batch["text"].filter(pc.equal(langs.indices, i)))
                if not len(words):
                    continue
                waiting.setdefault(lang, []).append((words, begin))
                sizes[lang] = sizes.get(lang, 0) + words.nbytes
                while sizes and (max(sizes.values()) >= SHARD or sum(sizes.values()) >= WAITING):
                    yield flush(max(sizes, key=sizes.get))
                    number += 1
                    give_back()
        for lang in list(waiting):
            yield flush(lang)
            number += 1
            give_back()

    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, "shard long, lang string, words array<string>, counts array<long>, codes binary")


def _dealt(buckets: int):
    """The dictionary of each shard, cut into buckets by the words' hashes: one row per shard and bucket."""

    def dealt(row: dict) -> pa.RecordBatch:
        words = row["words"].values
        counts = row["counts"].values.to_numpy()
        bucket = (hash_strings(words) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, starts = np.unique(bucket[order], return_index=True)
        cuts = pa.array([*starts.tolist(), len(order)], pa.int32())
        lists = [words.take(pa.array(order)), pa.array(order.astype(np.int32)), pa.array(counts[order])]
        n = len(own)
        return pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array([row["lang"].as_py()] * n, pa.string()), pa.array([row["shard"].as_py()] * n, pa.int64()), *(pa.ListArray.from_arrays(cuts, x) for x in lists)],
            ["bucket", "lang", "shard", "words", "codes", "counts"],
        )

    return _by_row(dealt)


BUCKET = "bucket long, lang string, shard long, words array<string>, codes array<int>, counts array<long>"
ANSWER = "lang string, text string, phrase long, a long, shard long, codes array<int>, numbers array<long>"


def _summed(buckets: int, least: int):
    """A bucket's words of all shards: those frequent enough, with numbers of their own, and each shard's codes for them.

    A row without a text and a shard has the number of all words of a language in the bucket.
    """

    def run(group: pa.Table) -> pa.Table:
        bucket, taken, out = group["bucket"][0].as_py(), 0, []
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = [x.split()[0] for x in ANSWER.split(", ")]

        def rows(n: int, **columns) -> None:
            arrays = [columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)]
            out.append(pa.table(arrays, names))

        for lang in pc.unique(group["lang"]).to_pylist():
            own = group.filter(pc.equal(group["lang"], lang)).combine_chunks()
            coded = own["words"].combine_chunks().flatten().dictionary_encode()
            place = coded.indices.to_numpy()
            counts = own["counts"].combine_chunks().flatten().to_numpy()
            total = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(total, place, counts)
            rows(1, lang=pa.array([lang]), a=pa.array([int(total.sum())]))
            frequent = np.flatnonzero(total >= least)
            if not len(frequent):
                continue
            number = np.zeros(len(total), np.int64)
            # Buckets take turns: numbers are unique and nearly without gaps.
            number[frequent] = (np.arange(len(frequent)) + taken) * buckets + bucket + 1
            taken += len(frequent)
            rows(len(frequent), lang=pa.array([lang] * len(frequent)), text=coded.dictionary.take(pa.array(frequent)), phrase=pa.array(number[frequent]), a=pa.array(total[frequent]))
            hit = number[place] > 0
            owner = np.repeat(np.arange(len(own)), pc.list_value_length(own["codes"]).to_numpy())[hit]
            cuts = pa.array(np.searchsorted(owner, np.arange(len(own) + 1)).astype(np.int32))
            codes = own["codes"].combine_chunks().flatten().to_numpy()[hit]
            rows(len(own), shard=own["shard"].combine_chunks(), codes=pa.ListArray.from_arrays(cuts, pa.array(codes)), numbers=pa.ListArray.from_arrays(cuts, pa.array(number[place][hit])))
        return pa.concat_tables(out)

    return run


def _renumbered(group: pa.Table) -> pa.Table:
    """A shard's codes as numbers of frequent words; the rows of the buckets say which."""
    known = group.filter(pc.is_valid(group["known"])).combine_chunks()
    whole = group.filter(pc.is_valid(group["codes"]))
    codes = np.frombuffer(whole["codes"][0].as_py(), np.int32)
    found = known["numbers"].combine_chunks().flatten().to_numpy() if len(known) else np.empty(0, np.int64)
    numbers = np.zeros(int(codes.max(initial=0)) + 1, np.int32 if found.max(initial=0) < 2**31 else np.int64)
    if len(known):
        numbers[known["known"].combine_chunks().flatten().to_numpy() + 1] = found
    ids = numbers[codes]
    # Runs of zeros are one zero.
    kept = ids != 0
    kept[1:] |= kept[:-1].copy()
    kept[:1] = True
    ids = ids[kept]
    give_back()
    row = [whole["lang"][0].as_py(), int(whole["shards"][0].as_py()), ids.itemsize, ids.tobytes()]
    return pa.table([pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["lang", "shards", "width", "ids"])


def _ids(row: dict) -> np.ndarray:
    return np.frombuffer(row["ids"].as_buffer(), np.int32 if row["width"].as_py() == 4 else np.int64)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch[name][i] for name in batch.schema.names}


def _by_row(made):
    """A batch for each row; what making it took is given back before the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield made(row)
            give_back()

    return run


# --- tries ---------------------------------------------------------------------


class Trie:
    """A double array over phrases of one length: a state's child for a symbol is ``base + symbol`` if ``check`` names the state.

    Symbols are the phrases' words, numbered from 1; slots 1 to their number are the root's
    children. ``accept`` is the phrase's row at the slot of its last word.
    """

    def __init__(self, phrases: np.ndarray):
        self.words = np.unique(phrases)
        count, self.length = phrases.shape
        symbols = np.searchsorted(self.words, phrases) + 1
        order = np.lexsort(symbols.T[::-1])
        symbols = symbols[order]
        self.base = np.zeros(len(self.words) + 1, np.int32)
        self.check = np.zeros(len(self.words) + 1, np.int32)
        self.used = np.ones(len(self.words) + 1, bool)
        # First rows of each distinct beginning, and the slots of its state.
        heads = np.flatnonzero(np.diff(symbols[:, 0], prepend=0))
        slots = symbols[heads, 0]
        for depth in range(1, self.length):
            new = np.diff(symbols[:, depth], prepend=0) != 0
            new[heads] = True
            following = np.flatnonzero(new)
            parent = np.searchsorted(heads, following, "right") - 1
            slots = self._placed(slots, parent, symbols[following, depth])
            heads = following
        self.accept = np.full(len(self.base), -1, np.int32)
        self.accept[slots] = order[heads]
        del self.used

    def _placed(self, states: np.ndarray, parent: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Slots for the children of some states; those with most children choose first."""
        starts = np.flatnonzero(np.diff(parent, prepend=-1))
        sizes = np.diff(starts, append=len(parent))
        out = np.empty(len(parent), np.int64)
        low = 0
        for g in np.argsort(-sizes, kind="stable"):
            own = symbols[starts[g] : starts[g] + sizes[g]]
            gaps = own - own[0]
            self._reach(low + 4096 + int(gaps[-1]))
            at = low
            while True:
                free = at + np.flatnonzero(~self.used[at : at + 4096])
                if at == low:
                    low = int(free[0]) if len(free) else at + 4096
                fits = free
                self._reach(at + 4096 + int(gaps[-1]))
                for gap in gaps[1:]:
                    if not len(fits):
                        break
                    fits = fits[~self.used[fits + gap]]
                if len(fits):
                    break
                at += 4096
                self._reach(at + 4096)
            taken = fits[0] + gaps
            self.used[taken] = True
            self.check[taken] = states[g]
            self.base[states[g]] = fits[0] - own[0]
            out[starts[g] : starts[g] + sizes[g]] = taken
        return out

    def _reach(self, slot: int) -> None:
        """Slots up to this one exist."""
        if slot < len(self.used):
            return
        size = max(slot + 1, 2 * len(self.used))
        for name in ("base", "check", "used"):
            old = getattr(self, name)
            grown = np.zeros(size, old.dtype)
            grown[: len(old)] = old
            setattr(self, name, grown)

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin, and which: the states of all positions advance together."""
        at = np.searchsorted(self.words, ids)
        at[at == len(self.words)] = 0
        symbols = np.where(self.words[at] == ids, at + 1, 0)
        place = np.flatnonzero(symbols)
        state = symbols[place]
        for step in range(1, self.length):
            inner = place + step < len(ids)
            place, state = place[inner], state[inner]
            symbol = symbols[place + step]
            slot = self.base[state] + symbol
            alive = (symbol > 0) & (slot < len(self.check))
            alive &= self.check[np.where(alive, slot, 0)] == state
            place, state = place[alive], slot[alive]
        return place, self.accept[state]


PROPOSED = "bucket long, shards long, phrases array<long>, words array<long>, counts array<long>"


def _counted(codes: np.ndarray, wide: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, n) of a shard's proposals ``left * wide + right``, sorted in place; those below ``least`` are left out."""
    codes.sort()
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    n = np.diff(starts, append=len(codes))
    codes, n = codes[starts[n >= least]], n[n >= least]
    return codes // wide, codes % wide, n


def _bucketed(phrase: np.ndarray, word: np.ndarray, n: np.ndarray, shards: int, buckets: int) -> pa.RecordBatch:
    """Counts by bucket: a row for each bucket instead of one for each phrase."""
    phrase, word, n = (x.astype(np.int64) for x in (phrase, word, n))
    bucket = (mixed(phrase.view(np.uint64) * ODD + word.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, starts = np.unique(bucket[order], return_index=True)
    cuts = pa.array([*starts.tolist(), len(order)], pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order])) for x in (phrase, word, n)]
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), shards)), *lists], [x.split()[0] for x in PROPOSED.split(", ")])


def _added(least: int):
    """(phrase, word, n) of a bucket: phrases found often enough (word 0), and proposals that may be.

    A shard that is silent about a proposal holds less of it than a shard has to tell.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lengths = pc.list_value_length(group["phrases"]).to_numpy()
        phrase, word, n = (group[c].combine_chunks().flatten().to_numpy() for c in ("phrases", "words", "counts"))
        shards = np.repeat(group["shards"].to_numpy(), lengths)
        order = np.lexsort((word, phrase))
        phrase, word, n, shards = (x[order] for x in (phrase, word, n, shards))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(phrase) != 0) | (np.diff(word) != 0)
        first = np.flatnonzero(new)
        seen, told = np.add.reduceat(n, first), np.diff(first, append=len(order))
        most = seen + (shards[first] - told) * (-(-least // shards[first]) - 1)
        good = np.where(word[first] == 0, seen, most) >= least
        give_back()
        return pa.table([pa.array(phrase[first][good]), pa.array(word[first][good]), pa.array(seen[good])], ["phrase", "word", "n"])

    return run


def pairs(least: int, buckets: int):
    """Proposals of two words: frequent words that follow each other."""

    def proposed(row: dict) -> pa.RecordBatch:
        ids, shards, names = _ids(row), row["shards"].as_py(), None
        wide = int(ids.max(initial=0)) + 1
        if wide > 2**31:
            # Two such numbers don't fit into 64 bits, but their places among the shard's own do.
            names = np.unique(np.append(ids, 0))
            ids, wide = np.searchsorted(names, ids), len(names)
        good = (ids[:-1] > 0) & (ids[1:] > 0)
        codes = ids[:-1][good].astype(np.int64)
        codes *= wide
        codes += ids[1:][good]
        left, right, n = _counted(codes, wide, -(-least // shards))
        return _bucketed(*((left, right) if names is None else (names[left], names[right])), n, shards, buckets)

    return _by_row(proposed)


def occurrences(sent, least: int, extend: bool, buckets: int):
    """Counts of a trie's phrases (word 0), and proposals of one word more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, numbers = sent.value
        total = np.zeros(len(numbers), np.int64)

        def proposed(row: dict) -> pa.RecordBatch | None:
            ids, shards = _ids(row), row["shards"].as_py()
            wide, codes = int(ids.max(initial=0)) + 1, []
            for begin in range(0, len(ids), PLACES):
                # A phrase belongs to the part where it begins.
                place, phrase = trie.found(ids[begin : begin + PLACES + trie.length - 1])
                np.add.at(total, phrase, 1)
                if extend:
                    end = place + begin + trie.length
                    inner = end < len(ids)
                    follows = ids[end[inner]].astype(np.int64)
                    codes.append((phrase[inner].astype(np.int64) * wide + follows)[follows > 0])
            if not extend:
                return None
            left, right, n = _counted(np.concatenate(codes) if codes else np.empty(0, np.int64), wide, -(-least // shards))
            return _bucketed(numbers[left], right, n, shards, buckets)

        for row in _each(batches):
            made = proposed(row)
            if made is not None:
                yield made
            del made
            give_back()
        hit = np.flatnonzero(total)
        yield _bucketed(numbers[hit], np.zeros(len(hit)), total[hit], 1, buckets)

    return run


# --- levels --------------------------------------------------------------------


def _candidates(proposals: DataFrame, before: DataFrame, words: DataFrame) -> DataFrame:
    """(phrase, lang, text, ids) that may be frequent: proposals that begin and end with a frequent phrase."""
    begun = before.select(F.col("phrase"), "lang", F.col("text").alias("begin"), F.col("ids").alias("begin_ids"))
    rows = proposals.select("phrase", "word").join(begun, "phrase")
    rows = rows.join(words.select(F.col("phrase").alias("word"), F.col("text").alias("last")), "word")
    rows = rows.select("lang", F.concat_ws(" ", "begin", "last").alias("text"), F.concat("begin_ids", F.array("word")).alias("ids"))
    end = F.slice("ids", F.lit(2), F.size("ids") - 1)
    rows = rows.join(before.select(F.col("ids").alias("end")), end == F.col("end"), "left_semi")
    return materialize(rows.withColumn("phrase", F.monotonically_increasing_id()))


def _with_lang(rows: DataFrame, langs: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(langs) if langs.count() <= BROADCAST_KEYS else langs, "lang")


def _tried(ids: DataFrame, candidates: DataFrame, least: int, extend: bool, buckets: int) -> DataFrame:
    """(phrase, word, n) of all shards: one pass for each trie."""
    tries = max(1, math.ceil(candidates.count() / LIMIT))
    context = ids.sparkSession.sparkContext
    out = None
    for number in range(tries):
        part = candidates.where(F.pmod(F.xxhash64("ids"), F.lit(tries)) == number).select("phrase", "ids").toArrow()
        if not len(part):
            continue
        lists = part["ids"].combine_chunks()
        phrases = lists.flatten().to_numpy().reshape(len(lists), -1)
        sent = context.broadcast((Trie(phrases), part["phrase"].to_numpy()))
        found = _sums(ids.mapInArrow(occurrences(sent, least, extend, buckets), PROPOSED), least)
        sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def _sums(dealt: DataFrame, least: int) -> DataFrame:
    return materialize(dealt.groupBy("bucket").applyInArrow(_added(least), "phrase long, word long, n long"))


def counted(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n, shards), and per number of words the frequent phrases (phrase, lang, text, ids, a)."""
    kept = materialize(shards(docs))
    size = kept.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_WORDS))
    dealt = kept.select("shard", "lang", "words", "counts").mapInArrow(_dealt(buckets), BUCKET)
    found = materialize(dealt.groupBy("bucket").applyInArrow(_summed(buckets, least), ANSWER))
    langs = found.where("text is null and shard is null").groupBy("lang").agg(F.sum("a").alias("n"))
    langs = materialize(langs.join(kept.groupBy("lang").agg(F.count("*").alias("shards")), "lang"))
    words = found.where("text is not null").select("lang", "text", "phrase", "a")
    words = materialize(words.withColumn("ids", F.array("phrase")))
    named = found.where("shard is not null").select("shard", F.col("codes").alias("known"), "numbers")
    blobs = _with_lang(kept.select("shard", "lang", "codes"), langs.select("lang", "shards"))
    ids = blobs.unionByName(named, allowMissingColumns=True).groupBy("shard").applyInArrow(_renumbered, "lang string, shards long, width int, ids binary")
    ids = materialize(ids)

    places = ids.agg(F.coalesce(F.sum(F.octet_length("ids") / F.col("width")), F.lit(0.0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(places / BUCKET_PLACES))
    levels = [words]
    proposals = _sums(ids.mapInArrow(pairs(least, buckets), PROPOSED), least)
    for length in range(2, longest + 1):
        candidates = _candidates(proposals, levels[-1], words)
        if candidates.isEmpty():
            break
        found = _tried(ids, candidates, least, length < longest, buckets)
        frequent = found.where("word = 0").select("phrase", F.col("n").alias("a"))
        levels.append(materialize(candidates.join(frequent, "phrase")))
        proposals = found.where("word > 0")
    return langs, levels


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    langs, levels = counted(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")), least, longest)
    spark = docs.sparkSession
    known = levels[0].select("lang", "text", "a")
    phrases = spark.createDataFrame([], known.schema)
    inside = phrases
    for level in levels[1:]:
        phrases = phrases.unionByName(level.select("lang", "text", "a"))
    known = known.unionByName(phrases)
    parts = F.split("text", " ")
    joined = lambda start, size: F.array_join(F.slice(parts, start, size), " ")
    for level in levels[2:]:
        for start in (1, 2):
            inside = inside.unionByName(level.select("lang", joined(F.lit(start), F.size(parts) - 1).alias("text"), "a"))
    # What is inside a longer phrase as often as anywhere is inside one with one word more as often.
    alone = phrases.join(inside, ["lang", "text", "a"], "left_anti")
    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)))
    cuts = cuts.withColumn("left", joined(F.lit(1), F.col("k"))).withColumn("right", joined(F.col("k") + 1, F.size(parts) - F.col("k")))
    part = lambda name, count: known.select("lang", F.col("text").alias(name), F.col("a").alias(count))
    cuts = _with_lang(cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]), langs)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("over", wide("a") * wide("n") * F.lit(1000)).withColumn("under", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "text", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "text")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
