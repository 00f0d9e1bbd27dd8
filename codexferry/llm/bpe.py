"""Byte-level BPE: encode texts to ids with places, decode ids to bytes and text.

The ``tokenizers`` library applies the merges; the vocabulary is a rank file (base64 of a token's
bytes, a blank, its rank), read on each executor from ``path``. The library works on characters,
so each byte stands for one printable character (``byte_characters``); decoding reverses that
table. Rank files have no list of merges: every split of a token into two tokens is one, in order
of the token's rank, which gives the same ids as merging the pair of lowest rank first.

A pattern cuts a text into pieces and each piece is encoded alone, so a piece that comes again
costs a look-up. Remembered pieces are a new and an old generation: where the new one is full, it
becomes the old one, and what is met again moves up, so that only rare pieces are forgotten. Pieces
are taken in runs of bounded length: memory does not grow with a text.

Defined results: a null or empty text has no ids. Ids outside the vocabulary are an error. Rows
are independent: repeated rows give repeated results, and null keys stay. Only the named columns
are read and returned, so other columns, whatever their names, do no harm.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models, pre_tokenizers

from codexferry.llm.common import slices

#: Pieces of one text that are handled at a time, those that a generation remembers, and those encoded at once with places.
RUN, REMEMBERED, AT_ONCE = 500_000, 40_000, 2_000
SLICE = 2 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Vocabulary, pattern and the pieces seen so far; one per worker process."""

    def __init__(self, path: str, pattern: str):
        # One task is one thread: Spark runs the tasks side by side.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = read_ranks(path)
        shown = byte_characters()
        name = {token: "".join(map(shown.__getitem__, token)) for token in ranks}
        merges = [
            (name[token[:cut]], name[token[cut:]])
            for token in sorted(ranks, key=ranks.get)
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        vocabulary = {name[token]: rank for token, rank in ranks.items()}
        self._model = models.BPE(vocabulary, merges, ignore_merges=True)
        self._shown = dict(enumerate(shown))
        self._tokenizer = Tokenizer(self._model)
        self._tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._pattern = regex.compile(pattern)
        self._seen: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._places: dict[str, tuple] = {}
        # Back from characters to bytes: all tokens' bytes in one array, and where each begins.
        back = {c: b for b, c in enumerate(shown)}
        self._bytes = {rank: bytes(map(back.__getitem__, text)) for text, rank in vocabulary.items()}
        self._flat = np.frombuffer(b"".join(self._bytes[r] for r in sorted(self._bytes)), np.uint8)
        self._length = np.zeros(max(self._bytes, default=-1) + 1, np.int64)
        self._length[list(self._bytes)] = [len(b) for b in self._bytes.values()]
        self._start = np.cumsum(self._length) - self._length

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Each piece's ids."""
        if len(self._seen) > REMEMBERED:
            self._seen, self._old = {}, self._seen
        for piece in set(pieces).difference(self._seen):
            code = self._old.get(piece)
            if code is None:
                shown = piece.encode().decode("latin-1").translate(self._shown)
                code = array("I", [token.id for token in self._model.tokenize(shown)]).tobytes()
            self._seen[piece] = code
        return self._seen

    def _learn_places(self, pieces: list[str]) -> dict[str, tuple]:
        """Each piece's ids and the characters that they touch."""
        if len(self._places) > REMEMBERED:
            self._places = {}
        new = list(set(pieces).difference(self._places))
        for start in range(0, len(new), AT_ONCE):
            part = new[start : start + AT_ONCE]
            for piece, code in zip(part, self._tokenizer.encode_batch(part), strict=True):
                self._places[piece] = (array("I", code.ids).tobytes(), np.array(code.offsets, np.int64).reshape(-1, 2))
        return self._places

    def encode(self, text: str, offsets: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids, and the first and last-but-one character of each token if asked for."""
        ids, places, at = [], [np.empty((0, 2), np.int64)], 0
        found = (m.group() for m in self._pattern.finditer(text)) if len(text) > RUN else iter(self._pattern.findall(text))
        while pieces := list(islice(found, RUN)):
            if not offsets:
                ids.append(b"".join(map(self._learn(pieces).__getitem__, pieces)))
                continue
            codes = list(map(self._learn_places(pieces).__getitem__, pieces))
            ids += [c[0] for c in codes]
            ends = np.cumsum([0, *map(len, pieces)]) + at
            at = int(ends[-1])
            own = np.concatenate([c[1] for c in codes])
            places.append(own + np.repeat(ends[:-1], [len(c[1]) for c in codes])[:, None])
        return np.frombuffer(b"".join(ids), np.uint32), np.concatenate(places) if offsets else None

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if int(ids.max()) >= len(self._length) or not self._length[ids].all():
            raise ValueError("an id is not in the vocabulary")
        lengths = self._length[ids]
        ends = np.cumsum(lengths)
        return self._flat[np.arange(ends[-1]) + np.repeat(self._start[ids] - (ends - lengths), lengths)].tobytes()

    def decode_pieces(self, ids) -> list[str]:
        """The text that each id completes: a character split over ids comes with its last one.

        Bytes that are no UTF-8, also an unfinished character at the end, give U+FFFD.
        """
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = [decoder.decode(self._bytes[i]) for i in ids]
        if out:
            out[-1] += decoder.decode(b"", True)
        return out


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(
    df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = False
) -> DataFrame:
    """(key, ids), with ``offsets`` also (starts, ends): the characters that each token touches."""
    fields = [f"`{key}` {df.schema[key].dataType.simpleString()}", "ids array<int>"]
    if offsets:
        fields += ["starts array<int>", "ends array<int>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, text, SLICE):
            done = [own.encode(t or "", offsets) for t in batch[text].to_pylist()]
            cuts = pa.array(np.cumsum([0, *(len(i) for i, _ in done)]), pa.int32())
            columns = [np.concatenate([i for i, _ in done]).view(np.int32)]
            if offsets:
                columns += list(np.concatenate([p for _, p in done]).astype(np.int32).T)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(c))) for c in columns]
            yield pa.RecordBatch.from_arrays([batch[key], *lists], [key, "ids", "starts", "ends"][: 1 + len(lists)])

    return df.select(key, text).mapInArrow(run, ", ".join(fields))


def _id_rows(lists: pa.ListArray) -> Iterator[np.ndarray]:
    cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    for start, length in zip(cuts.tolist(), lengths.tolist(), strict=False):
        yield values[start : start + length]


def decode(
    df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids", pieces: bool = False
) -> DataFrame:
    """(key, decoded bytes); with ``pieces`` also the text that each id completes."""
    names = [key, "decoded", "pieces"][: 2 + pieces]
    fields = [f"`{key}` {df.schema[key].dataType.simpleString()}", "decoded binary", "pieces array<string>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            columns = [batch[key], pa.array([own.decode_bytes(x) for x in _id_rows(batch[ids])], pa.binary())]
            if pieces:
                columns.append(pa.array([own.decode_pieces(x.tolist()) for x in _id_rows(batch[ids])], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(key, ids).mapInArrow(run, ", ".join(fields[: 2 + pieces]))


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text's ids, and the bytes that they decode to.

    Encoding and decoding share a task and its vocabulary; ids do not leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, text, SLICE):
            found = []
            for t in batch[text].to_pylist():
                ids, _ = own.encode(t or "")
                found.append((len(ids), hashlib.sha256(ids.astype("<u4", copy=False)).hexdigest(), hashlib.sha256(own.decode_bytes(ids)).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch[key], *arrays], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
