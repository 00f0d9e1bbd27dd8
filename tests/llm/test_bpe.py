import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from codexferry.llm import bpe, queries

PATH, PATTERN = queries.RANKS, public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def odd_texts(n=400):
    draw = random.Random(5)
    wide = [chr(c) for c in draw.sample(range(0x20, 0x2FA20), 3000) if not 0xD800 <= c < 0xE000]
    alphabet = wide + list("ab  \n\t\r\x0b\x0c\x1c\x85\xa0'sst123.,") * 60
    return ["".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 90))) for _ in range(n)]


def test_same_ids_as_the_rank_merging_library(spark, reference):
    texts = [None, "", " ", "\n\n  x", "don't", "<|endoftext|>", "a" * 70_000, "aba" * 500, *odd_texts()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r["doc_id"]: r for r in queries.byte_bpe(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert rows[i]["n_tokens"] == len(ids), t
        assert rows[i]["ids_sha256"] == hashlib.sha256(raw).hexdigest(), t
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_offsets_and_pieces_of_split_characters(spark):
    texts = ["naïve 漢字 😀 end", "🜁🜂", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in bpe.encode(df, PATH, PATTERN, offsets=True).collect():
        text = texts[row["doc_id"]]
        assert sorted({i for s, e in zip(row["starts"], row["ends"]) for i in range(s, e)}) == list(range(len(text)))
        own = bpe.codec(PATH, PATTERN)
        assert "".join(own.decode_pieces(row["ids"])) == text
    whole = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN, pieces=True)
    assert {r["doc_id"]: "".join(r["pieces"]) for r in whole.collect()} == dict(enumerate(texts))


def test_ids_cut_within_a_character_give_the_replacement_character():
    own = bpe.codec(PATH, PATTERN)
    ids, _ = own.encode("🜁")
    assert len(ids) > 1
    assert "�" in "".join(own.decode_pieces(ids[:-1].tolist()))


def test_runs_of_pieces_do_not_change_ids(monkeypatch, reference):
    monkeypatch.setattr(bpe, "RUN", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.Codec(PATH, PATTERN)
    for text in ["one two  three\n\n four " * 9, *odd_texts(40)]:
        ids, places = own.encode(text, offsets=True)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert len(places) == len(ids)


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert queries.byte_bpe(spark.createDataFrame([], schema)).count() == 0
    twice = queries.byte_bpe(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], schema)).collect()
    assert len(twice) == 3 and len({r["ids_sha256"] for r in twice}) == 1


def test_pieces_that_come_again_are_merged_once_though_memory_is_full(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    own, merged = bpe.Codec(PATH, PATTERN), []

    class Counted:
        def __init__(self, model):
            self.model = model

        def tokenize(self, shown):
            merged.append(shown)
            return self.model.tokenize(shown)

    own._model = Counted(own._model)
    for i in range(100):
        text = f"naïve　again rare{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}"
        assert own.encode(text)[0].tolist() == reference.encode_ordinary(text)
    assert len(own._seen) + len(own._old) <= 50
    assert all(merged.count(piece) == 1 for piece in merged) and len(merged) >= 100
