import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from codexferry.llm import phrases
from codexferry.llm import queries as Q


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[\\x20\\x09]+", p) if w] for p in re.split("[.,;:!?\\x0A-\\x0D]", low)]


def brute(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in found.items():
        longer = [q for q, b in found.items() if q[0] == lang and len(q[1]) > len(w) and 100 * b >= 100 * a]
        if any(q[i : i + len(w)] == w for _, q in longer for i in range(len(q) - len(w) + 1)):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1)
    )


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "t", "w") for r in rows], "doc_id long, text string, lang string, n int, phrase string, words string")
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def corpus(seed, texts=60):
    draw = random.Random(seed)
    words = ["the", "of", "New", "york", "CITY", "é", "ü-x", "a", "b", "(c)", "\u00a0", "\x85z"] + [f"w{i}" for i in range(30)]
    fixed = ["new york city hall", "a a a a a a a", "the of the of the of", "one  two\tthree four five six", "é ü-x é"]
    out = []
    for i in range(texts):
        parts = [draw.choice(fixed) if draw.random() < 0.4 else " ".join(draw.choices(words, k=draw.randint(1, 9))) for _ in range(draw.randint(0, 12))]
        text = "".join(p + draw.choice([" ", ". ", ", ", "\n", "!", "\t", "; ", "\r\n", ":"]) for p in parts)
        out.append((i, text, draw.choice(["en", "en", "de", None, "und"])))
    return out


ODD = [(None, None, None), (1, "", "en"), (1, "...", "fr"), (2, "x", "x"), (2, "x", "x"), (3, "the of " * 3000, "en"), (4, "\x00 q \x00 q \x00 q", "de")]


@pytest.mark.parametrize("least", [2, 5, 20])
def test_matches_brute_force(spark, least):
    rows = corpus(least) + ODD
    assert run(spark, rows, least=least) == brute(rows, least)


def test_many_shards_and_tries(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 400)
    monkeypatch.setattr(phrases, "LIMIT", 60)
    monkeypatch.setattr("codexferry.llm.common.SLICE_BYTES", 300)
    rows = corpus(9) + ODD
    assert run(spark, rows, least=12, longest=4, top=9) == brute(rows, 12, 4, 9)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None), (2, "a b", "en")]) == []


def test_query_matches_its_sql(spark, tmp_path):
    rows = corpus(4, 300) + ODD
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(Q.COLLOCATIONS_SQL).fetchall()
    got = sorted(tuple(r) for r in Q.op11_phrase_collocations(spark, str(tmp_path)).collect())
    assert len(got) > 20 and got == sorted(want) == brute(rows, 100)


@pytest.mark.parametrize("length", [2, 3, 5])
def test_trie_finds_its_phrases_only(length):
    draw = np.random.default_rng(length)
    wanted = np.unique(draw.integers(1, 40, (900, length)) ** 2, axis=0)
    draw.shuffle(wanted)
    trie = phrases.Trie(wanted)
    ids = draw.integers(0, 40, 20_000) ** 2
    place, found = trie.found(ids)
    rows = {tuple(w): i for i, w in enumerate(wanted.tolist())}
    want = [(i, rows[tuple(ids[i : i + length].tolist())]) for i in range(len(ids) - length + 1) if tuple(ids[i : i + length].tolist()) in rows]
    assert sorted(zip(place.tolist(), found.tolist(), strict=True)) == want
    short = phrases.Trie(wanted[:1])
    assert [x.tolist() for x in short.found(wanted[0])] == [[0], [0]]
    assert len(trie.found(np.empty(0, np.int64))[0]) == 0


def test_pieces_of_sliced_texts():
    texts = pa.array(["skip", "A b.c", None, "", " d", "e"]).slice(1)
    words, begin = phrases.split_pieces(texts)
    assert words.to_pylist() == ["a", "b", "c", "d", "e"] and begin.tolist() == [True, False, True, True, True]


def shard_rows(lists, shards=1, kind=np.int32):
    ids = [np.array(x, kind) for x in lists]
    columns = [pa.array(["en"] * len(ids)), pa.array([shards] * len(ids)), pa.array([kind().itemsize] * len(ids), pa.int32()), pa.array([x.tobytes() for x in ids])]
    return pa.RecordBatch.from_arrays(columns, ["lang", "shards", "width", "ids"])


def told(batches):
    return sorted((p, w, n) for b in batches for r in b.to_pylist() for p, w, n in zip(r["phrases"], r["words"], r["counts"], strict=True))


class Sent:
    def __init__(self, *value):
        self.value = value


@pytest.mark.parametrize("kind, shift", [(np.int32, 0), (np.int64, 2**33)])
def test_pairs_and_occurrences_of_parts_of_a_shard(monkeypatch, kind, shift):
    draw = np.random.default_rng(2)
    lists = [np.where(x > 0, x + shift, 0) for x in (draw.integers(0, 12, n) for n in (0, 1, 400))]
    f = Counter((int(a), int(b)) for x in lists[-1:] for a, b in zip(x, x[1:], strict=False) if a and b)
    assert told(phrases.pairs(3, 5)([shard_rows(lists, kind=kind)])) == sorted((*p, n) for p, n in f.items() if n >= 3)
    wanted, numbers = np.array([p for p, n in f.items() if n >= 2]), np.arange(100, 100 + sum(n >= 2 for n in f.values()))
    row, x = {tuple(w): i for w, i in zip(wanted.tolist(), numbers.tolist(), strict=True)}, lists[-1].tolist()
    more = Counter((row[a, b], c) for a, b, c in zip(x, x[1:], x[2:], strict=False) if (a, b) in row and c)
    counts = [(row[p], 0, n) for p, n in f.items() if p in row]
    for places in (1, 7, 10**6):
        monkeypatch.setattr(phrases, "PLACES", places)
        found = told(phrases.occurrences(Sent(phrases.Trie(wanted), numbers), 2, True, 5)([shard_rows(lists, kind=kind)]))
        assert found == sorted([*counts, *((*p, n) for p, n in more.items() if n >= 2)])


def test_a_shard_is_not_copied_many_times():
    draw, places = np.random.default_rng(5), 1_000_000
    ids = draw.zipf(1.3, places) % 50_000
    batch = shard_rows([ids])
    wanted = np.unique(np.stack([ids[:-1], ids[1:]], axis=1)[:20_000], axis=0)
    wanted = wanted[(wanted > 0).all(axis=1)]
    sent = Sent(phrases.Trie(wanted), np.arange(len(wanted)))
    for run in (phrases.pairs(100, 4), phrases.occurrences(sent, 100, True, 4)):
        tracemalloc.start()
        for _ in run([batch]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 * places
