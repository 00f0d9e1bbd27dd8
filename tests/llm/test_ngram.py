import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from codexferry.llm import ngram, queries


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def crc(d):
    return zlib.crc32(str(d if d is not None else "").encode())


def brute(rows, order=2):
    """The same model from whole dictionaries, with cells for the held-out tokens."""
    train = [tokens(t) for d, t in rows if crc(d) % 7 != 2]
    dev = [tokens(t) for d, t in rows if crc(d) % 7 != 2 and crc(d) // 7 % 10 == 0]

    def grams(texts):
        out = [Counter() for _ in range(order + 1)]
        for t in texts:
            out[0][()] += 1
            padded = ["<s>"] * (order - 1) + t
            for i in range(len(t)):
                for n in range(1, order + 1):
                    out[n][tuple(padded[i + order - n : i + order])] += 1
        return out

    everything, held = grams(train), grams(dev)
    kept = [Counter({k: v - held[n][k] for k, v in c.items()}) for n, c in enumerate(everything)]
    total, types = sum(everything[1].values()), len(everything[1])

    def estimates(t, i, counts, n_tokens):
        padded = ["<s>"] * (order - 1) + t
        p, cls = [counts[1][(t[i],)] / n_tokens if n_tokens else 0], 0
        for n in range(2, order + 1):
            ctx = tuple(padded[i + order - n : i + order - 1])
            c = counts[0][()] if set(ctx) == {"<s>"} else counts[n - 1][ctx]
            p.append(counts[n][(*ctx, t[i])] / c if c else 0)
            cls = 64 * (n - 1) + math.frexp(c)[1] if c else cls
        return p, cls

    cells = Counter()
    for t in dev:
        for i in range(len(t)):
            p, cls = estimates(t, i, kept, sum(kept[1].values()))
            cells[(cls, *(round(4 * math.log2(x * (types + 1))) if x else -9999 for x in p))] += 1
    grid = np.array(sorted(cells), np.int64).reshape(-1, order + 1)
    weights = ngram.fit_weights(grid, np.array([cells[tuple(c)] for c in grid.tolist()], float), order)
    out = []
    for d, text in rows:
        t = tokens(text)
        score = 0.0
        for i in range(len(t)):
            p, cls = estimates(t, i, everything, total)
            w = weights.get(cls, weights[-1])
            score += math.log10(w[0] / (types + 1) + sum(a * b for a, b in zip(w[1:], p)))
        base = sum(math.log10((everything[1][(x,)] + 1) / (total + types + 1)) for x in t)
        out.append((d, crc(d) % 7 == 2, len(t), sum(everything[1][(x,)] > 0 for x in t), total, base, score))
    return out


def rows_of(spark, sf="sf0.001"):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def run(spark, rows, order=2):
    df = spark.createDataFrame([(d, t, 1.0, "x") for d, t in rows], "doc_id long, text string, score double, key string")
    held_out = queries.key_hash() % 7 == 2
    found = ngram.scores(df, ~held_out, F.floor(queries.key_hash() / 7) % 10 == 0, order=order)
    return found.select("doc_id", held_out.alias("held_out"), *found.columns[1:]).collect()


def same(found, wanted):
    found, wanted = (sorted(x, key=str) for x in (map(tuple, found), wanted))
    assert len(found) == len(wanted)
    for f, w in zip(found, wanted):
        assert f[:5] == w[:5]
        assert np.allclose(f[5:], w[5:], rtol=1e-9)


def test_matches_brute_force(spark, monkeypatch):
    rows = rows_of(spark)[:120]
    rows += [(None, "That it."), (900, None), (901, ""), (902, " \n"), rows[3], rows[3], (903, "x " * 5000)]
    same(run(spark, rows), brute(rows))


def test_order_three_and_small_packs(spark, monkeypatch):
    rows = rows_of(spark)[:40]
    same(run(spark, rows, order=3), brute(rows, 3))


def test_better_than_the_base_on_held_out_texts(spark):
    found = [r for r in run(spark, rows_of(spark)) if r["held_out"]]
    assert len(found) > 10
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_no_training_text_and_empty_table(spark):
    assert run(spark, []) == []
    alone = next(i for i in range(100) if crc(i) % 7 == 2)
    (row,) = run(spark, [(alone, "a b")])
    assert row["n_known"] == 0 and row["train_tokens"] == 0 and row["base_score"] == 0


def test_packed_numbers_round_trip():
    draw = np.random.default_rng(3)
    for n in (1, 2, 1000):
        keys = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64, endpoint=False))
        assert (ngram.unpack_sorted(ngram.pack_sorted(keys)) == keys).all()
        counts = draw.integers(0, 2, n) * draw.integers(0, 10**6, n)
        assert (ngram._unpack_counts(ngram._pack_counts(counts)) == counts).all()
