import itertools
import random

import numpy as np
import pytest

from codexferry.llm import neardup


def words(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            part[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def texts(seed):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefgh", k=3)) for _ in range(80)]
    shared = " ".join(draw.choices(vocabulary, k=60))
    out = []
    for _ in range(25):
        base = draw.choices(vocabulary, k=draw.choice([1, 3, 5, 60, 150]))
        out.append(" ".join(base))
        for _ in range(draw.choice([0, 0, 1, 6])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 1, 3])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            out.append(" \t".join(copy).upper())
        out.append(shared + " " + " ".join(draw.choices(vocabulary, k=40)))
    return [None, "", " \n", *out, out[0], "Äé Ä", "äé ä"]


@pytest.mark.parametrize("seed,width", [(1, 4), (2, 5)])
def test_matches_brute_force(spark, monkeypatch, seed, width):
    monkeypatch.setattr(neardup, "BLOCK", 4 * seed)
    rows = [(i + 1, t) for i, t in enumerate(texts(seed))]
    rows += [(None, rows[3][1]), (None, "seen once only here and now"), (5, "another text of one key in two rows"), rows[7]]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, class string, n int")
    found = neardup.near_duplicates(df, width=width).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute(rows, width)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in found)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_merge_and_estimate():
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    ra, rb = neardup.registers(a), neardup.registers(b)
    union = neardup.registers(np.union1d(a, b))
    assert (neardup.merge_registers(ra, rb) == union).all()
    guess = neardup.estimate(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(guess - 1500 / 2500) < 0.15


def test_near_copies_without_keys_link(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(7, base), (None, base + " x"), (None, base + " y z"), (None, "alone " * 9), (9, "other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_duplicates(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute(rows, 5)
    assert [r["component_id"] for r in found].count(7) == 3
    kept = neardup.deduplicated(df).collect()
    assert sorted((r["text"] for r in kept)) == sorted([base, "alone " * 9, "other words here"])
