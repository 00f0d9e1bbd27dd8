import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexferry.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, anchor int, down int"


def brute(rows, wanted, count=5, low=80):
    good = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.append((key, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for i, (a, x, label) in enumerate(good):
        if not wanted(a):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), b, j, other) for j, (b, y, other) in enumerate(good) if b != a and len(x) == len(y)]
        scored.sort()
        for s, p, _, _ in [t for t in scored if t[3] == label][:count]:
            fits = [t for t in scored if t[3] != label and low * -s <= -100 * t[0] <= 100 * -s][:count]
            out += [(a, p, rank, t[1], -s, -t[0]) for rank, t in enumerate(fits, 1)]
    return Counter(out)


def run(spark, rows, wanted=lambda c: c % 3 == 0, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return Counter(tuple(r) for r in negatives.hard_negatives(df, anchors=wanted(F.col("vec_id")), **options).collect())


def vectors(n, length, seed=1, groups=4):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((groups, length))
    out = []
    for i in range(n):
        x = centres[draw.integers(groups)] + 0.7 * draw.standard_normal(length)
        out.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist(), int(draw.integers(3))))
    return out


def test_products_are_exact():
    draw = np.random.default_rng(3)
    for length, size in ((1, 2), (64, 256), (65, 2**15), (700, 2**20), (3, 2**28)):
        a, b = (draw.integers(-size, size + 1, (20, length)) for _ in range(2))
        a[0], b[0], b[1] = size, size, -size
        want = [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b] for x in a]
        moduli = negatives.primes(length * size * size)
        assert negatives.products(a, b, moduli).tolist() == want
        assert max(moduli) // 2 <= negatives.LARGEST and negatives.RUN * (max(moduli) // 2) ** 2 < 2**24
        assert all(p % q for p in moduli for q in range(2, p))


@pytest.mark.parametrize("blocks", [(2048, 2048, 32 << 20), (7, 16, 8 * 12 * 30)])
def test_matches_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("TILE", "LEAST_ROWS", "MOST_BYTES"), blocks, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(120, 12)
    ties = [(1000 + i, rows[5][1], i % 2) for i in range(9)] + [(60, rows[5][1], 1), (60, rows[5][1], 1), (61, rows[60][1], 0), (-3, rows[8][1], 0)]
    odd = [
        (None, rows[1][1], 1), (300, None, 1), (303, rows[3][1], None), (306, [None] * 12, 1), (309, [float("nan")] * 12, 1), (312, [float("inf")] + [0.0] * 11, 1),
        (315, [], 1), (318, [], 2), (321, [], 1), (324, [0.0] * 12, 1), (327, [0.5, -0.25], 0), (330, [0.5, -0.3], 0), (331, [0.4, -0.2], 1), (333, [-x for x in rows[0][1]], 5),
    ]
    rows += ties + odd
    assert run(spark, rows) == brute(rows, lambda k: k % 3 == 0)


def test_large_components_and_other_limits(spark):
    rows = [(i, [x * 4000 for x in v], c) for i, v, c in vectors(60, 70, seed=5)]
    assert run(spark, rows, positives=2, negatives=3, low=50) == brute_limits(rows)
    with pytest.raises(ValueError, match="60 bits"):
        run(spark, [(0, [1e30], 1), (1, [1.0], 2)])


def brute_limits(rows):
    wide = brute(rows, lambda k: k % 3 == 0, count=10**9, low=50)
    first = {}
    for a, p, _, _, s, _ in wide:
        first.setdefault(a, set()).add((-s, p))
    # A positive without negatives counts among the first as well.
    value = {k: [math.floor(256 * float(np.float32(x))) for x in v] for k, v, _ in rows}
    label = {k: c for k, _, c in rows}
    own = {a: sorted((-int(np.dot(value[a], value[b])), b) for b in value if b != a and label[a] == label[b])[:2] for a in first}
    return Counter({t: n for t, n in wide.items() if t[2] <= 3 and (-t[4], t[1]) in own[t[0]]})


def test_empty_tables(spark):
    assert not run(spark, [])
    assert not run(spark, [(1, [1.0], 1)])
    assert not run(spark, [(3, None, 1)])
