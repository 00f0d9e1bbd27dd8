import numpy as np

from codexferry.llm import caps


def brute(rows, cosine=0.95):
    n = len(rows)
    links = np.zeros(n, int)
    part = list(range(n))
    good = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, x in good.items():
        for j, y in good.items():
            if i < j and len(x) == len(y):
                x1, y1 = x / np.abs(x).max(), y / np.abs(y).max()
                if x1 @ y1 / np.linalg.norm(x1) / np.linalg.norm(y1) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    part[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, int(links[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def vectors():
    draw = np.random.default_rng(2)
    out = []
    for _ in range(40):
        base = draw.standard_normal(16)
        out.append(base)
        for _ in range(draw.integers(0, 6)):
            out.append(base + draw.standard_normal(16) * draw.choice([0.05, 0.1, 0.2]) )
    return [v.astype(np.float32).tolist() for v in out]


def run(spark, rows):
    df = spark.createDataFrame([(d, v, "x", 1) for d, v in rows], "vec_id long, embedding array<float>, class string, size int")
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in caps.near_vectors(df).collect()), key=str)


def test_matches_brute_force(spark, monkeypatch):
    rows = list(enumerate(vectors(), 1))
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] * 16), (505, [1e30] * 16), (506, [1e-30] * 16)]
    rows += [(507, rows[0][1][:8]), (508, rows[0][1][:8]), (None, rows[3][1]), (3, rows[9][1]), (600, rows[5][1]), (601, rows[5][1]), (None, [1.0])]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(caps, "BLOCK", 3)
    assert run(spark, rows) == brute(rows)


def test_recall_at_the_threshold(spark):
    draw = np.random.default_rng(9)
    k, z = caps.plan(50_000, 0.95)
    missed, total = 0, 3000
    a = draw.standard_normal((total, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = draw.standard_normal((total, 64))
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * noise
    left, right = caps.decode(a, k, z), caps.decode(b, k, z)
    missed = sum(not np.intersect1d(x, y).size for x, y in zip(left, right))
    assert missed / total < 0.005
    print(k, z, np.mean([len(x) for x in left]), missed)


def test_empty_table(spark):
    assert run(spark, []) == []
