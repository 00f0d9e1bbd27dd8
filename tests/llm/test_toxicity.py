import zlib

import numpy as np
from pyspark.sql import functions as F

from codexferry.llm import queries, toxicity


def brute(model, places, weights, without=-1):
    q = np.zeros(len(model.terms))
    q[places] = weights
    found = []
    for i in range(len(model.labels)):
        a, b = model.starts[i], model.starts[i + 1]
        cosine = float(q[model.places[a:b]] @ model.weights[a:b])
        if cosine > 0 and i != without:
            found.append((-round(cosine, 12), i))
    return sorted(found)[: toxicity.NEAREST]


def random_model(seed, n=700, terms=60):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(1, 6, n)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    places = np.concatenate([np.sort(draw.choice(terms, k, replace=False)) for k in lengths])
    weights = draw.choice([1.0, 2.0, 3.0], len(places))
    weights = toxicity.unit(np.repeat(np.arange(n), lengths), weights, n)
    return toxicity.Model([str(i) for i in range(terms)], np.ones(terms), starts, places, weights, draw.integers(0, 2, n).astype(float), np.arange(n), 0.5)


def test_block_max_search_is_exact():
    model = random_model(1)
    for i in range(0, 700, 7):
        own = slice(model.starts[i], model.starts[i + 1])
        at, cosines = model.nearest(model.places[own], model.weights[own], without=i)
        wanted = brute(model, model.places[own], model.weights[own], without=i)
        assert at.tolist() == [k for _, k in wanted]
        assert np.allclose(cosines, [-c for c, _ in wanted])


def test_sums_by_term_are_exact():
    draw = np.random.default_rng(5)
    model, n = random_model(2, n=1500, terms=300), 1500
    for i in range(0, n, 50):
        places = np.sort(draw.choice(300, draw.integers(1, 40), replace=False))
        weights = draw.choice([0.1, 0.2, 0.3], len(places))
        for at, cosines in (model.nearest(places, weights, without=i), model._summed(places, weights, i)):
            wanted = brute(model, places, weights, without=i)
            assert at.tolist() == [k for _, k in wanted]
            assert np.allclose(cosines, [-c for c, _ in wanted])


def test_few_labelled_rows_still_give_terms(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.toxicity_model(docs, spark, sf)
    assert len(model.terms) > 0 and len(model.labels) > 0
    assert any(r["evidence"] for r in toxicity.score(docs, model).collect())


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op5_nearest_toxicity(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(found) == docs.count()
    held = found["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)
    assert (held == found["held_out"]).all()
    assert ((found["score"] >= 0.5) == (found["predicted"] == 1)).all() and found["score"].between(0, 1).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = found[found["held_out"]].merge(labels, on="doc_id")
    hit = both[both["toxic"] == 1]["predicted"].mean()
    wrong = both[both["toxic"] == 0]["predicted"].mean()
    assert hit > 0.85 and wrong < 0.01, (hit, wrong)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, t, "x", 0) for i, t in [(1, None), (2, ""), (None, "bad bad"), (4, "bad good"), (4, "bad good"), (5, "bad " * 50_000)]],
        "doc_id long, text string, ref string, toxic int",
    )
    train = F.lit(True)
    for rows in ([], [(4, 1)], [(4, None), (5, 7), (None, 1), (99, 1)], [(4, 1), (4, 0), (5, 0), (2, 0), (1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        found = toxicity.score(docs, toxicity.fit(docs, labels, train)).collect()
        assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels, train)).count() == 0


def test_the_driver_gives_back_what_a_model_was_made_from(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good w{i % 3}" if i % 2 else f"bad w{i % 3}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(40)], "doc_id long, toxic long")
    called = []
    monkeypatch.setattr(toxicity, "give_back", lambda: called.append(1))
    toxicity.fit(docs, labels, F.lit(True))
    assert called
