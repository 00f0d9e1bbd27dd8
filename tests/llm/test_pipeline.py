import zlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from codexferry.llm import bpe, neardup, queries
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_neardup import brute as brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the output of each stage over the smallest tables, some odd rows added."""
    from codexferry.storage import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (-1, "", "en", "x", 0), (None, "one of its kind here", "en", "x", 20)]
    odd += [tuple(docs.where("n_chars > 200").first())] * 2
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    docs = docs.unionByName(docs.limit(3))
    found = [materialize(docs)]
    for _, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], SF)))
    return [(f.columns, f.collect()) for f in found], docs.columns


def rows(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame[1]), key=str)


def test_columns_stay_until_the_last_stage(stages):
    found, columns = stages
    assert all(c == columns for c, _ in found[:-1])
    assert found[-1][0] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_toxicity_drops_what_it_scores(spark, stages):
    found, _ = stages
    docs = spark.createDataFrame(rows(found[0]), "doc_id long, text string")
    from codexferry.llm import toxicity

    model = queries.toxicity_model(docs, spark, SF)
    left = [tuple(r) for r in toxicity.score(docs.withColumnRenamed("text", "t"), model, text="t").where("predicted = 0").select("doc_id").collect()]
    assert sorted(d for d, _ in rows(found[1]) if d is not None) == sorted(d for (d,) in left if d is not None)
    assert len(left) == len(found[1][1])


def test_one_row_of_each_group(stages):
    found, _ = stages
    before, after = rows(found[1]), rows(found[2])
    groups = brute_groups(before, 5)
    with_words = [g for g in groups if g[1]]
    keys = {g[2] for g in with_words if g[2] is not None}
    kept = [d for d, t in after if neardup_words(t)]
    assert sorted(d for d in kept if d is not None) == sorted(keys)
    assert sum(d is None for d in kept) == len({t for d, t in before if d is None and neardup_words(t)})
    assert sum(not neardup_words(t) for _, t in after) == sum(not neardup_words(t) for _, t in before)


def neardup_words(text):
    return bool((text or "").split())


def test_leaking_documents_go(spark, stages):
    found, _ = stages
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    few = [(d, t) for d, t in rows(found[2]) if t is None or len(t) < 1500]
    bad = {d for d, _ in brute_leaks(few, items)}
    left = {d for d, _ in rows(found[3])}
    assert all((d in left) == (d not in bad) for d, _ in few)


def test_texts_are_replaced_and_encoded(stages):
    import hashlib

    import regex

    from codexferry.llm import pii

    found, _ = stages
    before, after = rows(found[3]), rows(found[4])
    assert len(before) == len(after)
    secrets = {m.group() for _, t in before for m in regex.finditer(pii.ANY, t or "")}
    assert secrets and not any(s in (t or "") for s in secrets for _, t in after)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.RANKS), special_tokens={})
    wanted = sorted((len(own.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in after)
    assert sorted((r["n_tokens"], r["decoded_sha256"]) for r in found[5][1]) == wanted


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
