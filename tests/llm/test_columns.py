"""Columns of the input may have any name, also those that the operators use themselves."""

import inspect
import re

import pytest

import corpus_pipeline
from codexferry.llm import common, decontam, exact, neardup, pii, toxicity
from codexferry.llm import queries as Q

SF = "/root/testdata/sf0.001"
OWN = {"doc_id", "text", "lang", "source", "n_chars"}
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def names(*modules):
    """Everything in these modules that could be a column's name."""
    found = {x.lower(): x for m in modules for x in re.findall(r"[\"'](_?[A-Za-z]\w{0,25})[\"']", inspect.getsource(m))}
    found.update({x.lower(): x for m in modules for x in re.findall(r"\b([a-z]+_?)(?==)", inspect.getsource(m))})
    return sorted(x for x in found.values() if x.lower() not in OWN)


def rows():
    texts = [None, "", LONG, LONG + " end", LONG.upper(), "call (555) 234-5678 or Mrs Ada Lake", "call (555) 234-5678 or Mrs Ada Lake", "a  b", "a b"]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, 1)] + [(None, LONG + " last", "en", "s", 9), (3, "again", "en", "s", 5), (3, "again", "en", "s", 5)]


def near(spark, docs):
    return neardup.deduplicated(docs)


def leak(spark, docs):
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    return decontam.clean(docs, decontam.leaks(docs, items))


def toxic(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    return toxicity.clean(docs, toxicity.fit(docs, labels, Q.key_hash() % 5 != 7))


STEPS = {
    "exact": (lambda spark, docs: exact.deduplicated(docs), (exact, common)),
    "near": (near, (neardup, common)),
    "leaks": (leak, (decontam, common)),
    "pii": (lambda spark, docs: pii.pseudonymized(docs, "k"), (pii, common)),
    "toxicity": (toxic, (toxicity, common)),
}


@pytest.mark.parametrize("step", STEPS)
def test_any_other_column_passes_through(spark, step):
    run, modules = STEPS[step]
    extra = names(*modules)
    assert len(extra) > 15
    plain = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    wide = spark.createDataFrame([(*r, *(f"{x}{i}" for x in extra)) for i, r in enumerate(rows())], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{x}` string" for x in extra)]))
    got = run(spark, wide)
    assert got.columns == wide.columns
    found = got.collect()
    key = lambda r: str(tuple(r[:5]))
    assert sorted(map(key, found)) == sorted(map(key, run(spark, plain).collect()))
    for r in found:
        ends = {r[i + 5][len(x) :] for i, x in enumerate(extra)}
        assert len(ends) == 1


def test_the_stages_take_them_too(spark):
    extra = names(corpus_pipeline, common)
    docs = spark.createDataFrame([(*r, *extra) for r in rows()], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{x}` string" for x in extra)]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
