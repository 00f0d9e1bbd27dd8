import hashlib
import re

from pyspark.sql import functions as F

from codexferry.llm import exact
from codexferry.llm import queries as Q

TEXTS = [
    "a b", "a  b", "a\tb", "a\n\x0b\x0c\r b", " a b", "a b ", "A b", "", None, " ", "\n\n", "a\u00a0b", "x" * 50_000, "x" * 50_000 + " ",
    "x" * 49_999 + "y", "é  ü", "é ü", "a\x00b", "ab",
]


def brute(rows):
    reads = [re.sub("[\\x20\\x09-\\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (k, _), t in zip(rows, reads, strict=True):
        keys = [key for (key, _), other in zip(rows, reads, strict=True) if other == t]
        least = min((x for x in keys if x is not None), default=None)
        out.append((k, least, len(keys), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(k, t, 1, "s", "n") for k, t in rows], "doc_id long, text string, hash int, keep string, row string")
    return exact.exact_groups(df, **options).collect()


def checked(got, rows):
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_matches_brute_force(spark):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS * 2)]
    rows += [(None, "a b"), (None, "alone"), (None, "alone"), (7, "twice"), (7, "twice"), (8, "copy")] + [(1000 + i, "copy") for i in range(300)]
    checked(found(spark, rows), rows)


def test_texts_that_share_a_hash_are_told_apart_by_their_bytes(spark):
    rows = [(i, f"{w} {i % 3}") for i, w in enumerate(["one", "two", "tree"] * 12)] + [(None, "one 0"), (90, "one 0"), (91, "last")]
    weak = lambda text: F.substring(text, 1, 1)
    checked(found(spark, rows, hashed=weak), rows)
    checked(found(spark, rows, hashed=lambda text: F.lit(1)), rows)


def test_hashes_that_are_too_many_to_be_sent(spark, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_KEYS", 0)
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    checked(found(spark, rows), rows)


def test_empty_table_and_one_row(spark):
    assert found(spark, []) == []
    checked(found(spark, [(None, None)]), [(None, None)])


def test_rows_that_stay_keep_all_columns(spark):
    rows = [(3, "a  b", 1, "p"), (2, "a b", 2, "q"), (2, "a b", 3, "r"), (None, "c", 4, "s"), (None, "c", 5, "t"), (9, None, 6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, hash string")
    got = exact.deduplicated(df)
    assert got.columns == df.columns
    left = got.collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id) == [(2, "a b"), (9, None)]
    assert [r.text for r in left if r.doc_id is None] == ["c"] and len(left) == 3
    assert exact.deduplicated(df.limit(0)).collect() == []


def test_runs_without_python_workers(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = Q.op13_exact_dedup(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
