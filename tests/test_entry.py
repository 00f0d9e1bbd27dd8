"""The entry point with and without its optional part."""

import sys
import warnings

import __spark_entry__ as entry
from codexferry.bindings import load


def test_every_twin_has_a_query():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


def test_the_core_does_not_need_the_optional_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert set(entry.queries()) == set(load()[0]) and set(entry.oracle_sql()) == set(load()[1])
