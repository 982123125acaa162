import sys

import pytest

import __spark_entry__ as entry


def test_corpus_queries_are_registered():
    names = set(entry.queries())
    assert {"p3_found", "p6_found", "p8_found", "p9_found"} <= names
    for prefix in ("p5_", "p7_"):
        assert any(n.startswith(prefix) for n in names)


def test_missing_queries_module_is_an_error(monkeypatch):
    import ephysloom.llm as llm

    monkeypatch.delattr(llm, "queries", raising=False)
    monkeypatch.setitem(sys.modules, "ephysloom.llm.queries", None)
    with pytest.raises(ImportError):
        entry.queries()
