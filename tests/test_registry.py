import importlib.util
import sys

import __spark_entry__ as entry


def test_missing_subpackage_leaves_the_core(monkeypatch):
    import ephysloom

    entry.queries()
    for m in [m for m in sys.modules if m.startswith("ephysloom.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.delattr(ephysloom, "llm", raising=False)
    real = sys.meta_path[:]

    class Hide:
        def find_spec(self, name, path=None, target=None):
            if name == "ephysloom.llm":
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Hide(), *real])
    assert "p1_found" in entry.queries()


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_registered():
    assert "flagship_timing" in entry.queries()
    assert importlib.util.find_spec("bench")
