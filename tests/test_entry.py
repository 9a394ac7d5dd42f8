"""The entry file with and without its optional parts."""

import importlib
import sys

import pytest

import __spark_entry__ as entry
from pairlake.plans import registry


@pytest.mark.parametrize("hidden", [["pairlake.llm"], ["pairlake.llm", "corpus_pipeline"], ["corpus_pipeline"]])
def test_other_queries_work_without_the_optional_parts(monkeypatch, hidden):
    for name in hidden:
        for known in [m for m in sys.modules if m == name or m.startswith(f"{name}.")]:
            monkeypatch.delitem(sys.modules, known)
        monkeypatch.setitem(sys.modules, name, None)  # importing it raises ImportError
    if "pairlake.llm" in hidden:
        monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False) if "corpus_pipeline" not in hidden else None
        import pairlake

        monkeypatch.delattr(pairlake, "llm", raising=False)
    here = importlib.reload(entry)
    found, sql = here.queries(), here.oracle_sql()
    assert set(registry.QUERIES) <= set(found) and set(registry.ORACLES) <= set(sql)
    assert "pipeline" not in found and "pipeline" not in sql
    if "pairlake.llm" in hidden:
        assert set(found) == set(registry.QUERIES) and set(sql) == set(registry.ORACLES)


def test_sql_is_for_registered_queries_only():
    assert set(entry.oracle_sql()) <= set(entry.queries())
