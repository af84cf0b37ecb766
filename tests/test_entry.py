"""The entry module with and without the training-data subpackage."""

import sys

import __spark_entry__ as entry
from chirplake.plans import registry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("chirplake.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "chirplake.llm", None)
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLES)
