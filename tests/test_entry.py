import importlib


def test_entry_and_names(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_training_operators(monkeypatch):
    """The other queries are there when the llm folders are gone."""
    entry = importlib.import_module("__spark_entry__")
    find = importlib.util.find_spec
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name, *a: None if "llm" in name or name == "corpus_pipeline" else find(name, *a))
    names = set(entry.queries())
    assert "bm25_search" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
