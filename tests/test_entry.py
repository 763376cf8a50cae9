"""The other queries stay when the text package cannot be imported."""

import __spark_entry__ as entry


def test_a_missing_library_leaves_the_other_queries(monkeypatch):
    whole = entry.queries()

    def broken(name):
        raise ModuleNotFoundError("No module named 'tiktoken'")

    monkeypatch.setattr(entry, "import_module", broken)
    left = entry.queries()
    assert len(left) >= 138 and set(left) <= set(whole) and set(entry.oracle_sql()) <= set(left)
