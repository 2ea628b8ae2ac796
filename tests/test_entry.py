import __spark_entry__ as entry


def test_names_and_sql():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 60
    assert "rrf_fuse" in names


def test_core_stands_without_the_optional_package(monkeypatch):
    def missing(name):
        if name.startswith("emberlake.llm"):
            raise ModuleNotFoundError(name=name)
        return real(name)

    real = entry.importlib.import_module
    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert not any(n.startswith(("p1_", "p4_")) for n in entry.queries())
