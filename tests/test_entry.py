import importlib
import sys

import pytest

import __spark_entry__
from visigraph.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert registry.FLAGSHIP in registry.QUERIES


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, name):
    import duckdb

    got = registry.QUERIES[name](spark, SF)
    rows = [tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(str(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()]
    assert sorted(names) == sorted(got.columns) and sorted(rows) == sorted(want)


def test_without_the_optional_modules(monkeypatch):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("visigraph.llm"):
                raise ModuleNotFoundError(name=name)

    for name in [m for m in sys.modules if m.startswith("visigraph.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    alone = importlib.reload(__spark_entry__)
    assert set(alone.queries()) == set(registry.QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
