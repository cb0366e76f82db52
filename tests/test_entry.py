import importlib.util
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


def entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", Path(__file__).parent.parent / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_sql_belongs_to_queries():
    e = entry_module()
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship_and_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    e = entry_module()
    assert e.entry(spark).columns == ["qid", "rank", "doc_id", "score"]
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    queries, sql = e.queries(), e.oracle_sql()
    for name in ("x1_exact_l2", "v5_search", "q7_search", "h5_search", "m14_evaluate_per_query", "m11_interpolated", "l3_tfidf", "rel_positions"):
        df = queries[name](spark, str(DATA))
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
        want = sorted(map(repr, con.execute(f"SELECT {', '.join(columns)} FROM ({sql[name]})").fetchall()))
        assert got == want, name


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_every_query_of_the_core_agrees_with_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import quillvec.queries as core

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    queries, sql = entry_module().queries(), core.oracle_sql()
    differ = []
    for name in sql:
        df = queries[name](spark, str(DATA))
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
        if got != sorted(map(repr, con.execute(f"SELECT {', '.join(columns)} FROM ({sql[name]})").fetchall())):
            differ.append(name)
    assert not differ


def test_a_failing_subpackage_leaves_the_core(monkeypatch):
    import sys

    import quillvec

    module = entry_module()
    monkeypatch.setitem(sys.modules, "quillvec.llm", None)  # its import raises ImportError
    monkeypatch.delattr(quillvec, "llm", raising=False)
    assert module.queries() and not any(k.startswith("p1_") for k in module.queries())
