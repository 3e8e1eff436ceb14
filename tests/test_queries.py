"""Every registered query of the reference operators against its SQL in DuckDB, on the smallest tables."""

import importlib
import math
import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")

DIR = "/root/testdata/sf0.001"

from graphloom.plans import adapters  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else repr(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(adapters.queries()))
def test_equals_sql(spark, tables, name):
    df = adapters.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = adapters.oracle_sql().get(name)
    assert sql is not None
    res = tables.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)


def test_markup_props_of_shared_nations(spark, tmp_path):
    """On the smallest tables each supplier has a nation of its own, so there are no properties there."""
    own = duckdb.connect()
    own.execute(f"COPY (SELECT CAST(k AS BIGINT) AS s_suppkey, CAST(k % 2 AS INTEGER) AS s_nationkey FROM range(1, 7) r(k)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    got = [(r["prop"], r["value"], r["value_is_expression"]) for r in adapters.queries()["markup_props"](spark, str(tmp_path)).collect()]
    own.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    want = own.execute(f"SELECT prop, value, value_is_expression FROM ({adapters.oracle_sql()['markup_props']})").fetchall()
    assert len(want) == 8 and sorted(got) == sorted(want)


def test_entry_and_absent_corpus_operators(spark, monkeypatch):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
    for name in [m for m in sys.modules if m.startswith(("graphloom.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "graphloom.llm", None)
    without = importlib.reload(e)
    assert set(without.queries()) == set(adapters.queries())
    monkeypatch.undo()
    importlib.reload(e)
