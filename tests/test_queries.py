"""Every registered query runs; every oracle query matches DuckDB (sf0.001)."""

import math

import duckdb
import pytest

import __spark_entry__ as ENTRY
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES = ENTRY.queries()
ORACLE = ENTRY.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_entry(spark):
    df = ENTRY.entry(spark)
    assert df.columns and df.count() >= 0


def test_every_query_has_a_docstring():
    assert all(fn.__doc__ for fn in QUERIES.values())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert cols
        return
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    orows = [tuple(r[ocols.index(c)] for c in cols) for r in res.fetchall()]
    assert len(rows) == len(orows)
    assert _rows(cols, rows) == _rows(cols, orows)
