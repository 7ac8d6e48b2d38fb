"""Every query with SQL against DuckDB, on the smallest tables where they are there."""

import os
from pathlib import Path

import pytest

from spoglio import catalog

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
SQL = catalog.oracle_sql()


def flat(rows):
    def one(v):
        if v is None or v != v:
            return "-"
        if isinstance(v, float):
            return repr(round(v, 9)) if v != int(v) else str(int(v))
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, str(SMALL))
    columns = sorted(df.columns)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert flat([tuple(r) for r in df.select(columns).collect()]) == flat([tuple(r[i] for i in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, str(SMALL)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["case_doc_id", "casefile_id", "relative_path", "first_path"]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.basename(e.__file__) == "__spark_entry__.py"
