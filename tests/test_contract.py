"""The driver's contract: every query runs, and gives the rows of its SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
import __spark_entry__ as entry_module  # noqa: E402
from pagewright import queries as core  # noqa: E402


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, small, name):
    df = entry_module.queries()[name](spark, small)
    columns = sorted(df.columns)
    rows = [rounded(r[c] for c in columns) for r in df.collect()]
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted((rounded(r[i] for i in at) for r in cursor.fetchall()), key=key)


def test_entry(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("test tables are not here")
    assert entry_module.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
