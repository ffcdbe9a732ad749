"""Every registered query next to its DuckDB statement, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracles import TABLES, canonical
from workload import registry

FOLDER = "/root/testdata/sf0.001"
NAMES, ORACLES = registry.queries(), registry.oracles()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_statement_has_its_query():
    assert set(ORACLES) <= set(NAMES) <= set(QUERIES)
    assert set(NAMES) - set(ORACLES) == set()


@pytest.mark.parametrize("name", sorted(NAMES))
def test_same_result(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, rows) == canonical(columns, cur.fetchall())


def test_entry(spark):
    assert E.entry(spark).count() == 200
