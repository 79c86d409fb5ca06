"""Every registered query with an oracle against DuckDB on the smallest tables; every other one runs and has a stable schema."""

import math

import duckdb
import pytest

from corpusloom.plans import registry
from corpusloom.sources.tables import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def in_order(rows, columns, wanted):
    return sorted(tuple(plain(r[columns.index(c)]) for c in wanted) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_duckdb(spark, db, name):
    df = registry.QUERIES[name](spark, FOLDER)
    want = db.execute(registry.ORACLE[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert in_order(df.collect(), df.columns, sorted(columns)) == in_order(rows, columns, sorted(columns))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_without_oracle(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
