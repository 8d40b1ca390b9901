"""Every registered query runs on the smallest data, and agrees with its SQL where it has one."""

import os

import duckdb
import pytest

from cairn.plans.queries import ORACLES, QUERIES
from conftest import DATA

SF = DATA / "sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(rows, columns, names):
    at = [names.index(c) for c in columns]
    return sorted(tuple(repr(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(SF))
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        rel = con.sql(ORACLES[name])
        columns = sorted(df.columns)
        assert columns == sorted(rel.columns)
        assert plain(rows, columns, df.columns) == plain(rel.fetchall(), columns, rel.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
