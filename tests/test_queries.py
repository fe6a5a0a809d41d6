"""Every registered query of the library against its SQL twin, and literal cases that the bundled tables lack."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from litengine import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in Q.load()[0]]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(repr([plain(r[k]) for k in order]) for r in records)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in Q.ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
