"""Every query of the core against its SQL, on the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph import operators  # noqa: F401

CORE = {k for m in entry._MODULES for k in __import__(m, fromlist=["QUERIES"]).QUERIES}


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for name in os.listdir(small):
        c.sql(f"create view {name.split('.')[0]} as select * from '{small}/{name}'")
    return c


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(CORE & set(entry.oracle_sql())))
def test_query_equals_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    names = sorted(df.columns)
    sql = duck.sql(entry.oracle_sql()[name])
    assert sorted(sql.columns) == names
    at = [sql.columns.index(n) for n in names]
    assert Counter(tuple(plain(r[n]) for n in names) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


def test_flagship(spark, small):
    assert entry.entry(spark).columns[:4] == ["fact", "source", "target", "edge_type"]


def test_names_and_oracles_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
