"""Every registered query against its SQL on another engine, at the smallest scale."""

import datetime
import math

import duckdb
import pytest

from tallyloom.plans.registry import ORACLES, QUERIES
from tallyloom.sources.catalog import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    yield con
    con.close()


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "None" if isinstance(v, float) and math.isnan(v) else f"{float(v) + 0.0:.4f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat().removesuffix("T00:00:00")
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, other, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted(tuple(map(cell, r)) for r in found.select(*columns).collect())
    cursor = other.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(cell(r[k]) for k in order) for r in cursor.fetchall())
    assert len(mine) == len(theirs)
    differ = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not differ, differ[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
