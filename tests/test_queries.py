"""Every query with SQL against DuckDB on the same files: names, row counts and values."""

import os
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from rowloom.queries import ORACLES, QUERIES

SF = os.environ.get("ROWLOOM_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted([plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert table(got.columns, got.collect()) == table(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_the_entry_points_name_every_query(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["pos", "l_orderkey", "l_extendedprice"]
