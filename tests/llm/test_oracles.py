"""The queries with SQL against DuckDB: on the test tables, and on odd rows."""

import os

import duckdb
import pytest

from rowloom.llm.queries import ORACLES, QUERIES

SF = os.environ.get("ROWLOOM_SF", "/root/testdata/sf0.001")


def compared(spark, name, folder):
    con = duckdb.connect()
    path = f"{folder}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.execute(ORACLES[name])
    names = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(n) for n in names]
    got = QUERIES[name](spark, str(folder))
    assert sorted(got.columns) == names
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    compared(spark, name, SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql_on_odd_rows(spark, make, odd_rows, tmp_path, name):
    rows = [(i * 50, t) for i, (_, t) in enumerate(odd_rows)]  # SQL has the rows' ids apart; every other one is a query
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    compared(spark, name, tmp_path)
