"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerlens.plans import analytics, files, reports, samples, search, stores

SF = "/root/testdata/sf0.001"
ALL = search.QUERIES | analytics.QUERIES | reports.QUERIES | samples.QUERIES | stores.QUERIES | files.QUERIES
SQL = search.SQL | analytics.SQL | reports.SQL | samples.SQL | stores.SQL | files.SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    show = lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    got = ALL[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
