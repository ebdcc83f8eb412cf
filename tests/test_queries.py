"""Every registered query with SQL equals DuckDB on the two smallest sets of tables."""

import os

import duckdb
import pytest

from quern import catalog

SF = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module", params=SF)
def tables(request):
    con = duckdb.connect()
    for f in os.listdir(request.param):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{request.param}/{f}'")
    return request.param, con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda v: "null" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df.where(df.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, tables, name):
    sf, duck = tables
    got, wanted = catalog.queries()[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF[0]).count() > 0
