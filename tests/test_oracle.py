"""Every query with oracle SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from loomfold.plans import registry
from tests.conftest import SMALL
from tools_compare import TABLES, rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), db.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


#: Whose rounded means, ties or whole lists tell more on larger tables.
LARGER = ("A29", "J11", "J17", "X12", "X10", "F14", "JS03")


@pytest.mark.parametrize("name", LARGER)
def test_same_rows_on_larger_tables(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    assert rows(QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()) == rows(con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
