"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.compare import TABLES, normalised

SQL = E.oracle_sql()
OWN = {name for topic in E.TOPICS if topic.__name__.startswith("checks.") for name in topic.QUERIES}


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(E.queries())
    assert OWN - set(SQL) == {"zip_regression"}


@pytest.mark.parametrize("name", sorted(OWN & set(SQL)))
def test_query_equals_sql(spark, sf, con, name):
    mine = E.queries()[name](spark, sf).toPandas()
    other = con.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    a, b = normalised(mine), normalised(other)
    assert len(a) == len(b) and len(a) > 0
    assert a.equals(b)


def test_entry(spark):
    assert E.entry(spark).columns == ["series", "date", "em", "mif_cum"]
