"""Registered queries against their SQL twins on the smallest test tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
FOLDER = "/root/testdata/sf0.001"
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_twin_belongs_to_a_query():
    assert set(SQL) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 2


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = entry_module.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    tidy = lambda df: df[columns].astype(object).where(df[columns].notna(), None).sort_values(
        columns, key=lambda c: c.map(str)).values.tolist()
    left, right = tidy(got), tidy(want)
    assert left == [pytest.approx(row) if any(isinstance(v, float) for v in row) else row for row in right]
