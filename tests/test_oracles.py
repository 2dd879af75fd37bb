"""Every registered query against its SQL twin on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tallyweave.plans.oracles import ORACLES
from tallyweave.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(data_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data_dir}/{table}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())


def _sortable(row):
    return tuple((value is None, value if value is not None else 0) for value in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, data_dir, name):
    found = QUERIES[name](spark, data_dir)
    columns = sorted(found.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=_sortable)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: SQL_TYPES[t] for c, t in found.dtypes} == types
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=_sortable)
    assert rows == expected
    assert rows


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
