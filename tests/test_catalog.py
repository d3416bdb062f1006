"""Every registered query with SQL gives the rows DuckDB gives."""

import duckdb
import pytest

from catalog.oracles import ORACLES
from catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def cell(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return str(value)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    cursor = duck.execute(ORACLES[name])
    described = {column[0]: str(column[1]) for column in cursor.description}
    assert columns == sorted(described)
    assert {c: TYPES[t] for c, t in result.dtypes} == described
    order = [list(described).index(column) for column in columns]
    expected = sorted(tuple(cell(row[i]) for i in order) for row in cursor.fetchall())
    assert sorted(tuple(cell(row[column]) for column in columns) for row in result.collect()) == expected
