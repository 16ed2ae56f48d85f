"""Every registered query against its SQL on DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from parley.plans.oracle import ORACLE
from parley.plans.queries import QUERIES
from tests.conftest import SF_DIR

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
    "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def rounded(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    frame = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    got = sorted([tuple(rounded(r[c]) for c in columns) for r in frame.collect()], key=repr)
    cursor = duck.execute(entry_points.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert {f.name: TYPES[f.dataType.simpleString()] for f in frame.schema} == kinds
    order = [names.index(c) for c in columns]
    want = sorted([tuple(rounded(r[i]) for i in order) for r in cursor.fetchall()], key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 20
