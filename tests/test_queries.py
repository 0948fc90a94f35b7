"""Every registered query against its SQL oracle on the smallest given tables."""

import math
import os

import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def text(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, engine):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted(tuple(text(row[c]) for c in columns) for row in df.collect())
    if name not in ORACLES:
        assert found
        return
    cursor = engine.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(tuple(text(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert found == expected


def test_entry(spark):
    assert entry_module.entry(spark).columns[:2] == ["primary_object_id", "secondary_object_id"]
