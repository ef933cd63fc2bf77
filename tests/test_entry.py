"""Every registered query against its SQL on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the tables are not there")


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_equals_sql(spark, database, name):
    frame = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(frame.columns)
    answer = database.execute(entry.ORACLE_SQL[name])
    theirs = [c[0] for c in answer.description]
    assert sorted(theirs) == columns
    places = [theirs.index(c) for c in columns]
    expected = sorted((tuple(_plain(r[i]) for i in places) for r in answer.fetchall()), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).columns == ["averageTemperature", "count"]


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLE_SQL)
    assert set(entry.QUERIES) <= set(entry.queries())
