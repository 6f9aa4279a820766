"""Every registered query against its DuckDB equivalent on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from bitextry.suite.registry import ORACLES, QUERIES

SF_DIR = entry_points.SMOKE_DIR
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"create view {file.removesuffix('.parquet')} as from '{SF_DIR}/{file}'")
    return connection


def comparable(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("null" if v is None or v != v else str(v) for v in row) for row in frame.itertuples(index=False))


def test_every_query_has_sql_or_its_own_tests():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF_DIR).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert comparable(ours) == comparable(theirs)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
