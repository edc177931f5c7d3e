"""Every registered query against its SQL equivalent in another engine."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from compare import differences
from stationdays.checks.oracle import ORACLE_SQL
from stationdays.checks.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WITHOUT_SQL = {"file_manifest", "column_scan_cost"}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql_but_these():
    assert set(QUERIES) - set(ORACLE_SQL) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, tables, name):
    result = entry_points.queries()[name](spark, SMALL)
    assert differences(result, tables, entry_points.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql(spark, name):
    assert entry_points.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() == 7
