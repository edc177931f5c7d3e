"""The queries of this package against their SQL, and the pipeline's stages."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from compare import differences
from stationdays.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry_points.queries())
    assert set(ORACLE_SQL) <= set(entry_points.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    connection = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = entry_points.queries()[name](spark, SMALL)
    assert differences(result, connection, ORACLE_SQL[name]) == []


def test_stages(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, SMALL)
            if name != "best_fit_packing":
                assert result.columns == docs.columns
            rows = result.count()
            assert rows == 0 if docs is empty else rows > 0
