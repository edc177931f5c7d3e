"""What the queries over the given tables do as those grow, on small tables of their own."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import pytest

from stationdays.checks import queries, tables
from stationdays.sources import archive

ROWS, AT_ONCE = 600, 100


@pytest.fixture
def orders(spark, tmp_path):
    """The folder of a table of orders of two years, three of each customer and year."""
    spark.range(ROWS, numPartitions=3).selectExpr(
        "id AS o_orderkey",
        "id DIV 6 AS o_custkey",
        "CASE WHEN id % 2 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus",
        "1000.0D + id AS o_totalprice",
        "date_add(make_date(CAST(1996 + id % 2 AS INT), 1, 1), CAST(id % 300 AS INT)) AS o_orderdate",
        "'5-LOW' AS o_orderpriority",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def archived(spark, folder: str) -> tuple[Counter, list[int]]:
    """Stations and dates of all rows, and the number of rows of each archive."""
    found = Counter(
        (r["STATION"], r["DATE"], r["year"]) for r in archive.read_archives(spark, folder).collect()
    )
    each = [
        archive.read_archives(spark, str(part)).where(f"year = {path.name[:4]}").count()
        for part in Path(folder).iterdir() for path in part.iterdir()
    ]
    return found, each


def test_odd_archives_are_of_bounded_size(spark, orders):
    rows = tables.order_text_rows(spark, orders)
    tables.write_odd_archives(rows, f"{orders}/headers", AT_ONCE)
    found, each = archived(spark, f"{orders}/headers")
    assert found == Counter((r["STATION"], r["DATE"], r["year"]) for r in rows.collect())
    assert sum(each) == ROWS and max(each) <= AT_ONCE


def test_archives_with_odd_records_are_of_bounded_size(spark, orders):
    rows = tables.order_text_rows(spark, orders, "o_orderkey AS number")
    tables.write_archives_with_odd_records(rows, f"{orders}/records", AT_ONCE)
    found, each = archived(spark, f"{orders}/records")
    assert found == Counter((r["STATION"], r["DATE"], r["year"]) for r in rows.collect())
    assert sum(each) == ROWS and max(each) <= AT_ONCE


def test_rows_without_a_station_have_no_member(spark, orders):
    rows = tables.order_text_rows(spark, orders, "o_orderkey AS number")
    some = rows.selectExpr("* EXCEPT (STATION)", "nullif(STATION, lpad('1', 11, '0')) AS STATION")
    tables.write_archives_with_odd_records(some, f"{orders}/records", AT_ONCE)
    assert sum(archived(spark, f"{orders}/records")[0].values()) == ROWS - 6


def test_files_of_ranges_grow_in_number(spark, orders, monkeypatch):
    folder = Path(orders) / "csv"
    monkeypatch.setattr(queries, "scratch_folder", lambda spark, purpose: str(folder))
    monkeypatch.setattr(queries, "ROWS_PER_ARCHIVE", AT_ONCE, raising=False)
    assert queries.csv_ranges_scan(spark, orders).count() == ROWS
    # at the most as many rows in a task as a part has
    assert len(list(folder.glob("year=1996/*.csv"))) > 2


@pytest.mark.parametrize("key, kind", [(7, "bigint"), (2**62, "decimal(38,0)")])
def test_scan_cost_beyond_longs(spark, tmp_path, key, kind):
    spark.createDataFrame(
        [(key, "A"), (key, "A"), (key - 1, "R")], "l_orderkey long, l_returnflag string"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    result = queries.scan_cost_arithmetic(spark, str(tmp_path))
    assert dict(result.dtypes)["all_columns_bytes"] == kind
    row = result.first()
    assert Decimal(row["all_columns_bytes"]) == (3 * key - 1) * 100_000
    assert Decimal(row["named_columns_bytes"]) == 2 * key * 100_000
    assert Decimal(row["bytes_saved"]) == (key - 1) * 100_000
