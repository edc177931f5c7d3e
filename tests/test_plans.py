"""What Spark makes of the queries: what is read, pruned, shuffled and joined."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import pytest
from conftest import station_file, write_archive
from pyspark.sql import functions as F

from stationdays.checks.queries import QUERIES
from stationdays.checks.tables import order_text_rows
from stationdays.operators import bootstrap, distinct, panel, questions
from stationdays.plans import jobs
from stationdays.schema import EVENT_FLAGS
from stationdays.sources import archive, files, ingest, warehouse

SMALL = "/root/testdata/sf0.001"
# these hand rows to Python on purpose: files Spark cannot read, draws, or to compare
PYTHON = {"archive_roundtrip", "archive_odd_headers", "archive_odd_records",
          "archives_of_some_years", "csv_ranges_scan", "csv_quoted_scan", "csv_header_binding", "bootstrap_ci_blocks",
          "bootstrap_block_invariants", "nation_file_manifest",
          "pushdown_arms_agree", "column_scan_cost", "file_manifest"}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("plans") / "table")
    warehouse.write_observations(ingest.to_observations(order_text_rows(spark, SMALL)), folder)
    return warehouse.open_observations(spark, folder, view=None)


def plan(frame, mode: str = "simple") -> str:
    """The physical plan before execution, as explain() prints it."""
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain(mode)
    return out.getvalue()


def read_columns(frame) -> list[set[str]]:
    """The columns each scan of the plan reads (partition columns are not read)."""
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan(frame, "formatted"))
    return [set(re.findall(r"(\w+):", schema)) for schema in schemas]


def test_counts_read_the_flags_of_one_year(stored):
    counts = questions.event_counts(stored, 1998)
    text = plan(counts)
    assert read_columns(counts) == [set(EVENT_FLAGS)]
    assert re.search(r"PartitionFilters: \[isnotnull\(year#\d+\), \(year#\d+ = 1998\)\]", text)
    # one exchange, of one partial row per task; the six result rows are not moved again
    assert text.count("Exchange") == 1 and "Exchange SinglePartition" in text


def test_months_read_the_date_too(stored):
    months = questions.monthly_events(stored, 1998)
    assert read_columns(months) == [{*EVENT_FLAGS, "date"}]
    assert "PartitionFilters: [isnotnull(year" in plan(months)


def test_temperature_reads_two_columns_and_skips_nulls(stored):
    annual = questions.annual_temperature(stored)
    assert read_columns(annual) == [{"station", "temp_c"}]
    assert "PushedFilters: [IsNotNull(temp_c)]" in plan(annual)


def test_panel_mean_is_one_scan_without_a_join(stored):
    balanced = panel.balanced_temperature(stored)
    text = plan(balanced)
    assert "Join" not in text
    # the second scan is the subquery counting years: it reads no column at all
    assert sorted(read_columns(balanced), key=len) == [set(), {"station", "temp_c"}]
    # raw rows are aggregated before they are first moved (the plan's leaf comes last)
    assert text.rindex("partial_sum(temp_c") > text.rindex("Exchange hashpartitioning(station")


def test_coverage_is_top_k(stored):
    coverage = questions.station_coverage(stored, 1998)
    assert "TakeOrderedAndProject" in plan(coverage)
    assert read_columns(coverage) == [{"station", "name"}]


def test_ingest_is_one_projection(spark):
    text = plan(ingest.to_observations(order_text_rows(spark, SMALL)))
    assert "Exchange" not in text and "Python" not in text


def test_blocks_move_stations_once_and_draws_never(stored):
    network = bootstrap.station_network(stored)
    text = plan(bootstrap.bootstrap_draws(network, 100, stations_per_block=16))
    assert "Join" not in text and "Broadcast" not in text
    # stations to their blocks' partitions, and one partial sum per block and replicate
    assert text.count("Exchange") == 2
    assert re.findall(r"Exchange \w+\((\w+)#\d+\w*, (\d+)\)", text)[0] == ("replicate", "8")
    assert re.search(r"Exchange shufflepartitionidpassthrough\(.*16\)", text, re.IGNORECASE)


def test_panel_of_known_years_is_one_scan_and_two_shuffles(stored):
    years = sorted(r["year"] for r in stored.select("year").distinct().collect())
    for question in (panel.balanced_temperature, panel.annual_vs_balanced):
        text = plan(known := question(stored, years=years))
        assert "Join" not in text and "Window" not in text
        assert read_columns(known) == [{"station", "temp_c"}]
        assert re.findall(r"Exchange hashpartitioning\((\w+)#", text) == ["year", "station"]
        assert text.rindex("partial_sum(") > text.rindex("Exchange hashpartitioning(station")
        assert known.collect() == question(stored).collect()


def test_bitmaps_count_what_distinct_counts(spark, stored):
    index = distinct.entity_index(stored)
    bitmaps = distinct.entity_bitmaps(stored, index, ["year"])
    stats = distinct.stats_of_bitmaps(stored, bitmaps)
    assert stats.collect() == questions.table_stats(stored).select(stats.columns).collect()
    assert "Expand" not in plan(stats)
    yearly = distinct.distinct_of_bitmaps(bitmaps, ["year"], "n").orderBy("year").collect()
    expected = stored.groupBy("year").agg(F.countDistinct("station").alias("n")).orderBy("year")
    assert yearly == expected.collect()
    nothing = distinct.entity_bitmaps(stored.limit(0), index, ["year"])
    assert distinct.distinct_of_bitmaps(nothing).collect()[0][0] == 0
    # more stations than one bitmap holds, and rows without one
    many = spark.range(70_000).selectExpr("IF(id = 5, NULL, id % 69000) AS station", "id % 3 AS year")
    wide = distinct.entity_bitmaps(many, distinct.entity_index(many), ["year"])
    assert wide.select("bucket").distinct().count() == 3
    assert distinct.distinct_of_bitmaps(wide).collect()[0][0] == 69_000


def test_archives_of_a_filesystem_that_only_spark_knows(spark, tmp_path):
    for year in (2001, 2002, 2003):
        write_archive(tmp_path / "in" / f"{year}.tar.gz", {
            "a.csv": station_file({"DATE": f"{year}-01-01"}), "b.txt": b"STATION\nx\n"})
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    settings.set("fs.viewfs.mounttable.kept.link./in", f"file://{tmp_path}/in")
    folder = "viewfs://kept/in"
    plain = archive.read_archives(spark, str(tmp_path / "in"))
    assert not files.arrow_opens(folder) and files.arrow_opens(str(tmp_path))
    rows = archive.read_archives(spark, folder)
    assert rows.schema == plain.schema and sorted(rows.collect()) == sorted(plain.collect())
    chosen = archive.read_archives(spark, folder, [2001, 2003]).where("year > 2001")
    assert [r["year"] for r in chosen.collect()] == [2003]
    assert archive.read_archives(spark, folder, []).isEmpty()
    built = jobs.build_warehouse(
        spark, folder, str(tmp_path / "table"), str(tmp_path / "log"), [2002, 2003])
    assert [(r["year"], r["rows"]) for r in built.collect()] == [(2002, 1), (2003, 1)]


def test_conditions_on_the_year_choose_archives(spark, tmp_path, monkeypatch):
    for year in range(2001, 2006):
        write_archive(tmp_path / f"{year}.tar.gz", {"a.csv": station_file({"DATE": f"{year}-01-01"})})
    rows = archive.read_archives(spark, str(tmp_path))

    def kept(condition):
        found = rows.where(condition)
        years = sorted(r["year"] for r in found.collect())
        # an archive is a partition; others are not opened
        return years, found.rdd.getNumPartitions()

    assert kept("year = 2003") == ([2003], 1)
    assert kept("year > 2001 AND year <= 2003 AND year <> 2002") == ([2003], 1)
    assert kept("year IN (2001, 2005, 1999)") == ([2001, 2005], 2)
    assert kept("year >= 2004 AND STATION LIKE '555%'") == ([2004, 2005], 2)
    assert kept("NOT (year < 2005)") == ([2005], 1)
    assert kept("STATION IS NULL")[0] == [] and kept("year = NULL")[0] == []
    assert kept("year + 1 = 2003")[0] == [2002]


def test_slots_broadcast_stations_only_when_few(stored, monkeypatch):
    network = bootstrap.station_network(stored)
    assert "BroadcastExchange" in plan(bootstrap.bootstrap_draws(network, 100, 42, "slots"))
    monkeypatch.setattr(bootstrap, "BROADCAST_STATIONS", 0)
    stored.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(bootstrap.bootstrap_draws(network, 100, 42, "slots"))
    finally:
        stored.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"(SortMerge|ShuffledHash)Join \[idx", text)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "Python" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
