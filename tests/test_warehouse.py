"""Stored years, manifest, reports, scan cost, and the jobs that use them."""

from __future__ import annotations

import hashlib
import json

import pyarrow.parquet as pq
import pytest
from conftest import records, station_file, write_archive
from pyspark.sql import functions as F

from stationdays.operators import pushdown, questions, scancost
from stationdays.plans import jobs
from stationdays.schema import EVENT_FLAGS
from stationdays.sources import archive, ingest, manifest, report, warehouse


def make_archives(folder, *years, temp="  50.0"):
    for year in years:
        write_archive(folder / f"{year}.tar.gz", {
            f"{s}.csv": station_file(*[
                {"STATION": s, "DATE": f"{year}-0{m}-01", "TEMP": temp, "FRSHTT": "100000"}
                for m in (1, 2)]) for s in ("a", "b", f"only{year}")})


@pytest.fixture
def folders(tmp_path):
    make_archives(tmp_path / "archives", 2023, 2024)
    return [str(tmp_path / n) for n in ("archives", "table", "manifest")]


def test_build_then_build_more(spark, folders, tmp_path):
    archives, table, log = folders
    first = records(jobs.build_warehouse(spark, archives, table, log, [2024]), "year")
    assert list(first) == [2024]
    content = (tmp_path / "archives" / "2024.tar.gz").read_bytes()
    assert first[2024]["sha256"] == hashlib.sha256(content).hexdigest()
    assert first[2024]["size_bytes"] == len(content)
    assert (first[2024]["rows"], first[2024]["stations"]) == (6, 3)
    assert first[2024]["cached"] is False and first[2024]["provenance_note"] is None

    second = jobs.build_warehouse(spark, archives, table, log, [2023])
    assert [r["year"] for r in second.collect()] == [2023, 2024]

    # what is stored is not parsed again, a changed archive or not
    make_archives(tmp_path / "archives", 2024, temp="  68.0")
    (tmp_path / "archives" / "2023.tar.gz").unlink()
    third = records(jobs.build_warehouse(spark, archives, table, log, [2023, 2024]), "year")
    assert third[2023]["sha256"] is None and third[2023]["cached"] is True
    assert third[2023]["provenance_note"] == manifest.MISSING_NOTE
    assert third[2024]["sha256"] != first[2024]["sha256"]
    stored = warehouse.open_observations(spark, table)
    assert [r["t"] for r in stored.agg(F.max("temp_c").alias("t")).collect()] == [10.0]

    # a forced year is replaced, the other one stays
    jobs.build_warehouse(spark, archives, table, log, [2024], force=True)
    stored = warehouse.open_observations(spark, table)
    assert {r["year"]: (r["n"], r["t"]) for r in stored.groupBy("year").agg(
        F.count("*").alias("n"), F.max("temp_c").alias("t")).collect()} == {
            2023: (6, 10.0), 2024: (6, 20.0)}
    assert spark.table("observations").count() == 12
    with pytest.raises(FileNotFoundError, match="1999"):
        jobs.build_warehouse(spark, archives, table, log, [1999])


def test_stored_layout(spark, folders, tmp_path):
    rows = ingest.to_observations(archive.read_archives(spark, folders[0]))
    warehouse.write_observations(rows, folders[1])
    files = sorted((tmp_path / "table").glob("year=*/*/*.parquet"))
    assert {f.parent.parent.name for f in files} == {"year=2023", "year=2024"}
    assert warehouse.count_files(spark, folders[1]) == len(files)
    assert pq.ParquetFile(files[0]).metadata.row_group(0).column(0).compression == "ZSTD"
    assert not list((tmp_path / "table").rglob("*.part"))
    back = warehouse.open_observations(spark, folders[1])
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    assert sorted(r["year"] for r in warehouse.existing_years(spark, folders[1]).collect()) == [
        2023, 2024]


def test_opening_nothing(spark, tmp_path):
    for folder in (tmp_path / "absent", tmp_path):
        with pytest.raises(FileNotFoundError):
            warehouse.open_observations(spark, str(folder))
    assert warehouse.existing_years(spark, str(tmp_path / "absent")).isEmpty()


def test_years_to_ingest(spark):
    wanted, have = (warehouse.requested_years(spark, y) for y in ([2020, 2021, 2021], [2020, 2019]))
    assert [r["year"] for r in warehouse.years_to_ingest(wanted, have).collect()] == [2021]
    assert warehouse.years_to_ingest(wanted, have, force=True).count() == 2


def test_manifest_keeps_earlier_years(spark):
    schema = "year int, sha256 string"
    old = spark.createDataFrame([(2024, "x")], schema)
    new = spark.createDataFrame([(y, "y") for y in range(2020, 2024)], schema)
    merged = manifest.manifest_upsert(old, new.withColumn("rows", F.lit(1)))
    assert [(r["year"], r["sha256"], r["rows"]) for r in merged.collect()] == [
        (y, "y", 1) for y in range(2020, 2024)] + [(2024, "x", None)]
    replaced = manifest.manifest_upsert(old, old.withColumn("sha256", F.lit("z")))
    assert [tuple(r) for r in replaced.collect()] == [(2024, "z")]


def test_large_files_are_streamed_to_the_same_checksum(spark, folders):
    whole = manifest.file_manifest(spark, folders[0])
    streamed = manifest.file_manifest(spark, folders[0], whole_file_bytes=0)
    assert whole.count() == 2
    assert sorted(whole.collect()) == sorted(streamed.collect())


def test_a_year_in_several_archives_is_one_entry(spark, folders, tmp_path):
    make_archives(tmp_path / "archives" / "more", 2024, temp=" 10.0")
    files = manifest.file_manifest(spark, folders[0], manifest.archive_glob([2024]))
    parts = sorted(files.collect(), key=lambda r: r["sha256"])
    assert [r["file"] for r in parts] == ["2024.tar.gz"] * 2
    (entry,) = manifest.archive_provenance(files).collect()
    joined = "".join(r["sha256"] for r in parts).encode()
    assert entry.asDict() == {
        "year": 2024, "file": "2 files", "size_bytes": sum(r["size_bytes"] for r in parts),
        "sha256": hashlib.sha256(joined).hexdigest()}
    (built,) = jobs.build_warehouse(spark, *folders, [2024]).collect()
    assert built["rows"] == 12 and built["sha256"] == entry["sha256"]


def test_report_round_trip(spark, hand, tmp_path):
    counts = questions.event_counts(hand, 2019)
    report.write_report({"event_counts": counts, "stats": questions.table_stats(hand)},
                        str(tmp_path / "report"))
    back = report.read_section(spark, str(tmp_path / "report"), "event_counts")
    assert records(back, "event") == records(counts, "event")
    (part,) = (tmp_path / "report" / "stats").glob("*.json")
    assert list(json.loads(part.read_text())) == ["first_year", "last_year", "rows", "stations"]

    document = tmp_path / "document.json"
    document.write_text(json.dumps(
        {"year": 2024, "event_counts": [r.asDict() for r in counts.collect()]}, indent=2))
    inside = report.read_document_section(spark, str(document), "event_counts")
    assert records(inside, "event") == records(counts, "event")


def test_undefined_is_written_as_null(spark, tmp_path):
    report.write_section(spark.sql("SELECT 1 AS b, CAST(NULL AS DOUBLE) AS a"),
                         str(tmp_path), "s")
    (part,) = (tmp_path / "s").glob("*.json")
    assert part.read_text().strip() == '{"a":null,"b":1}'


def test_scan_cost(spark, folders):
    warehouse.write_observations(
        ingest.to_observations(archive.read_archives(spark, folders[0])), folders[1])
    chunks = scancost.column_chunks(spark, folders[1])
    sizes = records(scancost.column_bytes(chunks), "column")
    assert set(EVENT_FLAGS) < set(sizes) and "year" not in sizes
    cost = scancost.column_scan_cost(
        scancost.column_bytes(chunks), EVENT_FLAGS, 6.25).first().asDict()
    assert cost["all_columns_bytes"] == sum(s["uncompressed"] for s in sizes.values())
    assert cost["named_columns_bytes"] == sum(sizes[f]["uncompressed"] for f in EVENT_FLAGS)
    assert cost["scan_ratio"] > 1 and cost["all_columns_price"] >= cost["named_columns_price"]


def test_routes_agree(hand):
    arms = pushdown.pushdown_arms(hand, 2019)
    got = records(arms, "arm")
    assert sorted(got) == ["all_columns", "engine", "needed_columns"]
    assert {(r["fog"], r["rain_drizzle"], r["station_days"]) for r in got.values()} == {(1, 3, 5)}
    assert pushdown.arms_agree(arms).first()["all_arms_agree"] is True


def test_report_jobs(spark, hand, tmp_path):
    reference = jobs.counts_table(spark, {"fog": 4, "rain_drizzle": 2})
    sections = jobs.analysis_sections(hand, 2019, reference=reference)
    sections |= jobs.uncertainty_sections(hand, resamples=50)
    report.write_report(sections, str(tmp_path))
    check = report.read_section(spark, str(tmp_path), "cross_check")
    assert {r["event"]: r["difference"] for r in check.collect()} == {"fog": -3, "rain_drizzle": 1}
    overlap = report.read_section(spark, str(tmp_path), "station_overlap").first()
    assert overlap["stations_any_year"] == 4

    text = hand.where("year = 2019").select(
        "date", *[F.when(F.col(f), "1").otherwise("0").alias(f) for f in EVENT_FLAGS])
    agreement = jobs.agreement_sections(text, questions.event_counts(hand, 2019))
    summary = agreement["agreement_summary"].first()
    assert summary["all_identical"] is True and summary["all_differences_same_sign"] is None
    assert agreement["event_counts"].first()["rain_drizzle"] == 3
    assert agreement["monthly_events"].count() == 3
