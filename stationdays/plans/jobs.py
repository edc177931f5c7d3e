"""Whole jobs: ingest, analysis, uncertainty, agreement of two sources."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationdays.operators import bootstrap, panel, questions, reconcile
from stationdays.schema import EVENT_FLAGS
from stationdays.sources import archive, ingest, manifest, station_csv, warehouse

# --- fixed values: counts an earlier run of the same question reported for 2024
EARLIER_YEAR = 2024
EARLIER_COUNTS = {
    "rain_drizzle": 968620,
    "snow_ice_pellets": 234571,
    "fog": 217755,
    "thunder": 173891,
    "hail": 4473,
    "tornado_funnel_cloud": 206,
}
# --- end of fixed values


def build_warehouse(
    spark: SparkSession,
    archives: str,
    folder: str,
    manifest_folder: str,
    years: Iterable[int],
    force: bool = False,
) -> DataFrame:
    """Ingest the requested years that are missing, log where each came from.

    Returns the manifest: one entry per year ever ingested. A year already there, whole,
    is not parsed again, but its archive, if still there, is checksummed. A year whose
    files have changed since they were committed is ingested again.
    """
    years = sorted(set(years))
    requested = warehouse.requested_years(spark, years)
    missing = warehouse.years_to_ingest(requested, warehouse.existing_years(spark, folder), force)
    todo = sorted(row["year"] for row in missing.collect())

    if todo:
        without = sorted(set(todo) - archive.archive_years(spark, archives))
        if without:
            raise FileNotFoundError(f"no archive below {archives} for {without}")
        rows = ingest.to_observations(archive.read_archives(spark, archives, todo))
        warehouse.write_observations(rows, folder, whole=todo, rebalance=False)

    fresh = F.col("year").isin(todo) if todo else F.lit(False)
    tables = (
        warehouse.parquet_files(spark, folder)
        .groupBy("year")
        .agg(F.sum("length").alias("parquet_bytes"))
        .withColumn("parquet", F.concat(F.lit("year="), F.col("year")))
    )
    stored = warehouse.open_observations(spark, folder, view=None)
    # without any archive left there is nothing to checksum: entries say so
    kept = archive.archive_years(spark, archives) & set(years)
    checksums = (
        manifest.file_manifest(spark, archives, manifest.archive_glob(kept))
        if kept
        else spark.createDataFrame([], "file string, size_bytes long, sha256 string")
    )
    entries = manifest.manifest_entries(
        requested.join(tables, "year").withColumn("cached", ~fresh),
        manifest.archive_provenance(checksums),
        manifest.year_sizes(stored.where(fresh)),
    )
    manifest.append_manifest(entries, manifest_folder, generation=time.time_ns())
    return manifest.read_manifest(spark, manifest_folder)


def ingest_station_csv(
    spark: SparkSession, csv_folder: str, folder: str, year: int | None = None, **options
) -> None:
    """Ingest unpacked station files; all their years replace what was stored."""
    raw = station_csv.read_station_csv(spark, csv_folder, year=year, **options)
    warehouse.write_observations(ingest.to_observations(raw), folder)


def counts_table(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    return spark.createDataFrame(list(counts.items()), "event string, occurrences long")


def earlier_counts(spark: SparkSession, year: int) -> DataFrame | None:
    """The earlier run's counts, for the one year they are about."""
    return counts_table(spark, EARLIER_COUNTS) if year == EARLIER_YEAR else None


def analysis_sections(
    observations: DataFrame,
    year: int,
    top: int = 12,
    reference: DataFrame | None = None,
    years: Iterable[int] | None = None,
) -> dict[str, DataFrame]:
    """Every table of the analysis report; `reference` counts add a cross-check. All `years`
    of the data, if known (`warehouse.committed_years`), spare the panel a scan and a shuffle."""
    years = sorted(years) if years else None
    counts = questions.event_counts(observations, year)
    sections = {
        "warehouse": questions.table_stats(observations),
        "event_counts": counts,
        "share_total": questions.share_total(counts),
        "monthly_events": questions.monthly_events(observations, year),
        "station_coverage_top": questions.station_coverage(observations, year, top),
        "station_overlap": questions.station_overlap(observations),
        "annual_temperature": questions.annual_temperature(observations),
        "annual_temperature_balanced_panel": panel.balanced_temperature(observations, years=years),
        "annual_vs_balanced": panel.annual_vs_balanced(observations, years=years),
    }
    if reference is not None:
        compared = reconcile.count_reconcile(counts, reference, how="inner")
        sections["cross_check"] = compared
        sections["cross_check_summary"] = reconcile.reconcile_summary(compared)
    return sections


def uncertainty_sections(
    observations: DataFrame, resamples: int = 2000, seed: int = 42
) -> dict[str, DataFrame]:
    """The composition effect with its interval, and the naive error beside it."""
    effect = bootstrap.composition_effect(observations, resamples, seed)
    return {
        "composition_effect": bootstrap.effect_summary(effect),
        "row_level_standard_error_for_contrast": panel.row_level_se(
            questions.annual_temperature(observations)
        ),
    }


def agreement_sections(
    text_flags: DataFrame, published: DataFrame, date_column: str = "date"
) -> dict[str, DataFrame]:
    """Counts of a table with '0'/'1' flags against already published counts."""
    counts = questions.event_counts(text_flags, encoding="text")
    compared = reconcile.count_reconcile(published, counts)
    return {
        "event_counts": questions.wide_event_counts(text_flags, EVENT_FLAGS, "text"),
        "monthly_events": questions.monthly_events(
            text_flags, date_column=date_column, encoding="text"
        ),
        "agreement": compared,
        "agreement_summary": reconcile.reconcile_summary(compared),
    }
