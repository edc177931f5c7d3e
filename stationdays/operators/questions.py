"""Grouped questions over observations.

Each takes the observations DataFrame and column names, so the same code runs on
any entity-period-value table. All are one scan of the named columns and map-side
partial aggregation; only partial rows are shuffled, so a year, station or
country with a large part of all rows is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationdays.functions import is_measured, percent, ratio, tail_code
from stationdays.schema import EVENT_FLAGS


def distinct_count(frame: DataFrame, column: str) -> Column:
    """Number of distinct values as a scalar subquery: evaluated once per query."""
    return frame.agg(F.countDistinct(column)).scalar()


def needed_columns(observations: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so only these are read."""
    return observations.select(*columns)


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _counts(flags: Sequence[str], encoding: str) -> list[str]:
    # count_if gives 0, not NULL, when there are no rows
    hit = {"boolean": "{0}", "text": "{0} = '1'"}[encoding]
    names = [quoted(f) for f in flags]
    return [f"count_if({hit.format(f)}) AS {f}" for f in names] + ["count(*) AS station_days"]


def wide_event_counts(
    observations: DataFrame, flags: Sequence[str] = EVENT_FLAGS, encoding: str = "boolean"
) -> DataFrame:
    """One row: the number of rows with each flag, and the number of rows."""
    return observations.selectExpr(*_counts(flags, encoding))


def event_counts(
    observations: DataFrame,
    year: int | None = None,
    flags: Sequence[str] = EVENT_FLAGS,
    year_column: str = "year",
    encoding: str = "boolean",
    places: int | None = 2,
) -> DataFrame:
    """event, occurrences, pct_of_station_days, station_days; most frequent first.

    The share is of all station-days. The flags are independent, so the shares
    need not sum to 100.
    """
    chosen = observations if year is None else observations.where(F.col(year_column) == year)
    wide = wide_event_counts(chosen, flags, encoding)
    return (
        wide.unpivot(["station_days"], list(flags), "event", "occurrences")
        .select(
            "event",
            "occurrences",
            percent(F.col("occurrences"), F.col("station_days"), places).alias(
                "pct_of_station_days"
            ),
            "station_days",
        )
        # one row per flag, made by one task from one row: sort it where it is
        .coalesce(1)
        .orderBy(F.desc("occurrences"), "event")
    )


def share_total(counts: DataFrame, share: str = "pct_of_station_days") -> DataFrame:
    return counts.agg(F.sum(share).alias("sum_of_shares"))


def monthly_events(
    observations: DataFrame,
    year: int | None = None,
    flags: Sequence[str] = EVENT_FLAGS,
    date_column: str = "date",
    year_column: str = "year",
    encoding: str = "boolean",
) -> DataFrame:
    """month, the six counts, station_days; a row without a date has a null month, last."""
    chosen = observations if year is None else observations.where(F.col(year_column) == year)
    return (
        chosen.groupBy(F.month(date_column).alias("month"))
        .agg(*map(F.expr, _counts(flags, encoding)))
        .orderBy(F.asc_nulls_last("month"))
    )


def annual_temperature(
    observations: DataFrame,
    station: str = "station",
    year: str = "year",
    value: str = "temp_c",
) -> DataFrame:
    """Mean, spread and extremes by year over whatever stations reported."""
    measured = F.col(value)
    return (
        observations.where(is_measured(measured))
        .groupBy(F.col(year).alias("year"))
        .agg(
            F.count("*").alias("station_days"),
            F.countDistinct(station).alias("stations"),
            F.round(F.avg(measured), 4).alias("mean_temp_c"),
            F.round(F.stddev_samp(measured), 4).alias("sd_temp_c"),
            F.round(F.min(measured), 2).alias("min_temp_c"),
            F.round(F.max(measured), 2).alias("max_temp_c"),
        )
        .orderBy("year")
    )


def station_coverage(
    observations: DataFrame,
    year: int | None = None,
    top: int = 12,
    station: str = "station",
    name: str = "name",
    year_column: str = "year",
) -> DataFrame:
    """Stations and station-days of the countries with the most station-days."""
    chosen = observations if year is None else observations.where(F.col(year_column) == year)
    return (
        chosen.where(F.length(F.trim(F.col(name))) >= 2)
        .groupBy(tail_code(F.col(name)).alias("country"))
        .agg(
            F.countDistinct(station).alias("stations"),
            F.count("*").alias("station_days"),
        )
        .orderBy(F.desc("station_days"), "country")
        .limit(top)
    )


def station_overlap(
    observations: DataFrame, station: str = "station", year: str = "year"
) -> DataFrame:
    """How many stations there are, and how many of them in every year."""
    years_of_station = (
        observations.select(station, year)
        .distinct()
        .groupBy(station)
        .agg(F.count(year).alias("_years"))
    )
    in_every_year = F.col("_years") == distinct_count(observations, year)
    return years_of_station.agg(
        F.count(station).alias("stations_any_year"),
        F.count_if(in_every_year).alias("stations_every_year"),
    ).withColumn(
        "share_reporting_every_year",
        F.coalesce(
            F.bround(ratio(F.col("stations_every_year"), F.col("stations_any_year")), 4),
            F.lit(0.0),
        ),
    )


def table_stats(
    observations: DataFrame, station: str = "station", year: str = "year"
) -> DataFrame:
    """rows, stations, first_year, last_year."""
    return observations.agg(
        F.count("*").alias("rows"),
        F.countDistinct(station).alias("stations"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
    )
