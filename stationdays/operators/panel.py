"""Questions about a station network that changes over the years.

Everything here starts from station-year partials (sum and count of the value):
one scan and one shuffle of at most one row per station and year from each task.
Means over any set of stations are then rebuilt from the partials, so raw rows
are never joined, and a station with very many rows counts as a handful.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationdays.functions import is_measured
from stationdays.operators.questions import distinct_count


def station_year_partials(
    observations: DataFrame,
    station: str = "station",
    year: str = "year",
    value: str = "temp_c",
) -> DataFrame:
    """(station, year, total, n) of the rows with a finite value, in no order."""
    measured = F.col(value)
    return (
        observations.where(is_measured(measured))
        .groupBy(F.col(station).alias("station"), F.col(year).alias("year"))
        .agg(F.sum(measured).alias("total"), F.count(measured).alias("n"))
    )


def per_station_year(
    observations: DataFrame,
    station: str = "station",
    year: str = "year",
    value: str = "temp_c",
) -> DataFrame:
    """The partials as a result table, sorted by station and year."""
    return station_year_partials(observations, station, year, value).orderBy("station", "year")


def balanced_panel(
    observations: DataFrame,
    entity: str = "station",
    period: str = "year",
    value: str | None = None,
    periods_from: str = "all",
) -> DataFrame:
    """Entities present in every period.

    Three rules are in use and differ once values are missing:
      value=None                        present at all, of all periods
      value=v, periods_from="all"       with a value, of all periods
      value=v, periods_from="valid"     with a value, of the periods having any value
    """
    valid = observations if value is None else observations.where(F.col(value).isNotNull())
    periods = {"all": observations, "valid": valid}[periods_from]
    return (
        valid.select(entity, period)
        .distinct()
        .groupBy(entity)
        .agg(F.count(period).alias("_periods"))
        .where(F.col(entity).isNotNull() & (F.col("_periods") == distinct_count(periods, period)))
        .select(entity)
    )


def station_vectors(
    observations: DataFrame,
    years: Sequence[int],
    station: str = "station",
    year: str = "year",
    value: str = "temp_c",
) -> DataFrame:
    """station and, in the order of years, the arrays `totals` and `counts` of its values.

    One aggregation, in which a station is one partial row of each task. Rows of other
    years are not read where the year is a partition.
    """
    measured = F.when(is_measured(F.col(value)), F.col(value))
    of_year = [F.when(F.col(year) == y, measured) for y in years]
    return (
        observations.where(F.col(year).isin(list(years)))
        .groupBy(F.col(station).alias("station"))
        .agg(
            F.array(*map(F.sum, of_year)).alias("totals"),
            F.array(*map(F.count, of_year)).alias("counts"),
        )
    )


def _from_vectors(vectors: DataFrame, years: Sequence[int]) -> DataFrame:
    """The same rows as `_with_membership` gives."""
    always = F.forall("counts", lambda n: n > 0) & F.col("station").isNotNull()
    listed = F.arrays_zip(F.array(*map(F.lit, years)).alias("year"), "totals", "counts")
    return (
        vectors.withColumn("in_panel", always)
        .select("station", "in_panel", F.explode(listed).alias("of"))
        .select(
            "station", F.col("of.year").alias("year"), F.col("of.totals").alias("total"),
            F.col("of.counts").alias("n"), "in_panel",
        )
        .where("n > 0")
    )


def _with_membership(
    observations: DataFrame, station: str, year: str, value: str, years: Sequence[int] | None
) -> DataFrame:
    """Partials, flagged with whether their station has a value in every year of the data.

    With `years`, which are to be all years of the data, this is one scan and one shuffle of a
    row per station; without, years are counted by another scan of their column alone.
    """
    if years:
        years = sorted(set(years))
        return _from_vectors(station_vectors(observations, years, station, year, value), years)
    partials = station_year_partials(observations, station, year, value)
    years_of_station = F.count("year").over(Window.partitionBy("station"))
    return partials.withColumn(
        "in_panel",
        F.col("station").isNotNull()
        & (years_of_station == distinct_count(observations, year)),
    )


def balanced_temperature(
    observations: DataFrame,
    station: str = "station",
    year: str = "year",
    value: str = "temp_c",
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Yearly mean over the stations that have a value in every year; `years`, if given, are
    all years of the data, as the list of what is stored has them."""
    return (
        _with_membership(observations, station, year, value, years)
        .where("in_panel")
        .groupBy("year")
        .agg(
            F.count("*").alias("stations"),
            F.sum("n").alias("station_days"),
            F.round(F.sum("total") / F.sum("n"), 4).alias("mean_temp_c"),
        )
        .orderBy("year")
    )


def annual_vs_balanced(
    observations: DataFrame,
    station: str = "station",
    year: str = "year",
    value: str = "temp_c",
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Yearly means of all stations and of the panel side by side, from one scan.

    A year without any panel row has a null panel mean.
    """
    panel_total = F.sum(F.when(F.col("in_panel"), F.col("total")))
    panel_n = F.sum(F.when(F.col("in_panel"), F.col("n")))
    return (
        _with_membership(observations, station, year, value, years)
        .groupBy("year")
        .agg(
            F.count("station").alias("stations"),
            F.round(F.sum("total") / F.sum("n"), 4).alias("mean_temp_c"),
            F.count_if("in_panel").alias("stations_balanced"),
            F.round(panel_total / panel_n, 4).alias("mean_temp_c_balanced"),
        )
        .orderBy("year")
    )


def panel_gap(both: DataFrame) -> DataFrame:
    """First-to-last change of both means, and how much of it the panel lacks."""

    def change(mean: str):
        return F.max_by(mean, "year") - F.min_by(mean, "year")

    return both.agg(
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.round(change("mean_temp_c"), 4).alias("naive_change"),
        F.round(change("mean_temp_c_balanced"), 4).alias("balanced_change"),
        F.round(change("mean_temp_c") - change("mean_temp_c_balanced"), 4).alias("gap"),
    )


def row_level_se(annual: DataFrame, places: int = 5) -> DataFrame:
    """Standard error of the first-to-last change if every row were independent."""

    def squared_error(pick):
        return F.pow(pick("sd_temp_c", "year"), 2) / pick("station_days", "year")

    return annual.agg(
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.bround(
            F.sqrt(squared_error(F.min_by) + squared_error(F.max_by)), places
        ).alias("row_level_se_c"),
    )


def station_year_matrix(partials: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """One row per station, `<year>_total` and `<year>_n` per year, 0 where absent.

    Give `years` to spare the extra job that finds them.
    """
    by_station = partials.groupBy("station")
    pivoted = by_station.pivot("year") if years is None else by_station.pivot("year", list(years))
    return pivoted.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).fillna(0)
