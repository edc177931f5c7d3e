"""Comparing counts by key between two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationdays.functions import percent


def count_reconcile(
    counts: DataFrame,
    reference: DataFrame,
    key: str = "event",
    value: str = "occurrences",
    how: str = "full",
    abs_places: int | None = 2,
    signed_places: int | None = 3,
) -> DataFrame:
    """Differences by key: signed, signed percent and absolute percent.

    how="full" keeps every key, with 0 where one side lacks it and `matched`
    false; how="inner" compares only keys that have a reference. Percentages are
    of the reference, and NULL where that is 0. Both sides are aggregated counts.
    """
    left = counts.select(key, F.col(value).alias("_count"))
    right = reference.select(key, F.col(value).alias("_reference"))
    joined = left.join(right, key, how)
    this = F.coalesce(F.col("_count"), F.lit(0)).cast("long")
    other = F.coalesce(F.col("_reference"), F.lit(0)).cast("long")
    difference = F.col("occurrences") - F.col("reference")
    return (
        joined.select(
            key,
            this.alias("occurrences"),
            other.alias("reference"),
            (F.col("_count").isNotNull() & F.col("_reference").isNotNull()).alias("matched"),
        )
        .withColumn("difference", difference)
        .withColumn("pct_difference", percent(difference, F.col("reference"), signed_places))
        .withColumn("relative_pct", percent(F.abs(difference), F.col("reference"), abs_places))
    )


def reconcile_summary(compared: DataFrame) -> DataFrame:
    """Worst case, whether all agree, and whether all differences point one way.

    The last is NULL when nothing differs: zeros have no direction.
    """
    differs = F.col("difference") != 0
    return compared.agg(
        F.count("*").alias("compared"),
        F.coalesce(F.max("relative_pct"), F.lit(0.0)).alias("largest_relative_pct"),
        F.coalesce(F.max(F.abs("pct_difference")), F.lit(0.0)).alias("largest_abs_pct_difference"),
        F.coalesce(~F.bool_or(differs), F.lit(True)).alias("all_identical"),
        (
            F.min(F.when(differs, F.col("difference") > 0))
            == F.max(F.when(differs, F.col("difference") > 0))
        ).alias("all_differences_same_sign"),
    )
