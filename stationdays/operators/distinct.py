"""Exact distinct counts from bitmaps over a dense index.

A set of entities is a bitmap per bucket of 32,768 index numbers. Bitmaps are built once, per
the finest group that is asked about, and every coarser question is an OR of them: how many
stations in a year, in a decade, in all years, in any of some groups. Nothing is counted
twice and no row is expanded, however many distinct counts a question has; what is
shuffled is 4 kB per group and bucket at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationdays.operators.bootstrap import dense_index


def entity_index(observations: DataFrame, entity: str = "station") -> DataFrame:
    """entity, idx: the different entities, numbered without gaps."""
    known = observations.select(entity).where(F.col(entity).isNotNull()).distinct()
    return dense_index(known, entity)


def entity_bitmaps(
    observations: DataFrame,
    index: DataFrame,
    by: Sequence[str],
    entity: str = "station",
) -> DataFrame:
    """by..., bucket, bitmap of the entities that each group has.

    Rows are reduced to one per group and entity before they meet the index, so an entity
    with very many rows is a handful there.
    """
    # Spark numbers a bucket's bits from 1
    number = F.col("idx") + 1
    present = observations.select(*by, entity).where(F.col(entity).isNotNull()).distinct()
    return (
        present.join(index, entity)
        .groupBy(*by, F.bitmap_bucket_number(number).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))
    )


def distinct_of_bitmaps(
    bitmaps: DataFrame, by: Sequence[str] = (), name: str = "entities"
) -> DataFrame:
    """by..., the number of different entities: of some of the bitmaps' groups, or of all."""
    united = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return united.groupBy(*by).agg(
        F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias(name)
    )


def stats_of_bitmaps(
    observations: DataFrame, bitmaps: DataFrame, year: str = "year"
) -> DataFrame:
    """rows, stations, first_year, last_year, as `questions.table_stats` has them."""
    stations = distinct_of_bitmaps(bitmaps, name="stations").scalar()
    return observations.agg(
        F.count("*").alias("rows"), F.min(year).alias("first_year"), F.max(year).alias("last_year")
    ).select("rows", stations.alias("stations"), "first_year", "last_year")
