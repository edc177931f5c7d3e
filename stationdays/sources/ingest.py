"""Raw text rows -> the observations table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationdays.functions import (
    clean_text,
    decode_flags,
    flag_as_boolean,
    parse_date,
    parse_number,
    to_celsius,
)
from stationdays.schema import (
    CELSIUS_COLUMNS,
    DATE_COLUMN,
    EVENT_FLAGS,
    FLAGS_COLUMN,
    MEASURE_COLUMNS,
    OBSERVATIONS,
    POSITION_COLUMNS,
    SENTINELS,
    TEXT_COLUMNS,
)


def flag_columns(encoding: str = "packed", packed: str = FLAGS_COLUMN) -> list[Column]:
    """The six flags as booleans, from any of the three encodings in use."""
    if encoding == "packed":
        return decode_flags(F.col(packed))
    return [flag_as_boolean(F.col(f), encoding).alias(f) for f in EVENT_FLAGS]


def to_observations(raw: DataFrame, flags: str = "packed") -> DataFrame:
    """Interpret the text: names, dates, numbers without sentinels, flags, Celsius.

    One projection, no shuffle. No row is dropped: what cannot be read becomes
    NULL (or an unset flag), and the year stays the container's.
    """
    typed = raw.select(
        *[clean_text(F.col(c)).alias(name) for c, name in TEXT_COLUMNS.items()],
        *[parse_date(F.col(c)).alias(name) for c, name in DATE_COLUMN.items()],
        *[
            parse_number(F.col(c), SENTINELS.get(c)).alias(name)
            for c, name in {**POSITION_COLUMNS, **MEASURE_COLUMNS}.items()
        ],
        *flag_columns(flags),
        F.col("year").cast("int").alias("year"),
    )
    return typed.withColumns(
        {celsius: to_celsius(F.col(f)) for f, celsius in CELSIUS_COLUMNS.items()}
    ).select(*OBSERVATIONS.names)
