"""Names, types and fixed values of the daily-observation data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the published layout of the station CSV files -------------

# Order of the six characters of the packed indicator string.
EVENT_FLAGS = [
    "fog",
    "rain_drizzle",
    "snow_ice_pellets",
    "hail",
    "thunder",
    "tornado_funnel_cloud",
]

FLAGS_COLUMN = "FRSHTT"

# raw text column -> stored column
TEXT_COLUMNS = {"STATION": "station", "NAME": "name"}
DATE_COLUMN = {"DATE": "date"}
POSITION_COLUMNS = {
    "LATITUDE": "latitude",
    "LONGITUDE": "longitude",
    "ELEVATION": "elevation",
}
MEASURE_COLUMNS = {
    "TEMP": "temp_f",
    "MAX": "max_f",
    "MIN": "min_f",
    "DEWP": "dewp_f",
    "PRCP": "prcp_in",
    "WDSP": "wdsp_kn",
    "VISIB": "visib_mi",
}

# "Not observed" is written as repeated nines, differently in each column.
SENTINELS = {
    "TEMP": 9999.9,
    "MAX": 9999.9,
    "MIN": 9999.9,
    "DEWP": 9999.9,
    "PRCP": 99.99,
    "WDSP": 999.9,
    "VISIB": 999.9,
}

CELSIUS_COLUMNS = {"temp_f": "temp_c", "max_f": "max_c", "min_f": "min_c"}

# --- end of fixed values ------------------------------------------------------

RAW_COLUMNS = [
    "STATION",
    "DATE",
    "NAME",
    *POSITION_COLUMNS,
    *MEASURE_COLUMNS,
    FLAGS_COLUMN,
]

# What the sources hand to ingest: everything still text, plus the year of the
# container the row came from.
RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in RAW_COLUMNS]
    + [T.StructField("year", T.IntegerType())]
)

OBSERVATIONS = T.StructType(
    [
        T.StructField("station", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("name", T.StringType()),
    ]
    + [T.StructField(c, T.DoubleType()) for c in POSITION_COLUMNS.values()]
    + [T.StructField(c, T.DoubleType()) for c in MEASURE_COLUMNS.values()]
    + [T.StructField(c, T.BooleanType()) for c in EVENT_FLAGS]
    + [T.StructField(c, T.DoubleType()) for c in CELSIUS_COLUMNS.values()]
    # the partition column comes last, as Spark reads it back
    + [T.StructField("year", T.IntegerType())]
)

MANIFEST = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("parquet", T.StringType()),
        T.StructField("parquet_bytes", T.LongType()),
        T.StructField("cached", T.BooleanType()),
        T.StructField("rows", T.LongType()),
        T.StructField("stations", T.LongType()),
        T.StructField("provenance_note", T.StringType()),
        T.StructField("generation", T.LongType()),
    ]
)
