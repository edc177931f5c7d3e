"""Reading folders of already unpacked per-station CSV files.

Spark binds CSV columns by position. The files' columns are free in order, so a
small job first reads only the header line of each file and keeps where in it the
wanted columns are; the one big scan then reads positional text columns with
Spark's own CSV reader, and each wanted column is taken from the place its file's
header gives it. Usually all files agree on the places, and then no join is needed.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationdays.schema import RAW_COLUMNS
from stationdays.session import scratch_folder
from stationdays.sources.files import filesystem_and_path, ship_by_value

MARK, BLANK = b"\xef\xbb\xbf", b" \t\r\n"


def first_line(uri: str, chunk: int = 4096, whole_file: bool = False) -> str:
    """The first line that isn't blank, as Spark's reader takes it for the header.

    Reading files whole, that reader skips empty lines only, and only if they end as the
    header does; it would take anything else for the header, so such a file is an error.
    """
    filesystem, path = filesystem_and_path(uri)
    head = b""
    with filesystem.open_input_stream(path) as stream:
        while b"\n" not in head.lstrip(MARK + BLANK):
            block = stream.read(chunk)
            if not block:
                break
            head += block
    head = head.removeprefix(MARK)
    line = head.lstrip(BLANK).split(b"\n", 1)[0]
    before = head[: len(head) - len(head.lstrip(BLANK))]
    if whole_file and line and before.replace(b"\r\n" if line.endswith(b"\r") else b"\n", b""):
        raise ValueError(f"{uri}: blank lines before the header end otherwise than the header")
    return line.decode("utf-8", errors="replace").rstrip("\r")


def places_in(header: str, columns: list[str]) -> list[int] | None:
    """Where each column is, -1 where it isn't; of columns with one name the last counts."""
    if not header:
        return None
    at = {name: i for i, name in enumerate(next(csv.reader([header])))}
    return [at.get(column, -1) for column in columns]


def file_layouts(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    glob: str = "*.csv",
    line_breaks_in_fields: bool = True,
) -> DataFrame:
    """(file_path, places) of every CSV file that isn't empty; reads one line per file."""

    def layouts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [first_line(p, whole_file=line_breaks_in_fields) for p in batch["path"]]
            places = [places_in(line, columns) for line in lines]
            yield pd.DataFrame({"file_path": batch["file_path"], "places": places})

    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", F.col("_metadata.file_path").alias("file_path"))
    )
    found = files.mapInPandas(layouts, "file_path string, places array<int>")
    return found.where("places IS NOT NULL")


def read_station_csv(
    spark: SparkSession,
    folder: str,
    year: int | None = None,
    year_pattern: str = r"(\d{4})/[^/]*$",
    columns: list[str] = RAW_COLUMNS,
    glob: str = "*.csv",
    line_breaks_in_fields: bool = True,
) -> DataFrame:
    """Raw text rows of all CSV files below a folder, bound by header name.

    Short records are padded with NULL, bytes that are not UTF-8 are replaced,
    quoted commas stay inside their field. The year is the given one, or what
    `year_pattern` finds in the file's path (its folder by default). A file is one
    task's work, as quoted fields may hold line breaks; say that they don't, and
    large files are split over tasks.

    Headers are read at once, when this is called, and what they say is kept in the
    shared scratch folder.
    """
    kept = scratch_folder(spark, "layouts")
    file_layouts(spark, folder, columns, glob, line_breaks_in_fields).write.parquet(kept)
    layouts = spark.read.schema("file_path string, places array<int>").parquet(kept)
    # for each column the different places it has, at most as many as a header has names
    sets = [F.collect_set(F.col("places")[i]) for i in range(len(columns))]
    at = {c: sorted(s) for c, s in zip(columns, layouts.agg(*sets).first())}
    if not any(at.values()):
        raise FileNotFoundError(f"no CSV file with a header below {folder}")
    alike = all(len(places) == 1 for places in at.values())

    width = 1 + max(0, *(places[-1] for places in at.values()))
    positional = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(width)])
    rows = (
        spark.read.schema(positional)
        .option("header", True)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .option("mode", "PERMISSIVE")
        .option("multiLine", line_breaks_in_fields)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .csv(folder)
        .withColumn("file_path", F.col("_metadata.file_path"))
    )

    if not alike:
        # both sides grow with the data: which join is Spark's choice by size
        rows = rows.join(layouts, "file_path")

    def bound(column: str) -> Column:
        places = [p for p in at[column] if p >= 0]
        if not places:
            return F.lit(None).cast("string")
        if alike:
            return F.col(f"f{places[0]}")
        mine = F.col("places")[columns.index(column)]
        return F.coalesce(*[F.when(mine == p, F.col(f"f{p}")) for p in places])

    in_year = (
        F.lit(year)
        if year is not None
        else F.regexp_extract("file_path", year_pattern, 1).try_cast("int")
    )
    return rows.select(
        *[bound(c).alias(c) for c in columns], in_year.cast("int").alias("year")
    )


ship_by_value(__name__)
