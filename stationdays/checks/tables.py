"""The given tables seen as daily observations.

An order is a station-day: the customer is the station, the order date the day,
a thousandth of the price the temperature in Fahrenheit, with the missing-value
code in every tenth row; status, priority and price give the six flags, with some
malformed flag strings. Every order is used.
"""

from __future__ import annotations

import csv
import io
import tarfile
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationdays.functions import decode_flags, to_celsius, without_sentinel
from stationdays.schema import RAW_COLUMNS, SENTINELS
from stationdays.sources.files import filesystem_and_path, ship_by_value

FLAG_TEXT = """
concat(CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END,
       CASE WHEN o_orderstatus = 'O' THEN '1' ELSE '0' END,
       CASE WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '0' END,
       CASE WHEN o_orderpriority = '5-LOW' THEN '1' ELSE '0' END,
       CASE WHEN o_totalprice > 400000 THEN '1' ELSE '0' END,
       CASE WHEN o_orderkey % 97 = 0 THEN ''
            WHEN o_orderkey % 13 = 0 THEN '1' ELSE '0' END)
"""

ROWS_PER_ARCHIVE = 200_000
"""About so many rows of all years make the archives of one part."""
TASKS_PER_PART = 8
MOST_TASKS = 200
"""Up to so many, tasks hand rows on without holding them (spark.shuffle.sort.bypassMergeThreshold)."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns before interpretation: sentinel still in, flags still packed."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS station",
        "CAST(year(o_orderdate) AS INT) AS year",
        "CAST(o_orderdate AS DATE) AS date",
        "CASE WHEN o_orderkey % 10 = 0 THEN 9999.9D ELSE o_totalprice / 1000 END AS temp_raw",
        f"{FLAG_TEXT} AS frshtt",
    )


def order_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, year, date, temp_c and the six flags."""
    return raw_orders(spark, sf_dir).select(
        "station",
        "year",
        "date",
        to_celsius(without_sentinel(F.col("temp_raw"), SENTINELS["TEMP"])).alias("temp_c"),
        *decode_flags(F.col("frshtt")),
    )


def order_text_rows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Orders as the text columns of a station file, plus the year of the container."""
    written = {
        "STATION": "lpad(CAST(o_custkey AS STRING), 11, '0')",
        "DATE": "date_format(o_orderdate, 'yyyy-MM-dd')",
        "NAME": "concat('FIELD ', o_custkey, ', US')",
        "LATITUDE": "CAST(o_custkey / 100 AS STRING)",
        "LONGITUDE": "CAST(-o_custkey / 100 AS STRING)",
        "ELEVATION": "CAST(o_custkey AS STRING)",
        "TEMP": "CASE WHEN o_orderkey % 10 = 0 THEN '9999.9'"
        " ELSE concat('  ', CAST(o_totalprice / 1000 AS STRING)) END",
        "MAX": "'9999.9'",
        "MIN": "''",
        "DEWP": "'none'",
        "PRCP": "CASE WHEN o_orderstatus = 'F' THEN '99.99' ELSE '0.01' END",
        "WDSP": "CASE WHEN o_orderstatus = 'O' THEN '999.9' ELSE ' 13.1' END",
        "VISIB": "'99.99'",
        "FRSHTT": FLAG_TEXT,
    }
    assert sorted(written) == sorted(RAW_COLUMNS)
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(year(o_orderdate) AS INT) AS year",
        *[f"{expression} AS {name}" for name, expression in written.items()],
        *more,
    )


def write_station_csv(rows: DataFrame, folder: str, columns: list[str]) -> None:
    """Quoted CSV files with a header, in one folder per year."""
    (
        rows.select(*columns, "year")
        .write.mode("append")
        .partitionBy("year")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(folder)
    )


def write_archives(rows: DataFrame, folder: str, rows_per_archive: int = ROWS_PER_ARCHIVE) -> None:
    """`<part>/<year>.tar.gz` with one CSV member per station, written by the tasks.

    Rows are dealt to as many parts as keep an archive at about the given size,
    whatever the years' and stations' sizes are.
    """
    columns = [c for c in rows.columns if c != "year"]

    def members(records: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
        days = records.sort_values("STATION")[columns].itertuples(index=False, name=None)
        for station, lines in groupby(days, key=itemgetter(columns.index("STATION"))):
            yield f"{station}.csv", csv_bytes(columns, lines)

    deal_archives(in_parts(rows, rows_per_archive), folder, members)


def in_parts(rows: DataFrame, rows_per_part: int) -> DataFrame:
    """Rows with the number `_part` of one of as many parts as keep each at about the size,
    dealt to tasks by part and year."""
    columns = [c for c in rows.columns if c != "year"]
    parts = max(1, -(-rows.count() // rows_per_part))
    placed = rows.withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(parts)))
    # by a number of its own: work on them is more than their bytes tell
    return placed.repartition(min(TASKS_PER_PART * parts, MOST_TASKS), "_part", "year")


def csv_bytes(header: list[str], records: Iterable[tuple], line_end: str = "\r\n") -> bytes:
    text = io.StringIO()
    writer = csv.writer(text, quoting=csv.QUOTE_ALL, lineterminator=line_end)
    writer.writerow(header)
    writer.writerows(records)
    return text.getvalue().encode()


def deal_archives(
    rows: DataFrame, folder: str, members: Callable[[pd.DataFrame], Iterator[tuple[str, bytes]]]
) -> None:
    """An archive for each `_part` and year of rows, with the members made of its rows."""

    def write_one(key: tuple, records: pd.DataFrame) -> pd.DataFrame:
        part, year = key
        filesystem, path = filesystem_and_path(f"{folder}/part-{part}/{year}.tar.gz")
        if isinstance(filesystem, pafs.LocalFileSystem):
            filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with filesystem.open_output_stream(path, compression=None) as sink, tarfile.open(
            fileobj=sink, mode="w|gz", compresslevel=6
        ) as archive:
            for name, content in members(records):
                member = tarfile.TarInfo(name)
                member.size = len(content)
                archive.addfile(member, io.BytesIO(content))
        return pd.DataFrame({"path": [path], "rows": [len(records)]})

    (
        rows.groupBy("_part", "year")
        .applyInPandas(write_one, "path string, rows long")
        .write.format("noop")
        .mode("overwrite")
        .save()
    )


ODD_HEADERS = 6


def odd_header_member(layout: int, columns: list[str], records: list[tuple]) -> bytes:
    """One member whose header is found in an odd way: behind records without a value, with a
    byte order mark, in another order, or with one of its names twice."""
    header = list(columns)
    if layout == 3:
        header.reverse()
        records = [tuple(reversed(r)) for r in records]
    if layout == 4:
        # of two columns of one name the last counts
        header.insert(0, "TEMP")
        records = [("-1.5", *r) for r in records]
    blank = b"," * (len(header) - 1) + b"\n"
    quoted = b",".join([b'""'] * len(header)) + b"\r\n"
    before = [b"", blank, quoted + b"\r\n" + blank, b"\n", b"\xef\xbb\xbf", b"\xef\xbb\xbf" + quoted]
    return before[layout] + csv_bytes(header, records, "\n" if layout % 2 else "\r\n")


def write_odd_archives(
    rows: DataFrame, folder: str, rows_per_archive: int = ROWS_PER_ARCHIVE
) -> None:
    """Archives of members with all odd headers, each in members of one and of many stations,
    so that every header comes in members of a few lines and of many. Parts of rows are dealt
    as by `write_archives`."""
    columns = [c for c in rows.columns if c != "year"]

    def members(records: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
        days = records.sort_values(columns)
        layout = days["STATION"].str[-3:].astype(int) % ODD_HEADERS
        for number, some in days.groupby(layout):
            half = len(some) // 8
            for name, part in (("few", some[:half]), ("many", some[half:])):
                lines = list(part[columns].itertuples(index=False, name=None))
                step = 20 if name == "few" else len(lines) or 1
                for at in range(0, len(lines), step):
                    member = odd_header_member(int(number), columns, lines[at : at + step])
                    yield f"{name}/{number}-{at}.csv", member

    deal_archives(in_parts(rows, rows_per_archive), folder, members)


def odd_record(number: int, columns: list[str], record: tuple) -> bytes:
    """A record with bytes that are no text, or one that ends early, or a usual one."""
    line = csv_bytes(list(record), [])
    if number % 3 == 1:
        return line.replace(b"FIELD ", b"FIELD\xff\xfe ")
    if number % 3 == 2:
        short = record[: columns.index("PRCP")]
        return csv_bytes(list(short), [])
    return line


def write_archives_with_odd_records(
    rows: DataFrame, folder: str, rows_per_archive: int = ROWS_PER_ARCHIVE
) -> None:
    """Archives of a year other than their rows', with odd records and with members that are
    no CSV files. The key of an order, column `number`, says how odd its record is. Parts of
    rows are dealt as by `write_archives`; rows without a station have no member."""
    columns = [c for c in rows.columns if c not in ("year", "number")]
    header = csv_bytes(columns, [])

    def members(records: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
        days = records[records["STATION"].notna()].sort_values(["STATION", "number"])
        numbered = days[["number", *columns]].itertuples(index=False, name=None)
        for station, some in groupby(numbered, key=itemgetter(1 + columns.index("STATION"))):
            content = header + b"".join(odd_record(r[0], columns, r[1:]) for r in some)
            yield f"{station}.csv", content
            if int(station) % 7 == 0:
                yield f"{station}.txt", content
                yield f"{station}.csv.bak", content

    deal_archives(in_parts(rows, rows_per_archive), folder, members)


ship_by_value(__name__)
