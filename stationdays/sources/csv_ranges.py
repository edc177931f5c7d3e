"""Reading large CSV files by ranges that begin and end with records.

A line break inside quotes ends no record, so a file cannot be cut at just any of them. A
first pass counts the quotes of every range of bytes, all ranges at once, and notes its
first line break behind an even and behind an odd number of them. Sums of the counts
then say whether a range begins inside quotes, and so which of the two begins a record: that
is where the range's rows begin. A second pass reads each range for itself.

This asks for quotes as the usual rules have them: around whole fields, and doubled inside.
A file with a quote between two other characters, or with an odd number of them, is read as
one range. Headers are found, and records read, as in members of archives.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationdays.schema import RAW_COLUMNS
from stationdays.sources import archive
from stationdays.sources.files import filesystem_and_path, ship_by_value

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
STRAY_QUOTE = re.compile(rb'[^,\r\n"]"[^,\r\n"]')
QUOTE, LINE_FEED = 34, 10


def scan_range(blocks: Iterator[bytes]) -> tuple[int, list[int | None], bool]:
    """Of a range's bytes: the number of quotes, the places behind the first line feed after
    an even and after an odd number of them, and whether a quote stands inside a field."""
    quotes, begun, first, stray, last = 0, 0, [None, None], False, b""
    for block in blocks:
        stray = stray or STRAY_QUOTE.search(last + block) is not None
        if None in first:
            data = np.frombuffer(block, np.uint8)
            ends = np.flatnonzero(data == LINE_FEED)
            odd = (quotes + np.cumsum(data == QUOTE)[ends]) % 2
            for parity in (0, 1):
                found = ends[odd == parity]
                if first[parity] is None and len(found):
                    first[parity] = begun + int(found[0]) + 1
        quotes += block.count(b'"')
        begun += len(block)
        last = block[-2:]
    return quotes, first, stray


def _blocks(uri: str, start: int, end: int) -> Iterator[bytes]:
    filesystem, path = filesystem_and_path(uri)
    with filesystem.open_input_file(path) as source:
        source.seek(start)
        while start < end and (block := source.read(min(BLOCK_BYTES, end - start))):
            start += len(block)
            yield block


def record_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, end) of ranges of about so many bytes that hold whole records."""

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                scan_range(_blocks(path, at, min(at + range_bytes, length)))
                for path, at, length in zip(batch["path"], batch["at"], batch["length"])
            ]
            yield pd.DataFrame(
                {
                    "path": batch["path"], "at": batch["at"], "length": batch["length"],
                    "quotes": [f[0] for f in found],
                    "even": pd.array([f[1][0] for f in found], "Int64"),
                    "odd": pd.array([f[1][1] for f in found], "Int64"),
                    "stray": [f[2] for f in found],
                }
            )

    # a range is a task: there are few of them, and each is much to read
    pieces = files.where("length > 0").selectExpr(
        "path", "length", f"explode(sequence(0L, length - 1, {int(range_bytes)}L)) AS at"
    )
    ranges = pieces.mapInPandas(
        scanned, "path string, at long, length long, quotes long, even long, odd long, stray boolean"
    )
    in_order = Window.partitionBy("path").orderBy("at")
    whole = Window.partitionBy("path")
    before = F.coalesce(
        F.sum("quotes").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    regular = ~F.max("stray").over(whole) & (F.sum("quotes").over(whole) % 2 == 0)
    inside = F.when(before % 2 == 0, F.col("even")).otherwise(F.col("odd"))
    start = F.when(F.col("at") == 0, 0).when(regular, F.col("at") + inside)
    # a range without such a place belongs to the one before it
    begun = ranges.select("path", "length", start.alias("start")).where("start < length")
    after = F.lead("start").over(Window.partitionBy("path").orderBy("start"))
    return begun.select("path", "start", F.coalesce(after, "length").alias("end"))


def read_ranges(ranges: DataFrame, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """path and the wanted columns, bound by name, of all records of the ranges."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                for table in range_tables(path, start, end, columns):
                    paths = pa.array([path] * len(table), pa.string())
                    yield from table.add_column(0, "path", paths).combine_chunks().to_batches(
                        archive.RECORDS_PER_BATCH
                    )

    fields = ", ".join(["path string", *(f"`{c}` string" for c in columns)])
    return ranges.select("path", "start", "end").mapInArrow(rows, fields)


def range_tables(path: str, start: int, end: int, columns: list[str]) -> Iterator[pa.Table]:
    head = b""
    names, body = None, 0
    for block in _blocks(path, 0, sys.maxsize):
        # as much of the file as its header takes, and one more byte
        head += block
        names, body = archive.header_and_rest(head)
        if names is not None and body < len(head):
            break
    if names is None:
        return
    start = max(start, body)
    if end - start <= archive.WHOLE_MEMBER_BYTES:
        content = b"".join(_blocks(path, start, end))
        table = archive.body_table(content, 0, names, columns)
        if table is not None:
            yield table
            return
        stream = archive.as_text(io.BytesIO(content))
    else:
        stream = archive.as_text(io.BufferedReader(_Range(_blocks(path, start, end))))
    yield from archive.tables_of_records(archive.body_records(stream, names, columns), columns)


class _Range(io.RawIOBase):
    """Blocks as a stream of bytes."""

    def __init__(self, blocks: Iterator[bytes]):
        self._blocks, self._rest = blocks, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        if not self._rest:
            self._rest = next(self._blocks, b"")
        n = min(len(buffer), len(self._rest))
        buffer[:n], self._rest = self._rest[:n], self._rest[n:]
        return n


def read_csv_by_ranges(
    spark: SparkSession,
    folder: str,
    year: int | None = None,
    year_pattern: str = r"(\d{4})/[^/]*$",
    columns: list[str] = RAW_COLUMNS,
    glob: str = "*.csv",
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Raw text rows of all CSV files below a folder, as `station_csv.read_station_csv` has
    them, with large files dealt to many tasks though their fields may hold line breaks."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length")
    )
    in_year = (
        F.lit(year) if year is not None else F.regexp_extract("path", year_pattern, 1).try_cast("int")
    )
    ranges = record_ranges(files, range_bytes)
    dealt = ranges.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path", "start")
    return read_ranges(dealt, columns).select(*columns, in_year.cast("int").alias("year"))


ship_by_value(__name__)
