"""Reading yearly `<year>.tar.gz` archives of per-station CSV files.

A Python data source, because Spark has no reader for tar. It only unpacks and
splits records into text columns, bound by header name; every interpretation of
the text is left to native expressions (`stationdays.sources.ingest`).

A gzip stream has one entry point, so a task must inflate an archive from its
start. Inflating is the smaller part of the work, so a large archive is read by
several tasks, each taking every n-th member. Only slices of one archive repeat
the inflating, and their number is bounded. Records are handed over in Arrow
batches as they are read: an archive is never held whole.

A member of usual size goes through Arrow's CSV parser. One that parser refuses
(records of different lengths, bytes that are not UTF-8), one of a few lines, or one too
large to hold, is read record by record. The header is found in one way for both, and
both give the same rows; a test holds them against each other on random bytes.
"""

from __future__ import annotations

import csv
import io
import operator
import re
import sys
import tarfile
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from operator import itemgetter

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
)

from stationdays.schema import RAW_COLUMNS, RAW_SCHEMA
from stationdays.sources.files import arrow_opens, filesystem_and_path, ship_by_value

FORMAT = "station_archive"
PUSH_FILTERS = "spark.sql.python.filterPushdown.enabled"
ARCHIVE_NAME = re.compile(r"^(\d{4})\.tar\.gz$")
RECORDS_PER_BATCH = 8192
FEW_LINES_BYTES = 8 << 10
WHOLE_MEMBER_BYTES = 64 << 20
LEAST_SLICE_BYTES = 4 << 20
MOST_SLICES = 8
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n|\Z)")
ODD_LINE_ENDS = re.compile(rb"\r(?!\n)")


class ArchiveSlice(InputPartition):
    """Members slice, slice + slices, slice + 2 * slices ... of one archive."""

    def __init__(self, uri: str, year: int, slice_number: int, slices: int):
        self.uri = uri
        self.year = year
        self.slice_number = slice_number
        self.slices = slices


def list_archives(folder: str) -> list[tuple[str, int, int]]:
    """(uri, year, bytes) of every archive below a folder."""
    filesystem, root = filesystem_and_path(folder)
    found = []
    below = pafs.FileSelector(root, recursive=True, allow_not_found=True)
    for info in filesystem.get_file_info(below):
        named = ARCHIVE_NAME.match(info.base_name)
        if named and info.type == pafs.FileType.File:
            below = info.path.removeprefix(root.rstrip("/")).lstrip("/")
            found.append((f"{folder.rstrip('/')}/{below}", int(named.group(1)), info.size))
    return sorted(found)


COMPARED = {
    EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt,
    GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
}


def year_test(condition: Filter) -> Callable[[int], bool] | None:
    """A condition on the year of an archive, None for any other condition."""
    if isinstance(condition, Not):
        inner = year_test(condition.child)
        return None if inner is None else lambda year: not inner(year)
    if getattr(condition, "attribute", None) != ("year",):
        return None
    if isinstance(condition, IsNotNull):
        return lambda year: True
    if isinstance(condition, In):
        return lambda year: year in condition.value
    compare = COMPARED.get(type(condition))
    # (comparing with NULL, which is never true, is left to Spark)
    if compare is None or condition.value is None:
        return None
    return lambda year: compare(year, condition.value)


def slices_for(size: int, slice_bytes: int) -> int:
    return max(1, min(MOST_SLICES, -(-size // slice_bytes)))


def header_names(lines: Iterable[str]) -> list[str] | None:
    """Names of the first record that isn't blank; a byte order mark before it is no name.

    Both readers of members bind columns by this. None if there is no record.
    """
    records = csv.reader(lines)
    return next((record for record in records if any(record)), None)


def without_mark(lines: Iterable[str]) -> Iterator[str]:
    lines = iter(lines)
    first = next(lines, None)
    if first is not None:
        yield first.removeprefix("\ufeff")
        yield from lines


def member_records(stream: io.TextIOBase, columns: list[str]) -> Iterator[tuple]:
    """Records of one CSV file as tuples of the wanted columns, found by name.

    A column the header lacks, or a record too short to reach it, gives None.
    """
    lines = without_mark(stream)
    header = header_names(lines)
    if header is not None:
        yield from body_records(lines, header, columns)


def body_records(lines: Iterable[str], header: list[str], columns: list[str]) -> Iterator[tuple]:
    """The same of what follows the header."""
    records = csv.reader(lines)
    position = {name: i for i, name in enumerate(header)}
    absent = len(header)
    wanted = [position.get(c, absent) for c in columns]
    # (the repeated column keeps the result a tuple when only one is wanted)
    pick = itemgetter(*wanted, wanted[0])
    padding = [None] * (absent + 1)
    for record in records:
        if record:
            del record[absent:]
            yield pick(record + padding[len(record):])[:-1]


def table_of(records: list[tuple], columns: list[str]) -> pa.Table:
    return pa.table([pa.array(values, pa.string()) for values in zip(*records)], names=columns)


def tables_of_records(records: Iterable[tuple], columns: list[str]) -> Iterator[pa.Table]:
    records = iter(records)
    while some := list(islice(records, RECORDS_PER_BATCH)):
        yield table_of(some, columns)


def header_and_rest(content: bytes) -> tuple[list[str] | None, int]:
    """The names of a file's header, and where the bytes behind that record begin."""
    end = len(BYTE_ORDER_MARK) if content.startswith(BYTE_ORDER_MARK) else 0

    def lines() -> Iterator[str]:
        nonlocal end
        for line in LINE.finditer(content, end):
            if line.group():
                end = line.end()
                yield line.group().decode("utf-8", "replace")

    # the reader asks for no more lines than the record has
    return header_names(lines()), end


def regular_table(content: bytes, columns: list[str]) -> pa.Table | None:
    """The wanted columns of a regular CSV file, None if it is not regular.

    Arrow's parser gets the bytes behind the header, and columns by number, so both
    readers have the same header and the same place for every name.
    """
    names, start = header_and_rest(content)
    return None if names is None else body_table(content, start, names, columns)


def body_table(
    content: bytes, start: int, names: list[str], columns: list[str]
) -> pa.Table | None:
    """The same of the bytes from a place on, for a header read before."""
    # Arrow would take a byte order mark there for none of the file's text
    odd = content.startswith(BYTE_ORDER_MARK, start) or ODD_LINE_ENDS.search(content, start)
    if odd or content.endswith(b'"'):
        return None
    position = {name: str(i) for i, name in enumerate(names)}
    found = [c for c in columns if c in position]
    numbers = [position[c] for c in found]
    try:
        table = pacsv.read_csv(
            pa.BufferReader(pa.py_buffer(content).slice(start)),
            read_options=pacsv.ReadOptions(
                use_threads=False, block_size=len(content) + 1,
                column_names=[str(i) for i in range(len(names))],
            ),
            parse_options=pacsv.ParseOptions(newlines_in_values=True),
            convert_options=pacsv.ConvertOptions(
                column_types={n: pa.string() for n in numbers},
                include_columns=numbers,
                strings_can_be_null=False,
            ),
        )
    except pa.ArrowInvalid:
        return None
    if not found:
        return None
    absent = pa.nulls(len(table), pa.string())
    return pa.table(
        [table.column(position[c]) if c in position else absent for c in columns], names=columns
    )


def as_text(stream: io.BufferedIOBase) -> io.TextIOWrapper:
    return io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="")


def member_tables(
    archive: tarfile.TarFile, members: Iterable[tarfile.TarInfo], columns: list[str]
) -> Iterator[pa.Table]:
    """All members' records; those of small members share a table."""
    few: list[tuple] = []
    for member in members:
        stream = archive.extractfile(member)
        if member.size <= FEW_LINES_BYTES:
            few.extend(member_records(as_text(stream), columns))
            if len(few) >= RECORDS_PER_BATCH:
                yield table_of(few, columns)
                few.clear()
            continue
        if member.size <= WHOLE_MEMBER_BYTES:
            content = stream.read()
            table = regular_table(content, columns)
            if table is not None:
                yield table
                continue
            stream = io.BytesIO(content)
        yield from tables_of_records(member_records(as_text(stream), columns), columns)
    if few:
        yield table_of(few, columns)


def batches_of_year(tables: Iterable[pa.Table], year: int) -> Iterator[pa.RecordBatch]:
    """The tables' rows in batches of some size, with the year."""
    waiting: list[pa.Table] = []
    rows = 0

    def batches() -> list[pa.RecordBatch]:
        together = pa.concat_tables(waiting).combine_chunks()
        years = pa.array([year] * len(together), pa.int32())
        return together.append_column("year", years).to_batches(RECORDS_PER_BATCH)

    for table in tables:
        waiting.append(table)
        rows += len(table)
        if rows >= RECORDS_PER_BATCH:
            yield from batches()
            waiting.clear()
            rows = 0
    if rows:
        yield from batches()


class ArchiveReader(DataSourceReader):
    def __init__(
        self,
        folder: str,
        years: set[int] | None,
        columns: list[str],
        tasks: int = 1,
        slice_bytes: int | None = None,
    ):
        self.folder = folder
        self.years = years
        self.columns = columns
        self.tasks = tasks
        self.slice_bytes = slice_bytes
        self.tests: list[Callable[[int], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the year choose archives, and hold for all of their rows; others are
        handed back."""
        for condition in filters:
            test = year_test(condition)
            if test is None:
                yield condition
            else:
                self.tests.append(test)

    def partitions(self) -> list[ArchiveSlice]:
        chosen = [
            found for found in list_archives(self.folder)
            if self.years is None or found[1] in self.years
        ]
        chosen = [found for found in chosen if all(test(found[1]) for test in self.tests)]
        # as many slices as keep the tasks busy: many archives are not cut at all,
        # and of a few the largest are cut most
        even = sum(size for _, _, size in chosen) // self.tasks
        slice_bytes = self.slice_bytes or max(LEAST_SLICE_BYTES, even)
        out = []
        for uri, year, size in chosen:
            slices = slices_for(size, slice_bytes)
            out += [ArchiveSlice(uri, year, k, slices) for k in range(slices)]
        return out

    def read(self, partition: ArchiveSlice) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        filesystem, path = filesystem_and_path(partition.uri)
        with filesystem.open_input_file(path) as source, tarfile.open(
            fileobj=source, mode="r:gz"
        ) as archive:
            tables = member_tables(archive, self.members(archive, partition), self.columns)
            yield from batches_of_year(tables, partition.year)

    @staticmethod
    def members(archive: tarfile.TarFile, partition: ArchiveSlice) -> Iterator[tarfile.TarInfo]:
        files = (m for m in archive if m.isfile() and m.name.endswith(".csv"))
        for number, member in enumerate(files):
            if number % partition.slices == partition.slice_number:
                yield member
            # tarfile remembers every member; forget the ones already read
            archive.members = []


class StationArchives(DataSource):
    """spark.read.format("station_archive").option("years", "2023,2024").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return RAW_SCHEMA

    def reader(self, schema: T.StructType) -> ArchiveReader:
        years = self.options.get("years")
        return ArchiveReader(
            folder=self.options["path"],
            years=None if years is None else {int(y) for y in years.split(",") if y.strip()},
            columns=[f.name for f in schema.fields if f.name != "year"],
            tasks=int(self.options.get("tasks", 1)),
            slice_bytes=int(self.options.get("slicebytes", 0)) or None,
        )


def read_archives(
    spark: SparkSession,
    folder: str,
    years: Iterable[int] | None = None,
    slice_bytes: int | None = None,
) -> DataFrame:
    """Raw text rows of the archives below a folder, with the archive's year.

    `years`, and conditions on the column `year`, prune whole archives before any is opened.
    A slice is sized to give every core two tasks, or as `slice_bytes` says.

    Where only Spark knows the folder's filesystem, archives come as whole binary values of
    up to 2 GB, one task each, and conditions on the year are applied to rows.
    """
    if not arrow_opens(folder):
        return _read_through_spark(spark, folder, years)
    spark.conf.set(PUSH_FILTERS, "true")
    spark.dataSource.register(StationArchives)
    tasks = 2 * spark.sparkContext.defaultParallelism
    reader = spark.read.format(FORMAT).option("tasks", str(tasks))
    if slice_bytes is not None:
        reader = reader.option("slicebytes", str(slice_bytes))
    if years is not None:
        reader = reader.option("years", ",".join(str(y) for y in years))
    return reader.load(folder)


def archive_files(spark: SparkSession, folder: str, years: Iterable[int] | None = None) -> DataFrame:
    """(path, year, length, content) of archives below a folder of any filesystem of Spark's;
    contents are read only if they are asked for."""
    names = "*" if years is None else "{" + ",".join(str(int(y)) for y in sorted(set(years))) + "}"
    year = F.regexp_extract("path", r"/(\d{4})\.tar\.gz$", 1).try_cast("int")
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"{names}.tar.gz")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", year.alias("year"), "length", "content")
        .where("year IS NOT NULL")
    )


def archive_years(spark: SparkSession, folder: str) -> set[int]:
    """Years that have an archive below a folder."""
    return {r["year"] for r in archive_files(spark, folder).select("year").distinct().collect()}


def _read_through_spark(
    spark: SparkSession, folder: str, years: Iterable[int] | None
) -> DataFrame:
    schema = RAW_SCHEMA
    columns = schema.names[:-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for i in range(batch.num_rows):
                year, content = (batch.column(c)[i] for c in ("year", "content"))
                source = pa.BufferReader(content.as_buffer())
                with tarfile.open(fileobj=source, mode="r:gz") as archive:
                    whole = ArchiveSlice("", year.as_py(), 0, 1)
                    members = ArchiveReader.members(archive, whole)
                    yield from batches_of_year(member_tables(archive, members, columns), whole.year)

    if years is not None and not (years := set(years)):
        return spark.createDataFrame([], schema)
    return archive_files(spark, folder, years).select("year", "content").mapInArrow(rows, schema)


assert RAW_SCHEMA.names[-1] == "year" and RAW_SCHEMA.names[:-1] == RAW_COLUMNS
ship_by_value(__name__)
