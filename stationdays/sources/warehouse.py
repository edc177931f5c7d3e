"""The observations dataset: Parquet, one partition per year, committed as a whole.

A write first puts all its files aside, then moves each year's into a folder of its own
below `year=...`, and last commits the list of folders that count (`snapshots`). Readers open
what the latest commit lists. So a year is seen old or new and never in part or not at
all, several years of one write change together, and a write that was killed at any point
leaves readers what they had. Who has opened the dataset goes on reading what it was then,
until `vacuum` removes the folders that no recent commit lists.

A folder of plain Parquet files without commits can be opened as well, as it is.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationdays.schema import OBSERVATIONS
from stationdays.sources import snapshots
from stationdays.sources.snapshots import Committed, Folder

VIEW = "observations"
STAGED = "_staged-"
FILES = "path string, length long"


@dataclass(frozen=True)
class Staged:
    """Files of one write, not yet part of the dataset."""

    folder: str
    write: str
    partition: str


def stage_observations(
    observations: DataFrame,
    folder: str,
    partition: str = "year",
    cluster: tuple[str, ...] = ("station", "date"),
    compression: str = "zstd",
    rebalance: bool = True,
) -> Staged:
    """Write rows beside the dataset; `commit_observations` makes them part of it.

    With `rebalance` rows are shuffled by partition value, and adaptive execution
    splits a large year over as many tasks as its size asks for: right for rows
    whose tasks each hold many years. Inside a file rows are then ordered by
    `cluster`, which keeps names and positions in long runs and makes row-group
    statistics selective. Without it nothing is shuffled or sorted by station:
    every task writes what it read, in its order. That is right for archives,
    whose tasks each hold one year, station by station.
    """
    if rebalance:
        observations = observations.hint("rebalance", partition).sortWithinPartitions(
            partition, *cluster
        )
    staged = Staged(folder.rstrip("/"), uuid.uuid4().hex, partition)
    (
        observations.write.option("compression", compression)
        .partitionBy(partition)
        .parquet(f"{staged.folder}/{STAGED}{staged.write}")
    )
    return staged


def commit_observations(
    spark: SparkSession, staged: Staged, whole: Iterable[int] = ()
) -> list[Committed]:
    """Make a staged write's years replace those of the dataset, all at once.

    `whole` names years that the write was to hold: those without a row are committed
    as years without rows, and so known not to need another ingest.
    """
    folder, aside = Folder(spark, staged.folder), f"{STAGED}{staged.write}"
    if snapshots.latest(spark, staged.folder) is None:
        adopt_plain_years(spark, staged.folder, staged.partition)
    rows = _rows(spark, staged.folder, aside, staged.partition)
    moved = {}
    for name in _parts(folder, aside, staged.partition):
        moved[name] = f"{name}/{staged.write}"
        folder.move(f"{aside}/{name}", moved[name])
    changes = _entries(spark, staged.folder, moved, rows)
    named = {f"{staged.partition}={int(y)}" for y in whole}
    changes += [
        Committed(name, None, 0, 0, 0, snapshots.NO_FILES) for name in sorted(named - set(moved))
    ]
    snapshots.commit(spark, staged.folder, changes)
    folder.remove(aside)
    return changes


def adopt_plain_years(spark: SparkSession, folder: str, partition: str = "year") -> None:
    """Commit the years of a folder that was written without commits.

    Their files move one level down, so this is no time to read that folder.
    """
    root, write = Folder(spark, folder), uuid.uuid4().hex
    moved = {}
    for name in _parts(root, "", partition):
        plain = [n for n in root.listed(name) if n.endswith(".parquet")]
        if plain:
            moved[name] = f"{name}/{write}"
            for file in plain:
                root.move(f"{name}/{file}", f"{moved[name]}/{file}")
    if moved:
        rows = {}
        for name, at in moved.items():
            rows[name] = spark.read.parquet(f"{folder}/{at}").count()
        snapshots.commit(spark, folder, _entries(spark, folder, moved, rows))


def _rows(spark: SparkSession, folder: str, aside: str, partition: str) -> dict[str, int]:
    """Rows of each year of a staged write, from the files' footers."""
    if not _parts(Folder(spark, folder), aside, partition):
        return {}
    value = F.col(partition).cast("string").alias("value")
    counted = spark.read.parquet(f"{folder}/{aside}").groupBy(value).count().collect()
    return {f"{partition}={r['value']}": r["count"] for r in counted}


def _entries(
    spark: SparkSession, folder: str, moved: dict[str, str], rows: dict[str, int]
) -> list[Committed]:
    sums = _file_sums(_files_below(spark, [f"{folder}/{at}" for at in moved.values()]))
    found = {r["folder"]: r for r in sums.collect()}
    return [
        Committed(name, at, rows.get(name, 0), *found[at][1:]) for name, at in moved.items()
    ]


def write_observations(
    observations: DataFrame, folder: str, whole: Iterable[int] = (), **how
) -> None:
    """Replace the years present in `observations`, and those in `whole`, leave the others."""
    staged = stage_observations(observations, folder, **how)
    commit_observations(observations.sparkSession, staged, whole)


def _parts(folder: Folder, name: str, partition: str) -> list[str]:
    return sorted(n for n in folder.listed(name) if n.startswith(f"{partition}="))


def _files_below(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length) of Parquet files: a listing, no file is opened."""
    if not paths:
        return spark.createDataFrame([], FILES)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(paths)
        .select("path", "length")
    )


def _file_sums(files: DataFrame) -> DataFrame:
    """Number, bytes and checksum of the files (path, length) of each write's year."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    place = F.regexp_extract("path", r"([^/]+/[^/]+)/[^/]+$", 1)
    return files.groupBy(place.alias("folder")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"),
        F.lower(F.lpad(F.hex(F.bit_xor(F.xxhash64(name, "length"))), 16, "0")).alias("checksum"),
    )


def open_observations(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | None = OBSERVATIONS,
    view: str | None = VIEW,
) -> DataFrame:
    """The whole dataset, as last committed, as one DataFrame and one view."""
    folder = folder.rstrip("/")
    committed = snapshots.latest(spark, folder)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if committed is None:
        if _plain_files(spark, folder).isEmpty():
            raise FileNotFoundError(f"no Parquet in {folder}; ingest some years first")
        observations = reader.parquet(folder)
    else:
        paths = [f"{folder}/{c.folder}" for c in committed.values() if c.folder]
        if not paths and schema is None:
            raise FileNotFoundError(f"no rows in {folder}")
        observations = (
            reader.option("basePath", folder).parquet(*paths)
            if paths else spark.createDataFrame([], schema)
        )
    if view:
        observations.createOrReplaceTempView(view)
    return observations


def _plain_files(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return _files_below(spark, [folder])
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return _files_below(spark, [])
        raise


def parquet_files(spark: SparkSession, folder: str) -> DataFrame:
    """(year, path, length) of the dataset's files, without those no longer or not yet in it."""
    folder = folder.rstrip("/")
    committed = snapshots.latest(spark, folder)
    if committed is None:
        files = _plain_files(spark, folder)
    else:
        files = _files_below(
            spark, [f"{folder}/{c.folder}" for c in committed.values() if c.folder]
        )
    year = F.regexp_extract("path", r"/year=(\d+)/", 1).try_cast("int")
    return files.select(year.alias("year"), "path", "length").where("year IS NOT NULL")


def count_files(spark: SparkSession, folder: str) -> int:
    return parquet_files(spark, folder).count()


def stored_years(spark: SparkSession, folder: str) -> DataFrame:
    """Every committed year: year, rows, files, bytes as committed, and `whole`, whether its
    files are all there and as large as they were. Opens no data file."""
    folder = folder.rstrip("/")
    schema = "year int, folder string, rows long, files long, bytes long, checksum string"
    entries = [
        (_year(c.partition), c.folder, c.rows, c.files, c.bytes, c.checksum)
        for c in (snapshots.latest(spark, folder) or {}).values()
    ]
    committed = spark.createDataFrame([e for e in entries if e[0] is not None], schema)
    # folders that are gone cannot be listed, so all that is there is
    found = _file_sums(_plain_files(spark, folder)).select(
        "folder", *[F.col(c).alias(f"found_{c}") for c in ("files", "bytes", "checksum")]
    )
    same = [F.col(c) == F.col(f"found_{c}") for c in ("files", "bytes", "checksum")]
    whole = F.col("folder").isNull() | F.coalesce(same[0] & same[1] & same[2], F.lit(False))
    return committed.join(found, "folder", "left").select(
        "year", "rows", "files", "bytes", whole.alias("whole")
    )


def _year(partition: str) -> int | None:
    value = partition.partition("=")[2]
    return int(value) if value.isdigit() else None


def committed_years(spark: SparkSession, folder: str) -> list[int]:
    """Years with rows, from the list of commits alone."""
    committed = (snapshots.latest(spark, folder.rstrip("/")) or {}).values()
    years = (_year(c.partition) for c in committed if c.rows)
    return sorted(y for y in years if y is not None)


def existing_years(spark: SparkSession, folder: str) -> DataFrame:
    """Years that need no ingest: committed, with or without rows, and undamaged since.

    Of a folder without commits it is every year that has a file.
    """
    if snapshots.latest(spark, folder.rstrip("/")) is None:
        return parquet_files(spark, folder).select("year").distinct()
    return stored_years(spark, folder).where("whole").select("year")


def vacuum(spark: SparkSession, folder: str, commits: int = 2, least_hours: float = 24.0) -> list[str]:
    """Remove what none of the last commits lists and nothing has changed for some hours:
    replaced years, and what killed writes have left. The names of what was removed.
    A folder without commits is left alone."""
    if snapshots.latest(spark, folder) is None:
        return []
    root, before = Folder(spark, folder), time.time() - 3600 * least_hours
    kept = snapshots.referenced(spark, folder, commits)
    stale = [n for n, changed in root.listed().items() if n.startswith(STAGED) and changed < before]
    for part in [n for n in root.listed() if "=" in n]:
        stale += [
            f"{part}/{write}" for write, changed in root.listed(part).items()
            if f"{part}/{write}" not in kept and changed < before
        ]
    for name in stale:
        root.remove(name)
    return sorted(stale)


def requested_years(spark: SparkSession, years: Iterable[int]) -> DataFrame:
    return spark.createDataFrame([(int(y),) for y in years], "year int")


def years_to_ingest(requested: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Requested years without a whole partition yet; all of them when forced."""
    wanted = requested.select("year").distinct()
    return wanted if force else wanted.join(existing.select("year"), "year", "left_anti")
