"""Provenance: which file each year came from, with its checksum."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationdays.schema import MANIFEST
from stationdays.sources.files import filesystem_and_path, ship_by_value

HASH_CHUNK = 1 << 20
# A file up to this size is hashed as one binary value by Spark itself; a larger
# one is streamed, since a binary value ends at 2 GiB.
WHOLE_FILE_BYTES = 256 << 20

MISSING_NOTE = "no archive left to take a checksum from; a forced ingest would need a new one"


def streamed_sha256(uri: str) -> str:
    digest = hashlib.sha256()
    filesystem, path = filesystem_and_path(uri)
    # the bytes as stored: by default a .gz would be inflated
    with filesystem.open_input_stream(path, compression=None) as stream:
        while block := stream.read(HASH_CHUNK):
            digest.update(block)
    return digest.hexdigest()


def streamed_checksums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(sha256=[streamed_sha256(p) for p in batch["path"]])


def file_manifest(
    spark: SparkSession,
    folder: str,
    glob: str = "*.tar.gz",
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> DataFrame:
    """(path, file, size_bytes, modified, sha256) of the files below a folder."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    attributes = ["path", "length as size_bytes", "modificationTime as modified"]
    small = files.where(F.col("length") <= whole_file_bytes).selectExpr(
        *attributes, "sha2(content, 256) as sha256"
    )
    large = (
        files.where(F.col("length") > whole_file_bytes)
        .selectExpr(*attributes)
        .mapInPandas(
            streamed_checksums, "path string, size_bytes long, modified timestamp, sha256 string"
        )
    )
    return small.unionByName(large).select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
        "size_bytes",
        "modified",
        "sha256",
    )


def archive_glob(years: Iterable[int]) -> str:
    """Only these years' archives: others are listed but never opened."""
    return "{" + ",".join(str(int(y)) for y in sorted(set(years))) + "}.tar.gz"


def archive_provenance(files: DataFrame) -> DataFrame:
    """file_manifest rows of archives, one per year their names state.

    A year may come in several archives; its checksum is then that of their
    checksums in order.
    """
    year = F.regexp_extract("file", r"^(\d{4})\.tar\.gz$", 1).try_cast("int")
    return (
        files.select(year.alias("year"), "file", "size_bytes", "sha256")
        .where("year IS NOT NULL")
        .groupBy("year")
        .agg(
            F.expr("if(count(*) = 1, max(file), concat(count(*), ' files')) AS file"),
            F.sum("size_bytes").alias("size_bytes"),
            F.expr(
                "if(count(*) = 1, max(sha256),"
                " sha2(array_join(array_sort(collect_list(sha256)), ''), 256)) AS sha256"
            ),
        )
    )


def manifest_entries(
    years: DataFrame,
    provenance: DataFrame,
    measured: DataFrame | None = None,
    note: str = MISSING_NOTE,
) -> DataFrame:
    """One entry per year; a year whose archive is gone says so.

    `years` carries year and whatever is known of its table; `measured` adds
    rows and stations of the years just ingested.
    """
    entries = years.join(provenance, "year", "left")
    if measured is not None:
        entries = entries.join(measured, "year", "left")
    return entries.withColumn(
        "provenance_note", F.when(F.col("sha256").isNull(), F.lit(note))
    )


def year_sizes(observations: DataFrame) -> DataFrame:
    """rows and stations by year."""
    return observations.groupBy("year").agg(
        F.count("*").alias("rows"), F.countDistinct("station").alias("stations")
    )


def manifest_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """All entries, with the new one where both know a year, sorted by year."""
    both = old.withColumn("_newer", F.lit(0)).unionByName(
        new.withColumn("_newer", F.lit(1)), allowMissingColumns=True
    )
    return latest_entries(both, "_newer")


def latest_entries(entries: DataFrame, generation: str = "generation") -> DataFrame:
    newest_first = Window.partitionBy("year").orderBy(F.desc(generation))
    return (
        entries.withColumn("_rank", F.row_number().over(newest_first))
        .where("_rank = 1")
        .drop("_rank", generation)
        .orderBy("year")
    )


def append_manifest(entries: DataFrame, folder: str, generation: int) -> None:
    """Add entries to the log. Nothing is rewritten, so nothing can get lost."""
    known = [F.col(f.name) if f.name in entries.columns else F.lit(None).cast(f.dataType).alias(f.name)
             for f in MANIFEST.fields[:-1]]
    (
        entries.select(*known, F.lit(generation).cast("long").alias("generation"))
        .write.mode("append")
        .option("ignoreNullFields", False)
        .json(folder)
    )


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest entry of every year in the log."""
    return latest_entries(spark.read.schema(MANIFEST).json(folder))


ship_by_value(__name__)
