"""Token ids of documents in ORC files, in ascending order of document ids.

Ids are integers in ORC's run-length encoding; files have row indexes and Bloom filters
on the document id, so a reader skips files, stripes and row groups that cannot hold the
ids it asks for, and stripes are read in parallel.

A null text is an empty one, of the end id alone. Null document ids come first. Rows with
one document id stand next to each other and are numbered by number of ids, then checksum.
An empty table gives files without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationdays.llm.tokens import crc32, encode_batch
from stationdays.llm.kept import cut_lineage
from stationdays.session import scratch_folder

VOCABULARY = "word_bpe_49k.json"
END = 1


def token_rows(documents: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """doc_id, ids of each document's text with the end id, rows in the order they come."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, ids, starts in encode_batch(batch, vocabulary, end):
                part = batch.column("doc_id").slice(which.start, which.stop - which.start)
                values = pa.array(ids.astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part, lists], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, ids array<int>"
    )


def write_token_files(
    documents: DataFrame,
    folder: str,
    vocabulary: str = VOCABULARY,
    end: int = END,
    files: int | None = None,
    stride: int = 1000,
) -> None:
    """Writes a folder of ORC files whose names follow the order of document ids.

    Texts are dealt out in ranges of ids and sorted; only then are they encoded, straight
    into the files, so ids are neither shuffled nor spilled.
    """
    files = files or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        documents.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(files, "doc_id")
        .sortWithinPartitions("doc_id")
    )
    (
        token_rows(ordered, vocabulary, end)
        .write.option("orc.compress", "ZSTD")
        .option("orc.row.index.stride", stride)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(folder)
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, ids array<int>").orc(folder)


def token_file_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in a folder of token files.

    A document starts where the files before its own and the documents before it in its
    file end; only one number a file is summed up over all files.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            # a slice's offsets need not begin at 0
            offsets = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False)
            sums = [crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("file"),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ],
                ["doc_id", "file", "n_tokens", "ids_crc32"],
            )

    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)[^/]*$", 1).cast("long")
    read = cut_lineage(
        read_token_files(spark, folder)
        .select("doc_id", "ids", part.alias("file"))
        .mapInArrow(rows, "doc_id long, file long, n_tokens long, ids_crc32 long")
    )
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        read.groupBy("file")
        .agg(F.sum("n_tokens").alias("in_file"))
        .select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("file_start"))
    )
    earlier = (
        Window.partitionBy("file")
        .orderBy("doc_id", "n_tokens", "ids_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))
    return read.join(files, "file").select(
        "doc_id", (F.col("file_start") + inside).alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(documents: DataFrame) -> DataFrame:
    """Writes documents to a new folder of token files and describes what it reads back."""
    spark = documents.sparkSession
    folder = scratch_folder(spark, "tokens")
    write_token_files(documents, folder)
    return token_file_digest(spark, folder)
