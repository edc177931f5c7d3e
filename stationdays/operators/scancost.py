"""What a scan of some columns reads, from Parquet footers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationdays.functions import ratio, scan_price
from stationdays.sources.files import filesystem_and_path, ship_by_value

CHUNKS = "file string, row_group int, column string, compressed long, uncompressed long"


def footer_chunks(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for uri in batch["path"]:
            filesystem, path = filesystem_and_path(uri)
            with filesystem.open_input_file(path) as source:
                footer = pq.ParquetFile(source).metadata
            groups = [footer.row_group(g) for g in range(footer.num_row_groups)]
            chunks = [
                (uri, g, chunk.path_in_schema.split(".")[0],
                 chunk.total_compressed_size, chunk.total_uncompressed_size)
                for g, group in enumerate(groups)
                for chunk in (group.column(i) for i in range(group.num_columns))
            ]
            yield pd.DataFrame(
                chunks, columns=["file", "row_group", "column", "compressed", "uncompressed"]
            )


def column_chunks(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """One row per file, row group and column; reads footers only, on the executors."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length")
    )
    return file_chunks(files)


def file_chunks(files: DataFrame) -> DataFrame:
    """The same for listed files (path, length)."""
    return files.select("path", "length").mapInPandas(footer_chunks, CHUNKS)


def column_bytes(chunks: DataFrame) -> DataFrame:
    """Bytes by column."""
    return chunks.groupBy("column").agg(
        F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed")
    )


def column_scan_cost(
    sizes: DataFrame,
    columns: Sequence[str],
    rate_per_tebibyte: float,
    measure: str = "uncompressed",
) -> DataFrame:
    """All columns against the named ones: bytes, saving, ratio and prices."""
    size = F.col(measure)
    named = F.coalesce(F.sum(F.when(F.col("column").isin(list(columns)), size)), F.lit(0))
    both = sizes.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("all_columns_bytes"),
        named.alias("named_columns_bytes"),
    ).withColumn("bytes_saved", F.col("all_columns_bytes") - F.col("named_columns_bytes"))
    return both.select(
        "*",
        F.bround(ratio(F.col("all_columns_bytes"), F.col("named_columns_bytes")), 1).alias(
            "scan_ratio"
        ),
        scan_price(F.col("all_columns_bytes"), rate_per_tebibyte).alias("all_columns_price"),
        scan_price(F.col("named_columns_bytes"), rate_per_tebibyte).alias("named_columns_price"),
        scan_price(F.col("bytes_saved"), rate_per_tebibyte).alias("price_saved"),
    )


ship_by_value(__name__)
