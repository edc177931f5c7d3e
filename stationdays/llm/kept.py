"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from stationdays.session import scratch_folder

BATCH_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut_lineage(frame: DataFrame, *done: DataFrame) -> DataFrame:
    """Computes a table once, writes it, and goes on from what was written.

    A checkpoint would compute the last stage twice, and tell the optimizer no size. The
    tables `done`, from earlier calls, are removed as soon as this one is whole.
    """
    spark = frame.sparkSession
    folder = scratch_folder(spark, "kept")
    frame.write.parquet(folder)
    kept = spark.read.schema(frame.schema).parquet(folder)
    kept._kept_folder = folder
    forget(*done)
    return kept


def forget(*frames: DataFrame | None) -> None:
    """Removes tables that `cut_lineage` wrote and nothing reads any more.

    What else is given is left alone. Spark removes the files of shuffles once the driver's
    collectors find that no plan needs them, so these are asked to look.
    """
    spark = None
    for frame in frames:
        folder = getattr(frame, "_kept_folder", None)
        if folder is not None:
            spark = frame.sparkSession
            jvm = frame.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            configuration = frame.sparkSession._jsparkSession.sessionState().newHadoopConf()
            path.getFileSystem(configuration).delete(path, True)
            frame._kept_folder = None
    if spark is not None:
        release_shuffles(spark)


@contextmanager
def small_batches(spark: SparkSession, records: int) -> Iterator[None]:
    """Hands rows to Python so many at a time, for jobs whose rows may be large: a batch is
    held whole on either side."""
    before = spark.conf.get(BATCH_RECORDS)
    spark.conf.set(BATCH_RECORDS, str(min(records, int(before)) if int(before) > 0 else records))
    try:
        yield
    finally:
        spark.conf.set(BATCH_RECORDS, before)


def release_shuffles(spark: SparkSession) -> None:
    """Has the files of shuffles removed that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
