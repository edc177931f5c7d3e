"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_local_scratch: str | None = None


def local_session(cores: str = "8", app: str = "stationdays", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    settings = {
        "spark.sql.shuffle.partitions": "8" if cores == "*" else cores,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        # small data on few cores: a shuffle of a megabyte is still worth splitting
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a one-machine session may fall back to a temporary folder: on a cluster
    that would be a different folder on every node.
    """
    global _local_scratch
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="stationdays-")
    return _local_scratch


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder under the shared scratch folder."""
    return f"{scratch_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Compute once and keep reliably, so later steps neither repeat nor lose it."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(frame.sparkSession))
    return frame.checkpoint(eager=True)
