"""Operators for training-data pipelines. Nothing else in the library imports them."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def let_tasks_import(spark: SparkSession) -> None:
    """Tasks find this library where the driver has it, if it is there.

    A cluster whose machines don't share that folder gets the library by --py-files.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), ROOT])
