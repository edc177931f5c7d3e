"""Report sections as JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def write_section(section: DataFrame, folder: str, name: str) -> None:
    """One JSON object per row, keys in alphabetical order, nulls kept."""
    (
        section.select(*sorted(section.columns))
        .write.mode("overwrite")
        .option("ignoreNullFields", False)
        .json(f"{folder}/{name}")
    )


def write_report(sections: Mapping[str, DataFrame], folder: str) -> None:
    for name, section in sections.items():
        write_section(section, folder, name)


def read_section(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(f"{folder}/{name}")


def read_document_section(spark: SparkSession, document: str, name: str) -> DataFrame:
    """Rows of one array of records inside a JSON document."""
    return spark.read.option("multiLine", True).json(document).selectExpr(f"inline(`{name}`)")
