"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and works
on all of it. All stages but the last return the columns of documents. `run` writes every
stage's result as Parquet and reads it again, so a lost executor costs no earlier stage.
Empty tables, nulls and repeated rows are treated as each operator says.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stationdays.checks.tables import table  # noqa: E402
from stationdays.llm import classifier, jaccard, let_tasks_import, lines, mixing, packing  # noqa: E402
from stationdays.llm.kept import release_shuffles  # noqa: E402
from stationdays.session import scratch_folder  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    let_tasks_import(spark)
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score_documents(docs, model, "__score")
    return scored.where(F.col("__score") >= classifier.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share, and their new lengths."""
    kept = lines.dedup_lines(docs, counts=False).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    let_tasks_import(spark)
    # the stages before are written; their shuffles would lie about until a collection
    release_shuffles(spark)
    return jaccard.one_of_each(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of sources takes it."""
    release_shuffles(spark)
    return mixing.copied(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of one length."""
    let_tasks_import(spark)
    release_shuffles(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_duplicates),
    ("source_mixture", mixture),
    ("best_fit_packing", packed),
]

# models, tokens and Newton steps cannot be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
