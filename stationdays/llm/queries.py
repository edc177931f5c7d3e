"""The operators of this package as queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from stationdays.checks.tables import table
from stationdays.llm import (
    classifier,
    jaccard,
    language,
    let_tasks_import,
    licences,
    lines,
    mixing,
    packing,
    prefix_trie,
    repeats,
    rules,
    token_files,
    topk,
    word_runs,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        let_tasks_import(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classifier.quality_scores(documents, labels)


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.embedding_top_k(table(spark, sf_dir, "embeddings"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(table(spark, sf_dir, "documents"))


@query
def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(table(spark, sf_dir, "documents"))


@query
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_report(table(spark, sf_dir, "documents"))


@query
def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_digest(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup_digest(table(spark, sf_dir, "documents"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(table(spark, sf_dir, "conversations"))


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


@query
def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.run_digest(table(spark, sf_dir, "documents"))


# the others cannot be said in SQL, or not at a bearable cost; tests hold them against
# brute force
ORACLE_SQL = {
    "op2_quality_rules": rules.ORACLE,
    "op3_exact_top_k": topk.ORACLE,
    "op7_licence_scan": licences.ORACLE,
    "op9_line_dedup": lines.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_word_runs": word_runs.ORACLE,
}
