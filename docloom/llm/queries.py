"""Registered queries of the operators, with SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import (
    bpe,
    decontaminate,
    hard_negatives,
    language_model,
    licenses,
    line_dedup,
    line_rules,
    ngram_join,
    quality,
    spelling,
    sql,
    substring_dedup,
    token_counts,
    warc,
)
from docloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {
    "op5_line_rules": sql.LINE_RULES,
    "op7_warc": sql.ARCHIVES,
    "op8_decontaminate": sql.PASSAGES,
    "op9_substring_dedup": sql.REPEATS,
    "op10_ngram_join": sql.LINKED,
    "op12_hard_negatives": sql.HARD_NEGATIVES,
}

#: The vocabulary file; the same path on all workers.
VOCABULARY = os.environ.get("BPE_VOCABULARY") or "byte_bpe_50k.json"


def vocabulary_path() -> str:
    """An absolute path as given, or a file of the installed public tokenizers."""
    if os.path.isabs(VOCABULARY):
        return VOCABULARY
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(run: Query) -> Query:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)

    QUERIES[run.__name__] = configured
    return run


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return cut.selectExpr(
        "doc_id", "n_lines", "n_removed_lines", "emptied", "sha2(coalesce(text, ''), 256) AS kept_sha256"
    )


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.Classifier(documents, labels).scores()


@query
def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("payload")


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("limits")


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


@query
def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_negatives(table(spark, sf_dir, "embeddings"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants_of_documents(table(spark, sf_dir, "documents"))
