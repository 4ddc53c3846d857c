"""The corpus pipeline: documents to clean, distinct, uncontaminated, encoded documents.

Each stage takes the documents its predecessor kept and returns those it keeps, with their
columns; the last adds the token ids.  The stages are row-wise in ``doc_id`` and ``text``: nulls,
empty texts and repeated rows go through as the operators' modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, decontaminate, line_dedup, ngram_join, queries, quality
from docloom.session import configure, materialise


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    configure(spark)
    return quality.Classifier(docs, queries.table(spark, sf_dir, "labels")).keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier line; documents that have no other lines go."""
    configure(spark)
    return line_dedup.drop_lines(docs).where("not emptied").select(*docs.columns)


#: Near duplicates share at least 80 of 100 of their runs of five words.
NEAR = ngram_join.Rule(gram=5, percent=80)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by the n-gram join, under ``NEAR``, the one with the least id; the others go."""
    configure(spark)
    return ngram_join.keep_first(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark passages are less than one word in twenty."""
    configure(spark)
    found = decontaminate.find_passages(docs, queries.table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, the number of tokens, and the digest of the text decoded from the ids."""
    configure(spark)
    return bpe.round_trip(docs, queries.vocabulary_path())


STAGES = [
    ("quality classifier", keep_good_documents),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding", encode),
]

#: Learned scores, edit distances, set similarity and token ids have no SQL form; a test holds the
#: stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
