"""Scans and lookups over the content, session, file and vector tables.

A point read of the store becomes a join for a whole table of wanted keys.  Only the
wanted keys travel: the large table is first cut down by a semi join, which Spark
turns into a broadcast or a run-time Bloom filter when the wanted side is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.fixed_values import FILE_MIME_TYPES, MIME_UNKNOWN
from docloom.functions import keys
from docloom.functions.text import is_blank


def scan_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", "embedding")


def row_keys(content: DataFrame) -> DataFrame:
    """Every content key once."""
    return content.select("row_key").distinct()


def distinct_file_ids(content: DataFrame) -> DataFrame:
    """File ids behind the three-part keys, once each; other keys hold no file."""
    return (
        content.select(keys.file_id(F.col("row_key")).alias("file_id")).filter("file_id <> ''").distinct()
    )


def keys_of_documents(content: DataFrame, documents: DataFrame) -> DataFrame:
    """All content keys of the wanted documents, by equality on the document key.

    Unlike a prefix scan this cannot pick up ``doc10`` while looking for ``doc1``.
    """
    existing = content.select("row_key").withColumn("doc_key", keys.doc_key(F.col("row_key")))
    return existing.join(documents.select("doc_key").distinct(), "doc_key", "left_semi").distinct()


def latest_cells(cells: DataFrame) -> DataFrame:
    """Newest ``content`` and ``link`` of every row; a missing cell is ``''``.

    One aggregation with map-side combine, whatever the number of versions.
    """

    def newest(qualifier: str):
        mine = F.col("qualifier") == qualifier
        return F.coalesce(F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col("ts"))), F.lit(""))

    return cells.groupBy("row_key").agg(newest("content").alias("content"), newest("link").alias("link"))


def content_by_key(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Content and link of each wanted ``row_key``; a missing row gives ``''`` for both."""
    needed = wanted.select("row_key").distinct()
    found = latest_cells(cells.join(needed, "row_key", "left_semi"))
    return needed.join(found, "row_key", "left").select(
        "row_key",
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("link", F.lit("")).alias("link"),
    )


def session_exchanges(exchanges: DataFrame, sessions: DataFrame) -> DataFrame:
    """Stored exchanges of the wanted sessions; a blank session has none.

    The order is the ``ts`` column: rows stay rows, so a very long session is never
    gathered into one list.
    """
    wanted = sessions.filter(~is_blank(F.col("session"))).select("session").distinct()
    return exchanges.join(wanted, "session", "left_semi")


def children(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Direct children of each folder."""
    wanted = folders.select(F.col("id").alias("parent_id")).distinct()
    return files.join(wanted, "parent_id", "left_semi")


def file_metadata(files: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("id").distinct().join(files, "id")


def file_types(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """MIME type of each wanted file id, the unknown type where there is no such file."""
    ids = wanted.select("id").distinct()
    known = files.select("id", F.when(F.col("mime_type").isin(FILE_MIME_TYPES), F.col("mime_type")).alias("m"))
    return ids.join(known, "id", "left").select("id", F.coalesce("m", F.lit(MIME_UNKNOWN)).alias("mime_type"))
