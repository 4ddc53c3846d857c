"""Listing and deleting indexed content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import keys
from docloom.operators import index
from docloom.sources import stores


def list_keys(content: DataFrame) -> DataFrame:
    return stores.row_keys(content)


def list_documents(content: DataFrame) -> DataFrame:
    """Name and file id of every indexed file."""
    parts = keys.key_parts(F.col("row_key"))
    return (
        content.select(parts.alias("p"))
        .filter(F.size("p") == 3)
        .select(F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("drive_id"))
        .distinct()
    )


def list_urls(content: DataFrame, files: DataFrame) -> DataFrame:
    """View link of every indexed file."""
    ids = stores.distinct_file_ids(content)
    return files.select(F.col("id").alias("file_id"), "web_view_link").join(ids, "file_id", "left_semi")


def delete_keys(vectors: DataFrame, content: DataFrame, row_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given keys."""
    gone = row_keys.select("row_key").distinct()
    return (
        index.delete_ids(vectors, gone.select(F.col("row_key").alias("id"))),
        index.delete_rows(content, gone),
    )


def keys_of(content: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk keys of the given (name, drive_id) pairs."""
    parts = keys.key_parts(F.col("row_key"))
    named = (
        content.select("row_key", parts.alias("p"))
        .filter(F.size("p") == 3)
        .select("row_key", F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("drive_id"))
    )
    return named.join(documents.select("name", "drive_id").distinct(), ["name", "drive_id"], "left_semi").select(
        "row_key"
    )


def delete_documents(vectors: DataFrame, content: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without any chunk of the given documents."""
    return delete_keys(vectors, content, keys_of(content, documents))
