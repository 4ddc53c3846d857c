"""Expand requested files and folders into the documents below them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.fixed_values import (
    FILE_MIME_TYPES,
    METADATA_MIME_KEY,
    MIME_DOCUMENT,
    MIME_FOLDER,
    MIME_PRESENTATION,
    MIME_SPREADSHEET,
)
from docloom.functions.keys import id_from_url_or_id
from docloom.operators.ingest import add_mime
from docloom.session import materialise

EXTRACTABLE = [MIME_DOCUMENT, MIME_SPREADSHEET, MIME_PRESENTATION]


def folders_below(roots: DataFrame, parents: DataFrame) -> DataFrame:
    """(root, id) of every folder at or below a root, given (id, up) of every folder with a parent.

    The steps upward double: after round n every folder within 2**n steps of a root is known, so a tree
    a thousand folders deep takes ten rounds.  A round without a new pair ends the search, in cycles
    too, since what lies deeper lies below a folder that this round would have found.  Each round is
    written to the shared folder, so that the plan stays flat.
    """
    seen = roots.select("root", F.col("root").alias("id"))
    steps = materialise(parents.distinct(), "crawl")
    while True:
        below = steps.join(seen.withColumnRenamed("id", "up"), "up").select("root", "id").distinct()
        new = materialise(below.join(seen, ["root", "id"], "left_anti"), "crawl")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
        further = steps.select(F.col("id").alias("up"), F.col("up").alias("further"))
        steps = materialise(steps.join(further, "up").select("id", F.col("further").alias("up")).distinct(), "crawl")


def expand(transports: DataFrame, files: DataFrame) -> DataFrame:
    """Files reached from every transport: ``content_id, metadata, id, mime_type, failure``.

    Documents, sheets and slides are results, folders are searched in turn, other known
    types are skipped, and an unknown type or a missing file is a failure of that one
    file.  Only the folder rows take part in the search of :func:`folders_below`.  The files
    themselves are joined once, at the end, and when one folder holds very many of them
    adaptive execution splits its join.
    """
    wanted = transports.select("content_id", "metadata").withColumn("root", id_from_url_or_id(F.col("content_id")))
    unreadable = wanted.filter(F.col("root").isNull()).select(
        "content_id",
        "metadata",
        F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("mime_type"),
        F.lit("The link holds no file id").alias("failure"),
    )
    requested = wanted.filter(F.col("root").isNotNull())
    is_folder = F.coalesce(F.col("mime_type") == MIME_FOLDER, F.lit(False))

    roots = materialise(
        requested.select("root")
        .distinct()
        .join(files.select(F.col("id").alias("root"), "mime_type"), "root", "left"),
        "crawl",
    )
    parents = files.filter(is_folder & F.col("parent_id").isNotNull()).select("id", F.col("parent_id").alias("up"))
    seen = folders_below(roots.filter(is_folder).select("root"), parents)

    inside = (
        files.filter(~is_folder)
        .select("id", "parent_id", "mime_type")
        .join(seen.withColumnRenamed("id", "parent_id"), "parent_id")
        .select("root", "id", "mime_type")
    )
    reached = roots.filter(~is_folder).select("root", F.col("root").alias("id"), "mime_type").unionByName(inside)
    known = F.coalesce(F.col("mime_type").isin(FILE_MIME_TYPES), F.lit(False))
    results = (
        requested.join(reached.filter(~known | F.col("mime_type").isin(EXTRACTABLE)), "root")
        .select(
            "content_id",
            "metadata",
            "id",
            "mime_type",
            F.when(F.col("mime_type").isNull(), "No such file")
            .when(~known, F.concat(F.lit("Unknown file type: "), F.col("mime_type")))
            .alias("failure"),
        )
    )
    return results.unionByName(unreadable)


def documents_of(expanded: DataFrame) -> DataFrame:
    """Transports of the documents found; the MIME type is added to the metadata unless given."""
    return expanded.filter(F.col("failure").isNull()).select(
        F.col("id").alias("content_id"),
        add_mime(F.col("metadata"), F.col("mime_type"), METADATA_MIME_KEY).alias("metadata"),
    )


def failures_of(expanded: DataFrame) -> DataFrame:
    return expanded.filter(F.col("failure").isNotNull()).select("content_id", "metadata", "failure")
