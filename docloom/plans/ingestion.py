"""Message to index: the whole ingestion as one batch plan.

The same function serves a table of messages and each micro-batch of a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.fixed_values import METADATA_MIME_KEY
from docloom.functions import keys
from docloom.operators import chunk, crawl, errors, extract, index, inference, ingest
from docloom.session import materialise
from docloom.sources.versions import MOST_PARTS, Change, Snapshot, Store, Table


@dataclass
class FileStore:
    """Tables that stand for the file service: the tree, and one body table per kind."""

    files: DataFrame
    documents: DataFrame
    sheets: DataFrame
    slides: DataFrame


@dataclass
class Models:
    """Injected model functions; the defaults need no model.

    With ``pages`` (url, html) linked contents are read from that table instead of by ``chunk_links``.
    """

    embed: inference.Embed | None = None
    chunk_links: inference.ChunkLinks = inference.describe_links
    pages: DataFrame | None = None


@dataclass
class Ingested:
    contents: DataFrame
    rows: DataFrame
    errors: DataFrame


def contents_of_messages(messages: DataFrame, store: FileStore, ascii_titles: bool = False) -> tuple[DataFrame, DataFrame]:
    """Contents (with the file's MIME type, where there is one, their time and owner) and classified errors.

    What a message holds itself is as old as the message; files are read now.
    """
    # written once: every branch below reads only its own columns of it, and nothing is parsed again
    routed = materialise(ingest.route(ingest.parse_requests(messages)), "routed")
    raw = ingest.raw_contents(routed)
    references = ingest.reference_contents(routed)
    wanted = ingest.drive_transports(routed)
    expanded = materialise(crawl.expand(wanted, store.files), "expanded")
    extracted = extract.extract_contents(
        crawl.documents_of(expanded), store.files, store.documents, store.sheets, store.slides, ascii_titles
    )
    file_mime = F.try_element_at(F.col("metadata"), F.lit(METADATA_MIME_KEY))
    contents = (
        extracted.filter("failure IS NULL")
        .select(
            "key", "content", "type", file_mime.alias("mime_type"), F.current_timestamp().alias("ts"),
            keys.owner_of_file(F.col("content_id")).alias("owner"), "metadata",
        )
        .unionByName(
            raw.unionByName(references)
            .filter("failure IS NULL")
            .select(
                "key", "content", "type", F.lit(None).cast("string").alias("mime_type"), "ts",
                keys.owner_of_text(F.col("key")).alias("owner"), F.col("attributes").alias("metadata"),
            )
        )
    )
    now = F.current_timestamp().alias("ts")
    failures = errors.union_failures(
        crawl.failures_of(expanded).select("content_id", "metadata", "failure", now),
        ingest.message_failures(routed, raw, references),
        extracted.filter("failure IS NOT NULL").select("content_id", "metadata", "failure", now),
    )
    return contents, errors.classify(failures)


def index_rows(contents: DataFrame, models: Models | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks with vectors and links, and what failed on the way, once for each document and stage:
    ``stage, key, failure``, the ``request`` to try it again and its ``metadata``.

    A document asked for twice is indexed once, with its newest content where ``contents`` has a
    ``ts`` (of contents of one time the greatest), and so is an ``owner`` under two keys, a file whose
    title changed; without that column a key is its own owner.  A document of which any part failed is
    withheld as a whole, so that what is stored of it stays.
    """
    models = models or Models()
    if "ts" not in contents.columns:
        contents = contents.withColumn("ts", F.lit(None).cast("timestamp"))
    if "owner" not in contents.columns:
        contents = contents.withColumn("owner", keys.owner_of_text(F.col("key")))
    if "metadata" not in contents.columns:
        contents = contents.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    once = (
        contents.withColumn("attributes", F.to_json("metadata"))
        .groupBy("owner")
        .agg(F.max(F.struct("ts", "key", "content", "type", "mime_type", "attributes")).alias("c"))
        .select("c.key", "c.content", "c.type", "c.mime_type", "c.attributes", "owner")
    )
    strategy = chunk.chunk_strategy(F.col("type"))
    texts = chunk.chunk_texts(once, "mime_type", "owner")
    links = once.filter(strategy.isin("pdf", "image"))
    if models.pages is None:
        answered = inference.chunk_links(links, models.chunk_links, "owner")
        read = answered.withColumn("chunks", chunk.parse_chunk_response(F.col("response")))
    else:
        read = chunk.chunk_pages(links, models.pages, "owner")
    parsed = materialise(read, "linked")
    linked = chunk.explode_chunks(parsed.filter("chunks IS NOT NULL"), "owner").withColumn(
        "mime_type", F.lit(None).cast("string")
    )
    embedded = materialise(
        inference.embed_texts(texts.unionByName(linked), "chunk", models.embed), "embedded"
    )
    broken = parsed.filter("chunks IS NULL").select("key").unionByName(
        inference.embed_failures(embedded).select("key")
    )
    whole = inference.embedded(embedded).join(broken, "key", "left_anti")
    # the file's MIME type came along on every row, so the link needs no lookup
    rows = index.indexable(whole, "mime_type", "owner", "idx").withColumn(
        "link", index.link_of_owner(F.col("owner"), F.col("doc_key"), F.col("mime_type"))
    )
    failures = (
        parsed.filter("chunks IS NULL")
        .select(
            "key", F.coalesce("chunk_error", F.lit("The model answer is no list of chunks")).alias("failure"), F.lit("chunk").alias("stage")
        )
        .unionByName(
            inference.embed_failures(embedded).select(
                "key", F.col("embed_error").alias("failure"), F.lit("embed").alias("stage")
            )
        )
        .groupBy("key", "stage")
        .agg(F.min("failure").alias("failure"))
    )
    again = once.select(
        "key",
        ingest.request_of(F.col("owner"), F.col("key"), F.col("type"), F.col("content")).alias("request"),
        F.from_json("attributes", "map<string,string>").alias("metadata"),
    )
    failed = failures.join(again, "key").unionByName(
        chunk.unchunkable(once).withColumn("stage", F.lit("type")), allowMissingColumns=True
    )
    return rows.select("row_key", "doc_key", "owner", F.col("idx").alias("position"), "content", "embedding", "link"), failed


def model_errors(failed: DataFrame) -> DataFrame:
    """Failures of the chunk and embed stages as errors; a type that no model reads is not tried again."""
    return errors.classify(
        failed.select(
            "stage",
            F.col("key").alias("content_id"),
            "metadata",
            F.col("key").alias("element"),
            F.col("failure").alias("message"),
            F.current_timestamp().alias("ts"),
            "request",
        )
    )


def ingest_messages(
    messages: DataFrame, store: FileStore, models: Models | None = None, ascii_titles: bool = False
) -> Ingested:
    contents, failures = contents_of_messages(messages, store, ascii_titles)
    contents = materialise(contents, "contents")
    rows, failed = index_rows(contents, models)
    return Ingested(contents.drop("ts"), rows, failures.unionByName(model_errors(failed)))


#: The vector table and the content table change together.
VECTOR_TABLE = Table("vectors", "id string, owner string, embedding array<float>", "owner")
CELL_TABLE = Table("cells", "row_key string, owner string, qualifier string, ts timestamp, value string", "row_key")


def open_store(spark: SparkSession, path: str) -> Store:
    """The two tables below a folder; a new folder is an empty store."""
    return Store(spark, path, [VECTOR_TABLE, CELL_TABLE])


def store_rows(rows: DataFrame, store: Store, now: Column, writer: str | None = None, batch: int | None = None) -> int:
    """Bring both tables up to date with the new rows, in one step: stale keys go, new ones come.

    Only the change is written.  Of the documents in it, all vectors are taken back by owner, and the
    cells of those keys that the new rows no longer hold; a renamed file keeps its owner.  A batch that
    its writer has stored already changes nothing.
    """
    base = store.snapshot()
    if store.committed(writer, batch, base):
        return base.manifest.version
    rows = materialise(rows, "rows")
    owners = rows.select("owner").distinct()
    vectors = rows.select(F.col("row_key").alias("id"), "owner", "embedding")
    cells = index.content_cells(rows, now, "owner")
    stale = index.stale_of_owners(base.table("cells"), rows)
    changes = {"vectors": Change(vectors, owners), "cells": Change(cells, stale)}
    return store.commit(changes, writer, batch, base)


def maintain_store(store: Store, most: int = MOST_PARTS, whole: bool = False) -> bool:
    """Merge generations; of the cells that are merged, the newest versions stay."""
    return store.maintain(most, {"cells": index.keep_versions}, whole)


def stored_cells(snapshot: Snapshot) -> DataFrame:
    """The content cells of one version of the store, the newest few of each key and qualifier."""
    return index.keep_versions(snapshot.table("cells")).drop("owner")
