"""Keep the content table and the vector table in step with the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.fixed_values import (
    CELL_MAX_VERSIONS,
    EXCHANGE_MAX_AGE,
    EXCHANGE_MAX_VERSIONS,
    MIME_FOLDER,
    REFRESH_PERIOD,
    SOURCE_LINK_PREFIXES,
    SOURCE_LINK_UNKNOWN,
    UPSERT_GROUP_SIZE,
)
from docloom.functions import keys
from docloom.functions.text import is_blank, literal_map
from docloom.session import materialise

# --- rows to index -------------------------------------------------------------


def indexable(embedded_chunks: DataFrame, *keep: str) -> DataFrame:
    """Row key, document key, text and vector of every chunk.

    The vector never left its chunk's row, so there is nothing to pair by position.
    """
    return embedded_chunks.select(
        keys.chunk_key(F.col("key"), F.col("idx")).alias("row_key"),
        F.col("key").alias("doc_key"),
        F.col("chunk").alias("content"),
        "embedding",
        *keep,
    )


def pair_vectors(chunk_lists: DataFrame) -> DataFrame:
    """The same from a table with one ``chunks`` and one ``vectors`` array per document."""
    pairs = F.arrays_zip(F.col("chunks"), F.col("vectors"))
    return chunk_lists.select("key", F.posexplode(pairs).alias("idx", "pair")).select(
        keys.chunk_key(F.col("key"), F.col("idx")).alias("row_key"),
        F.col("key").alias("doc_key"),
        F.col("pair.chunks").alias("content"),
        F.col("pair.vectors").alias("embedding"),
    )


def source_link(row_key: Column, mime_type: Column) -> Column:
    """Where a chunk comes from: file URL by type, or the reference itself."""
    prefix = F.coalesce(
        F.try_element_at(literal_map(SOURCE_LINK_PREFIXES), mime_type), F.lit(SOURCE_LINK_UNKNOWN)
    )
    return F.when(keys.is_drive_key(row_key), F.concat(prefix, keys.file_id(row_key))).otherwise(
        keys.part(row_key, 0)
    )


def link_of_owner(owner: Column, doc_key: Column, mime_type: Column) -> Column:
    """The same from the stored owner, whatever separators the title or the id holds."""
    prefix = F.coalesce(
        F.try_element_at(literal_map(SOURCE_LINK_PREFIXES), mime_type), F.lit(SOURCE_LINK_UNKNOWN)
    )
    return F.when(keys.owns_file(owner), F.concat(prefix, keys.id_of_owner(owner))).otherwise(doc_key)


def with_links(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``link`` by looking the file type up.

    Keys without a file id match nothing; they keep their own key as join key, so that
    they stay spread instead of meeting in one partition.
    """
    id_or_key = F.when(keys.is_drive_key(F.col("row_key")), keys.file_id(F.col("row_key"))).otherwise(
        F.concat(F.lit("\u0000"), F.col("row_key"))
    )
    types = files.select(F.col("id").alias("_id"), F.col("mime_type").alias("_mime"))
    return (
        rows.withColumn("_id", id_or_key)
        .join(types, "_id", "left")
        .withColumn("link", source_link(F.col("row_key"), F.col("_mime")))
        .drop("_id", "_mime")
    )


def content_cells(rows: DataFrame, now: Column, *keep: str) -> DataFrame:
    """Two cells per chunk, ``content`` and ``link``, with one time stamp."""
    cells = F.array(
        F.struct(F.lit("content").alias("qualifier"), F.col("content").alias("value")),
        F.struct(F.lit("link").alias("qualifier"), F.col("link").alias("value")),
    )
    return rows.select("row_key", *keep, now.alias("ts"), F.explode(cells).alias("cell")).select(
        "row_key", *keep, "cell.qualifier", "ts", "cell.value"
    )


# --- changes -------------------------------------------------------------------


def latest_vectors(new: DataFrame) -> DataFrame:
    """One row per id: the newest where the rows have a ``ts``, and of equal or no times the greatest."""
    if "ts" not in new.columns:
        return new.groupBy("id").agg(F.max("embedding").alias("embedding"))
    newest = new.groupBy("id").agg(F.max(F.struct("ts", "embedding")).alias("v"))
    return newest.select("id", "v.embedding")


def upsert_vectors(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by id."""
    once = latest_vectors(new)
    return existing.join(once.select("id"), "id", "left_anti").unionByName(once)


def delete_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_anti")


def delete_rows(content: DataFrame, row_keys: DataFrame) -> DataFrame:
    """Drop content rows by exact key."""
    return content.join(row_keys.select("row_key").distinct(), "row_key", "left_anti")


def group_upserts(rows: DataFrame, size: int = UPSERT_GROUP_SIZE) -> DataFrame:
    """Number the groups a remote vector store is sent, per document.

    Chunk positions are consecutive, so the position itself gives the group and no
    window over the document is needed.
    """
    position = F.try_element_at(keys.key_parts(F.col("row_key")), F.lit(-1)).try_cast("int")
    return rows.withColumn("batch_id", F.floor(position / size).cast("int"))


def fill_ids(vector_lists: DataFrame, prefix: Column) -> DataFrame:
    """``id, embedding`` from arrays of (id, embedding); a missing id is prefix + position."""
    rows = vector_lists.select("*", F.posexplode("vectors").alias("pos", "v"))
    return rows.select(
        F.coalesce(F.col("v.id"), F.concat(prefix, F.col("pos").cast("string"))).alias("id"),
        F.col("v.embedding").alias("embedding"),
    )


def stale_keys(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing keys of the documents just indexed that the new rows no longer hold.

    Both tables need ``row_key`` only.  Owners are compared by equality, so ``doc1`` never
    touches ``doc10``; and because the owner of a file is its id, the rows a renamed file
    left behind are stale as well.
    """
    old = existing.select("row_key").withColumn("owner", keys.owner(F.col("row_key")))
    touched = new.select(keys.owner(F.col("row_key")).alias("owner")).distinct()
    return (
        old.join(touched, "owner", "left_semi")
        .join(new.select("row_key"), "row_key", "left_anti")
        .select("row_key")
        .distinct()
    )


def stale_of_owners(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The same for tables that store ``owner`` beside ``row_key``: no key is taken apart.

    Titles and ids may hold the separator; a renamed file is known by its owner.
    """
    touched = new.select("owner").distinct()
    return (
        existing.select("row_key", "owner")
        .join(touched, "owner", "left_semi")
        .join(new.select("row_key"), "row_key", "left_anti")
        .select("row_key")
        .distinct()
    )


def change_set(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One table of changes: ``key, op``."""
    return (
        stale_keys(existing, new)
        .select(F.col("row_key").alias("key"), F.lit("DELETE").alias("op"))
        .unionByName(new.select(F.col("row_key").alias("key"), F.lit("UPSERT").alias("op")).distinct())
    )


def replace_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """The vector table after a change set.

    Old vectors of a document just indexed are either stale or replaced, so all of them
    go: the anti join needs one row per document instead of one per chunk.
    """
    owners = new.select(keys.owner(F.col("row_key")).alias("owner")).distinct()
    kept = vectors.withColumn("owner", keys.owner(F.col("id"))).join(owners, "owner", "left_anti").drop("owner")
    return kept.select("id", "embedding").unionByName(
        latest_vectors(new.select(F.col("row_key").alias("id"), "embedding"))
    )


def apply_to_cells(cells: DataFrame, new_cells: DataFrame, stale: DataFrame) -> DataFrame:
    """Rows of stale keys go; new versions are added beside the old ones."""
    return delete_rows(cells, stale).unionByName(new_cells)


# --- retention -----------------------------------------------------------------


def keep_versions(cells: DataFrame, versions: int = CELL_MAX_VERSIONS) -> DataFrame:
    """At most ``versions`` newest cells per row and qualifier.

    The literal bound lets Spark cut each task's rows before the shuffle, so a key with
    very many versions stays small.
    """
    newest = W.partitionBy("row_key", "qualifier").orderBy(F.desc("ts"), "value")
    return cells.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= versions).drop("rn")


def keep_exchanges(
    exchanges: DataFrame,
    now: Column,
    max_age: str = EXCHANGE_MAX_AGE,
    versions: int = EXCHANGE_MAX_VERSIONS,
) -> DataFrame:
    """Exchanges that are neither too old nor beyond the newest ``versions`` of their session.

    Age is tested first: the newest versions of the young rows are exactly the young ones
    among the newest versions.
    """
    young = exchanges.filter(F.col("ts") >= now - F.expr(f"INTERVAL {max_age}"))
    newest = W.partitionBy("session").orderBy(F.desc("ts"), "exchange")
    return young.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= versions).drop("rn")


def append_exchanges(exchanges: DataFrame, answered: DataFrame, now: Column) -> DataFrame:
    """Add ``question___answer`` rows; a blank session stores nothing."""
    return exchanges.unionByName(
        answered.filter(~is_blank(F.col("session"))).select(
            "session",
            now.alias("ts"),
            F.concat(F.col("question"), F.lit(keys.KEY_SEPARATOR), F.col("answer")).alias("exchange"),
        )
    )


def delete_sessions(exchanges: DataFrame, sessions: DataFrame) -> DataFrame:
    return exchanges.join(sessions.select("session").distinct(), "session", "left_anti")


# --- refresh -------------------------------------------------------------------


def distinct_ids_streaming(ids: DataFrame, window: str = "1 minute") -> DataFrame:
    """Each id once within the time window; state older than that is forgotten."""
    return ids.withWatermark("ts", window).dropDuplicatesWithinWatermark(["id"])


def refresh_requests(content: DataFrame, files: DataFrame, now: Column, period: str = REFRESH_PERIOD) -> DataFrame:
    """New ingestion requests for indexed files that changed within the last period.

    The files are filtered first: few change within a period, so the distinct ids of the
    whole content table only ever meet a small table.
    """
    changed = files.filter(
        (F.col("modified_time") > now - F.expr(f"INTERVAL {period}"))
        & F.col("web_view_link").isNotNull()
        & (F.col("mime_type") != MIME_FOLDER)
    ).select(F.col("id").alias("file_id"), "web_view_link")
    ids = content.select(keys.file_id(F.col("row_key")).alias("file_id"))
    indexed = ids.join(changed.select("file_id"), "file_id", "left_semi").distinct()
    wanted = changed.join(indexed, "file_id")
    body = F.to_json(F.struct(F.array(F.struct(F.col("web_view_link").alias("urlOrId"))).alias("googleDrive")))
    return wanted.select(
        now.alias("ts"), body.alias("payload"), F.create_map().cast("map<string,string>").alias("attributes")
    )


# --- bucketed tables on disk ---------------------------------------------------

BUCKETS = 256
#: Folder inside a bucketed table that holds its bucket count; readers of the table skip it.
LAYOUT = "_layout"


def bucket_count(spark: SparkSession, path: str) -> int:
    """The number of buckets a table was written with."""
    return spark.read.parquet(f"{path}/{LAYOUT}").first().buckets


def bucket_of(row_key: Column, buckets: int) -> Column:
    """All rows of one owner share a bucket."""
    return F.pmod(F.xxhash64(keys.owner(row_key)), F.lit(buckets)).cast("int")


def write_bucketed(rows: DataFrame, path: str, key: str = "row_key", buckets: int = BUCKETS) -> None:
    """Write a table, replacing it as a whole, partitioned by a hash of the owner.

    The number of buckets is written beside the rows, so that later change sets use the same.
    The rebalance hint lets adaptive execution cut a bucket that holds a huge document
    over several tasks, and join small buckets.
    """
    (
        rows.withColumn("bucket", bucket_of(F.col(key), buckets))
        .hint("rebalance", "bucket")
        .write.partitionBy("bucket")
        .option("partitionOverwriteMode", "static")
        .mode("overwrite")
        .parquet(path)
    )
    layout = rows.sparkSession.range(1).select(F.lit(buckets).alias("buckets"))
    layout.write.mode("overwrite").parquet(f"{path}/{LAYOUT}")


def rewrite_buckets(
    spark: SparkSession,
    path: str,
    touched_keys: DataFrame,
    change: Callable[[DataFrame], DataFrame],
    key: str = "row_key",
) -> None:
    """Apply ``change(old rows) -> new rows`` to the buckets of the touched keys only.

    The number of buckets is fixed, so their list is small.  The new rows are complete in
    the shared folder before any bucket is replaced: the table is never read and
    overwritten at once, and a failed run can simply be repeated.
    """
    buckets = bucket_count(spark, path)
    listed = touched_keys.select(bucket_of(F.col("row_key"), buckets).alias("b")).distinct()
    touched = [row.b for row in listed.collect()]
    if not touched:
        return
    old = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket")
    stage = materialise(
        change(old).withColumn("bucket", bucket_of(F.col(key), buckets)).hint("rebalance", "bucket"), "buckets"
    )
    filled = {row.bucket for row in stage.select("bucket").distinct().collect()}
    stage.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    # a bucket left without rows is not replaced by the write above
    for bucket in sorted(set(touched) - filled):
        none = stage.filter(F.lit(False)).drop("bucket")
        none.write.option("partitionOverwriteMode", "static").mode("overwrite").parquet(f"{path}/bucket={bucket}")
