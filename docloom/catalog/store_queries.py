"""The ingestion from messages to stored tables, over two batches (inventory F-03, F-04 and 3.1)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from docloom.catalog import inputs
from docloom.catalog.ingest_queries import KIND
from docloom.catalog.registry import query
from docloom.catalog.sql import CTES, FILE_MIME, T0, file_id, sql
from docloom.fixed_values import MIME_DOCUMENT, MIME_PRESENTATION, MIME_SPREADSHEET
from docloom.functions import keys
from docloom.functions.html import ENTITIES, STEPS
from docloom.operators import chunk, errors, inference
from docloom.plans import ingestion, refresh
from docloom.session import materialise, new_folder
from docloom.sources import messages

#: Files asked for by messages, and read.
WANTED = "doc_id % 10 IN (0, 1, 7) AND doc_id % 7 < 5"
FILE_LINES = """SELECT doc_id, pos, line FROM doc_lines WHERE doc_id % 7 < 3 UNION ALL SELECT doc_id, pos, line FROM sheet_lines WHERE doc_id % 7 = 3
    UNION ALL SELECT doc_id, pos, line FROM slide_lines WHERE doc_id % 7 = 4"""
LINES = ("doc_lines", "sheet_lines", "slide_lines")
FILE_KEY = "lower(source || '_doc_' || lang || '_no_' || doc_id) || '___f' || doc_id"
REFERENCES = """SELECT doc_id, 'https://x.example/' || doc_id || '.pdf' AS url, 'link/pdf' AS type FROM documents WHERE doc_id % 10 IN (5, 6)
    UNION ALL SELECT doc_id, 'https://x.example/' || doc_id || '.png', 'link/png' FROM documents WHERE doc_id % 10 = 5"""


def _file_store(spark, sf_dir, files):
    return ingestion.FileStore(
        files, inputs.doc_bodies(spark, sf_dir), inputs.sheet_bodies(spark, sf_dir), inputs.slide_bodies(spark, sf_dir)
    )


def _first(spark, sf_dir):
    return ingestion.ingest_messages(
        inputs.messages(spark, sf_dir), _file_store(spark, sf_dir, inputs.files(spark, sf_dir)), ascii_titles=True
    )


@query(
    "P01_ingest_contents",
    sql(
        f"""SELECT {FILE_KEY} AS key, 'text/plain' AS type, coalesce(n, 0)::BIGINT AS lines, coalesce(t, '') AS text FROM documents
        LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t FROM ({FILE_LINES}) GROUP BY doc_id) USING (doc_id)
        WHERE {WANTED} UNION ALL SELECT 'raw' || doc_id, 'text/plain', 1, text FROM documents WHERE doc_id % 10 = 2
        UNION ALL SELECT url, type, 1, url FROM ({REFERENCES})""",
        *LINES,
    ),
)
def ingest_contents(spark, sf_dir):
    """What all messages bring in, every line of it."""
    return _first(spark, sf_dir).contents.select(
        "key", "type", F.size("content").cast("bigint").alias("lines"), F.array_join("content", "\n").alias("text")
    )


@query(
    "P02_ingest_errors",
    sql("", "transports", "routed").rstrip()
    + f""", failed AS (SELECT 'id' AS stage, content_id, CASE WHEN contains(content_id, 'settings') THEN 'The link holds no file id'
    ELSE 'Unknown file type: application/x-other' END AS message, retries FROM transports WHERE contains(content_id, 'settings') OR doc_id % 7 = 6
    UNION ALL SELECT 'message', payload, CASE WHEN route = 'malformed' THEN 'Malformed request' WHEN doc_id % 10 = 3 THEN 'The raw text is not base64 twice over'
    ELSE 'This kind of request is not served' END, NULL FROM routed WHERE doc_id % 10 IN (3, 4, 6, 8, 9))
    SELECT {KIND} AS kind, stage, content_id AS element, (coalesce(retries, 0) + CASE WHEN {KIND} = 'retriable' THEN 1 ELSE 0 END)::BIGINT AS retry_count,
    message FROM failed""",
)
def ingest_errors(spark, sf_dir):
    """What fails on the way of all messages, and whether it is tried again."""
    return _first(spark, sf_dir).errors.select(
        "kind", "stage", "element", F.col("retry_count").cast("bigint").alias("retry_count"), "message"
    )


_stores: dict[tuple[str, str], str] = {}


def _two_batches(spark, sf_dir):
    """All messages, then those of the labelled documents again, whose files have new titles by then.

    The new titles hold the separator of keys.  The second batch comes twice, as after a failure.
    """
    known = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if known in _stores:
        return ingestion.open_store(spark, _stores[known])
    path = new_folder(spark, "store")
    store = ingestion.open_store(spark, path)
    sent, files = inputs.messages(spark, sf_dir), inputs.files(spark, sf_dir)
    ingestion.store_rows(_first(spark, sf_dir).rows, store, inputs.at(F.lit(3600)), "messages", 0)
    labelled = inputs.given(spark, sf_dir, "labels").select("doc_id").distinct()
    again = sent.join(labelled.select(inputs.at(F.col("doc_id")).alias("ts")), "ts", "left_semi")
    renamed = files.join(labelled.select(F.concat(F.lit("f"), "doc_id").alias("id"), F.lit(True).alias("new")), "id", "left")
    titles = renamed.withColumn("name", F.when(F.col("new"), F.concat(F.lit("New___"), "name")).otherwise(F.col("name"))).drop("new")
    second = ingestion.ingest_messages(again, _file_store(spark, sf_dir, titles), ascii_titles=True)
    for _ in range(2):
        ingestion.store_rows(second.rows, store, inputs.at(F.lit(7200)), "messages", 1)
    _stores[known] = path
    return store


LABELLED = "doc_id IN (SELECT doc_id FROM labels)"
#: Chunks of what both batches leave, by the rules of the other rows.
STORED = (
    sql("", *LINES).rstrip()
    + f""", contents AS (SELECT doc_id, CASE WHEN {LABELLED} THEN 'new___' ELSE '' END || {FILE_KEY} AS key, t AS text, {FILE_MIME} AS mime_type
    FROM documents JOIN (SELECT doc_id, string_agg(line, ' ' ORDER BY pos) AS t FROM ({FILE_LINES}) GROUP BY doc_id) USING (doc_id) WHERE {WANTED}
    UNION ALL SELECT doc_id, 'raw' || doc_id, text, NULL FROM documents WHERE doc_id % 10 = 2), """
    + ", ".join(f"{name} AS ({CTES[name][1]})" for name in ("words", "starts", "heads", "chunks"))
    + f""", chunk_keys AS (SELECT key || '___' || idx AS row_key, key AS doc_key, chunk AS content, idx, mime_type, doc_id FROM chunks
    UNION ALL SELECT url || '___0', url, type || ' ' || url, 0, NULL, doc_id FROM ({REFERENCES})), """
)
OWNER = "CASE WHEN doc_id % 10 IN (0, 1, 7) THEN 'file:f' || doc_id ELSE 'text:' || doc_key END"


@query(
    "P03_stored_vectors",
    STORED
    + f"chunk_weights AS ({CTES['chunk_weights'][1]}) SELECT row_key AS id, {OWNER} AS owner, bucket, round(v, 6) AS value FROM chunk_weights JOIN chunk_keys USING (row_key) WHERE v <> 0",
)
def stored_vectors(spark, sf_dir):
    """The vector table after both batches: every non-zero entry of every vector."""
    vectors = _two_batches(spark, sf_dir).table("vectors")
    entries = vectors.select("id", "owner", F.posexplode("embedding").alias("bucket", "v")).where("v <> 0")
    return entries.select(
        "id", "owner", F.col("bucket").cast("bigint").alias("bucket"), F.round(F.col("v").cast("double"), 6).alias("value")
    )


@query(
    "P04_stored_cells",
    STORED
    + f"""linked AS (SELECT *, CASE WHEN doc_id % 10 IN (0, 1, 7) THEN CASE mime_type WHEN '{MIME_DOCUMENT}' THEN 'https://docs.google.com/document/d/'
    WHEN '{MIME_SPREADSHEET}' THEN 'https://docs.google.com/spreadsheets/d/' WHEN '{MIME_PRESENTATION}' THEN 'https://docs.google.com/presentation/d/'
    ELSE 'NA ' END || 'f' || doc_id ELSE doc_key END AS link FROM chunk_keys)
    SELECT row_key, q AS qualifier, epoch({T0})::BIGINT + h * 3600 AS ts, CASE q WHEN 'link' THEN link ELSE content END AS value
    FROM linked, (VALUES ('content'), ('link')) v(q), (VALUES (1), (2)) w(h)
    WHERE CASE WHEN NOT {LABELLED} THEN h = 1 WHEN doc_id % 10 IN (0, 1, 7) THEN h = 2 ELSE true END""",
)
def stored_cells(spark, sf_dir):
    """The content table after both batches: keys that came twice have two versions, old titles none."""
    cells = ingestion.stored_cells(_two_batches(spark, sf_dir).snapshot())
    return cells.select("row_key", "qualifier", F.unix_timestamp("ts").alias("ts"), "value")


@query(
    "P05_merged_store",
    STORED + f"chunk_count AS (SELECT {OWNER} AS owner, count(*) AS chunks FROM chunk_keys GROUP BY 1) SELECT owner, chunks FROM chunk_count",
)
def merged_store(spark, sf_dir):
    """Chunks of each owner, from one merged generation while the store goes on."""
    store = _two_batches(spark, sf_dir)
    before = store.snapshot()
    ingestion.maintain_store(store, whole=True)
    counts = store.table("vectors").groupBy("owner").agg(F.count("*").alias("chunks"))
    return counts.join(before.table("vectors").select("owner").distinct(), "owner", "left_semi")


# --- failures of models --------------------------------------------------------


def _picky(texts):
    """A model that fails on texts of certain lengths."""
    if any(len(text) % 7 == 0 for text in texts):
        raise ValueError("no vector")
    return inference.hashing_embedder(8)(texts)


CODED = "to_base64(encode(to_base64(encode(text))))"


@query(
    "E03_model_failures",
    sql(
        f"""SELECT key AS element, 'embed' AS stage, CASE WHEN doc_id % 205 <= 100 THEN 'retriable' ELSE 'discardable' END AS kind, 'ValueError: no vector' AS message,
        CASE WHEN doc_id % 205 <= 100 THEN CASE WHEN doc_id % 4 <> 3 THEN '{{"googleDrive":[{{"urlOrId":"f' || doc_id || '"}}]}}'
        ELSE '{{"rawData":{{"id":"raw' || doc_id || '","data":"' || {CODED} || '","mimeType":"text/plain"}}}}' END END AS payload,
        CASE WHEN doc_id % 205 <= 100 THEN doc_id % 205 + 1 END::VARCHAR AS retries
        FROM contents WHERE key IN (SELECT key FROM chunks WHERE length(chunk) % 7 = 0)""",
        "contents",
        "chunks",
    ),
)
def model_failures(spark, sf_dir):
    """Documents a model fails on: what is tried again, with the request that does it."""
    contents = inputs.contents(spark, sf_dir)
    owned = contents.select(
        "key", "content", "type", "mime_type",
        F.when(F.col("doc_id") % 4 == 3, keys.owner_of_text(F.col("key"))).otherwise(keys.owner_of_file(inputs.file_id())).alias("owner"),
        F.create_map(F.lit("retries"), (F.col("doc_id") % 205).cast("string")).alias("metadata"),
    )
    _, failed = ingestion.index_rows(owned, ingestion.Models(embed=_picky))
    found = materialise(ingestion.model_errors(failed), "model-errors")
    again = errors.retry_messages(found.withColumn("ts", F.lit(None).cast("timestamp"))).select(
        F.col("payload").alias("request"), "payload", F.col("attributes")["retries"].alias("retries")
    )
    return found.join(again, "request", "left").select("element", "stage", "kind", "message", "payload", "retries")


# --- refresh -------------------------------------------------------------------


@query(
    "A02_refresh_run",
    sql(
        f"""SELECT epoch(n)::BIGINT AS ts, '{{"googleDrive":[{{"urlOrId":"' || web_view_link || '"}}]}}' AS payload, 0::BIGINT AS attributes
        FROM files, (SELECT max(modified_time) AS n FROM files) WHERE web_view_link IS NOT NULL AND modified_time > n - INTERVAL '6 hours'
        AND id IN (SELECT {file_id('row_key')} FROM chunk_keys)""",
        "files",
        "chunk_keys",
    ),
)
def refresh_run(spark, sf_dir):
    """One run of the periodic job: the messages it publishes, read back from their folder."""
    folder, files = new_folder(spark, "refresh"), inputs.files(spark, sf_dir)
    newest = files.agg(F.max("modified_time").alias("m")).first().m
    refresh.refresh(inputs.chunk_keys(spark, sf_dir), files, folder, F.lit(newest))
    return messages.read_messages(spark, folder).select(
        F.unix_timestamp("ts").alias("ts"), "payload", F.coalesce(F.size("attributes"), F.lit(0)).cast("bigint").alias("attributes")
    )


# --- linked pages --------------------------------------------------------------


def _page_steps(html: str) -> str:
    for pattern, instead in STEPS:
        html = f"regexp_replace({html}, {_text(pattern)}, {_text(instead)}, 'g')"
    for name, character in ENTITIES.items():
        html = f"replace({html}, '&{name};', {_text(character)})"
    return html


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: Pages as contents; every tenth link has no page.
PAGES = (
    f"WITH contents AS (SELECT page_id AS doc_id, url AS key, {_page_steps('html')} AS text, NULL::VARCHAR AS mime_type FROM pages), "
    + ", ".join(f"{name} AS ({CTES[name][1]})" for name in ("words", "starts", "heads", "chunks"))
)


def _linked_pages(spark, sf_dir):
    """Every url once, though several pages may have it: the join finds all of them for each link."""
    pages = inputs.given(spark, sf_dir, "pages")
    there = pages.select(F.col("url").alias("key")).where("key IS NOT NULL").distinct()
    gone = pages.where("page_id % 10 = 0 AND url IS NOT NULL").select(F.concat("url", F.lit("#gone")).alias("key"))
    links = there.unionByName(gone)
    contents = links.select("key", F.array("key", F.lit(" ")).alias("content"), F.lit("link/pdf").alias("type"))
    return chunk.chunk_pages(contents, pages)


@query("M04_page_chunks", PAGES + " SELECT key, idx::BIGINT AS idx, chunk FROM chunks")
def page_chunks(spark, sf_dir):
    """Chunks of the text of every linked page."""
    read = _linked_pages(spark, sf_dir).where("chunks IS NOT NULL")
    return chunk.explode_chunks(read).withColumn("idx", F.col("idx").cast("bigint"))


@query("M04_unread_links", "SELECT url || '#gone' AS key, 'The link was not read: ' || url || '#gone' AS failure FROM pages WHERE page_id % 10 = 0")
def unread_links(spark, sf_dir):
    return _linked_pages(spark, sf_dir).where("chunk_error IS NOT NULL").select("key", F.col("chunk_error").alias("failure"))
