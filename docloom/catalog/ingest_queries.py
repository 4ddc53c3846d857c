"""Sources, parsing, routing, extraction and errors (inventory A, C, D/E and the file sinks of B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import inputs
from docloom.catalog.registry import query
from docloom.catalog.sql import T0, doc_key, file_id, parts, sql
from docloom.fixed_values import FILE_MIME_TYPES, METADATA_MIME_KEY, MIME_FOLDER, MIME_UNKNOWN
from docloom.functions import keys
from docloom.functions.text import token_count
from docloom.functions.vectors import as_double, l2_norm
from docloom.operators import crawl, errors, extract, index, ingest
from docloom.session import new_folder
from docloom.sources import messages as message_source
from docloom.sources import files as file_system
from docloom.sources import sinks, stores
from docloom.streaming import jobs

EPOCH = "epoch({})::BIGINT"


def run_stream(spark, stream, purpose):
    """Run a stream over everything there is and read its output back."""
    out = new_folder(spark, purpose)
    run = jobs.append_to(stream, out, new_folder(spark, purpose + "-checkpoint"), availableNow=True)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark, sf_dir):
    schema = inputs.given(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


# --- A: sources ----------------------------------------------------------------


@query(
    "A01_stream_messages",
    "SELECT event_id, user_id, event_type, epoch_us(ts)::BIGINT AS ts_us FROM events",
)
def stream_messages(spark, sf_dir):
    rows = run_stream(spark, event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "ts"), "a01")
    return rows.select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("ts_us"))


@query(
    "A02_refresh_tick",
    sql(
        f"""SELECT epoch(time_bucket(INTERVAL '6 hours', f.modified_time, {T0}))::BIGINT + 21600 AS tick,
        count(DISTINCT f.id) AS requests FROM files f JOIN (SELECT DISTINCT {file_id('row_key')} AS id FROM chunk_keys) c USING (id)
        WHERE f.web_view_link IS NOT NULL GROUP BY 1""",
        "files",
        "chunk_keys",
    ),
)
def refresh_tick(spark, sf_dir):
    """What each six-hourly run of the refresh job would have asked for."""
    ids = stores.distinct_file_ids(inputs.chunk_keys(spark, sf_dir))
    changed = inputs.files(spark, sf_dir).filter("web_view_link IS NOT NULL").withColumnRenamed("id", "file_id")
    return (
        changed.join(ids, "file_id", "left_semi")
        .groupBy(F.window("modified_time", "6 hours").alias("w"))
        .agg(F.count("*").alias("requests"))
        .select(F.unix_timestamp("w.end").alias("tick"), "requests")
    )


@query(
    "A03_distinct_file_ids",
    sql(f"SELECT DISTINCT {file_id('row_key')} AS file_id FROM chunk_keys WHERE {file_id('row_key')} <> ''", "chunk_keys"),
)
def distinct_file_ids(spark, sf_dir):
    return stores.distinct_file_ids(inputs.chunk_keys(spark, sf_dir))


@query("A04_content_keys", sql("SELECT DISTINCT row_key FROM cells", "cells"))
def content_keys(spark, sf_dir):
    return stores.row_keys(inputs.cells(spark, sf_dir))


@query(
    "A05_keys_of_documents",
    sql(
        "SELECT DISTINCT doc_key, row_key FROM chunk_keys WHERE doc_id IN (SELECT doc_id FROM labels)", "chunk_keys"
    ),
)
def keys_of_documents(spark, sf_dir):
    labelled = inputs.given(spark, sf_dir, "labels").select("doc_id").distinct()
    wanted = inputs.contents(spark, sf_dir).join(labelled, "doc_id", "left_semi").select(F.col("key").alias("doc_key"))
    return stores.keys_of_documents(inputs.chunk_keys(spark, sf_dir), wanted)


def _wanted_keys(spark, sf_dir):
    """First and ninth chunk of every document; most documents have no ninth."""
    contents = inputs.contents(spark, sf_dir)
    return contents.select(F.explode(F.array(F.lit(0), F.lit(8))).alias("i"), "key").select(
        keys.chunk_key(F.col("key"), F.col("i")).alias("row_key")
    )


@query(
    "A06_content_by_key",
    sql(
        """SELECT w.row_key, coalesce(l.content, '') AS content, coalesce(l.link, '') AS link FROM
        (SELECT key || '___' || i AS row_key FROM contents, (VALUES (0), (8)) v(i)) w LEFT JOIN linked l USING (row_key)""",
        "contents",
        "linked",
    ),
)
def content_by_key(spark, sf_dir):
    return stores.content_by_key(inputs.cells(spark, sf_dir), _wanted_keys(spark, sf_dir))


@query(
    "A07_session_exchanges",
    sql(
        f"SELECT session, {EPOCH.format('ts')} AS ts, exchange FROM exchanges WHERE regexp_matches(session, '\\S')",
        "exchanges",
    ),
)
def session_exchanges(spark, sf_dir):
    exchanges = inputs.exchanges(spark, sf_dir)
    return stores.session_exchanges(exchanges, exchanges.select("session")).select(
        "session", F.unix_timestamp("ts").alias("ts"), "exchange"
    )


@query(
    "A08_folder_children",
    sql(
        f"""SELECT parent_id, id, mime_type FROM files
        WHERE parent_id IN (SELECT id FROM files WHERE mime_type = '{MIME_FOLDER}')""",
        "files",
    ),
)
def folder_children(spark, sf_dir):
    files = inputs.files(spark, sf_dir)
    folders = files.filter(F.col("mime_type") == MIME_FOLDER)
    return stores.children(files, folders).select("parent_id", "id", "mime_type")


def _labelled_files(spark, sf_dir, *letters):
    labels = inputs.given(spark, sf_dir, "labels")
    prefix = F.explode(F.array(*[F.lit(x) for x in letters]))
    return labels.select(prefix.alias("p"), "doc_id").select(F.concat("p", "doc_id").alias("id"))


@query(
    "A09_file_metadata",
    sql(
        """SELECT id, name, mime_type, epoch(modified_time)::BIGINT AS modified, web_view_link FROM files
        WHERE id IN (SELECT 'f' || doc_id FROM labels)""",
        "files",
    ),
)
def file_metadata(spark, sf_dir):
    found = stores.file_metadata(inputs.files(spark, sf_dir), _labelled_files(spark, sf_dir, "f", "gone"))
    return found.select("id", "name", "mime_type", F.unix_timestamp("modified_time").alias("modified"), "web_view_link")


@query(
    "A10_scan_vectors",
    "SELECT vec_id::VARCHAR AS id, len(embedding)::BIGINT AS dimensions, "
    "round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
)
def scan_vectors(spark, sf_dir):
    return inputs.vectors(spark, sf_dir).select(
        "id", F.size("embedding").cast("bigint").alias("dimensions"), F.round(l2_norm(as_double(F.col("embedding"))), 6).alias("norm")
    )


@query(
    "A11_file_types",
    sql(
        f"""SELECT w.id, CASE WHEN f.mime_type IN {tuple(FILE_MIME_TYPES)} THEN f.mime_type ELSE '{MIME_UNKNOWN}' END AS mime_type
        FROM (SELECT DISTINCT p || doc_id AS id FROM labels, (VALUES ('f'), ('gone')) v(p)) w LEFT JOIN files f USING (id)""",
        "files",
    ),
)
def file_types(spark, sf_dir):
    return stores.file_types(inputs.files(spark, sf_dir), _labelled_files(spark, sf_dir, "f", "gone"))


# --- B: file sinks -------------------------------------------------------------


def _contents(spark, sf_dir):
    return inputs.contents(spark, sf_dir).select("key", "content", "type")


@query(
    "B01_content_lines_as_json",
    sql(
        """SELECT key, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS pos,
        to_json({'text': unnest(string_split(text, chr(10)))})::VARCHAR AS json FROM contents""",
        "contents",
    ),
)
def content_lines_as_json(spark, sf_dir):
    return sinks.content_lines_as_json(_contents(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "B02_write_content_lines",
    sql("SELECT key, to_json({'text': unnest(string_split(text, chr(10)))})::VARCHAR AS value FROM contents", "contents"),
)
def write_content_lines(spark, sf_dir):
    """The lines of all documents in packed files, read back."""
    out = new_folder(spark, "b02")
    sinks.write_content_lines(_contents(spark, sf_dir), out)
    return sinks.read_content_lines(spark, out).select("key", "value")


@query(
    "B03_write_errors",
    sql("SELECT route AS message, payload AS element, ts::DATE::VARCHAR AS error_date FROM routed WHERE route IN ('malformed', 'unsupported')", "routed"),
)
def write_errors(spark, sf_dir):
    """Errors by day, read back; the payload is data and not a path."""
    out = new_folder(spark, "b03")
    bad = _routed(spark, sf_dir).filter(F.col("route").isin("malformed", "unsupported"))
    sinks.write_errors(bad.select("ts", F.col("payload").alias("element"), F.col("route").alias("message")), out)
    back = spark.read.schema("element string, message string, error_date date").json(out)
    return back.select("message", "element", F.col("error_date").cast("string").alias("error_date"))


@query(
    "B04_publish_messages",
    sql(f"SELECT {EPOCH.format('ts')} AS ts, payload, origin, retries::VARCHAR AS retries FROM messages", "messages"),
)
def publish_messages(spark, sf_dir):
    """Messages appended to the message folder, read back."""
    out = new_folder(spark, "b04")
    message_source.publish(inputs.messages(spark, sf_dir), out)
    return message_source.read_messages(spark, out).select(
        F.unix_timestamp("ts").alias("ts"),
        "payload",
        F.col("attributes")["origin"].alias("origin"),
        F.col("attributes")["retries"].alias("retries"),
    )


# --- C: parse, validate, route -------------------------------------------------


def _requests(spark, sf_dir):
    return ingest.parse_requests(inputs.messages(spark, sf_dir))


def _routed(spark, sf_dir):
    return ingest.route(_requests(spark, sf_dir))


@query(
    "C01_parse_requests",
    sql(
        """SELECT payload, j IS NOT NULL AS usable, json_array_length(j, '$.googleDrive')::BIGINT AS drive_items,
        json_extract_string(j, '$.rawData.id') AS raw_id, json_extract_string(j, '$.rawData.mimeType') AS raw_mime,
        json_array_length(j, '$.references')::BIGINT AS reference_items FROM parsed""",
        "parsed",
    ),
)
def parse_requests(spark, sf_dir):
    return _requests(spark, sf_dir).select(
        "payload",
        F.col("request").isNotNull().alias("usable"),
        F.size("request.googleDrive").cast("bigint").alias("drive_items"),
        F.col("request.rawData.id").alias("raw_id"),
        F.col("request.rawData.mimeType").alias("raw_mime"),
        F.size("request.references").cast("bigint").alias("reference_items"),
    ).withColumns(
        {
            "drive_items": F.when(F.col("drive_items") >= 0, F.col("drive_items")),
            "reference_items": F.when(F.col("reference_items") >= 0, F.col("reference_items")),
        }
    )


@query("C02_route_requests", sql("SELECT payload, route FROM routed", "routed"))
def route_requests(spark, sf_dir):
    return _routed(spark, sf_dir).select("payload", "route")


@query("C03_branch_counts", sql("SELECT route, count(*) AS messages FROM routed GROUP BY route", "routed"))
def branch_counts(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("route").agg(F.count("*").alias("messages"))


@query(
    "C04_drive_transports",
    sql(f"SELECT {EPOCH.format('ts')} AS ts, content_id, origin, retries::VARCHAR AS retries FROM transports", "transports"),
)
def drive_transports(spark, sf_dir):
    return ingest.drive_transports(_routed(spark, sf_dir)).select(
        F.unix_timestamp("ts").alias("ts"),
        "content_id",
        F.col("metadata")["origin"].alias("origin"),
        F.col("metadata")["retries"].alias("retries"),
    )


@query(
    "C05_decode_raw_text",
    sql(
        """SELECT json_extract_string(j, '$.rawData.id') AS key, CASE WHEN doc_id % 10 = 2 THEN text END AS content,
        CASE WHEN json_extract_string(j, '$.rawData.mimeType') <> 'text/plain' THEN 'This kind of request is not served'
        WHEN doc_id % 10 = 3 THEN 'The raw text is not base64 twice over' END AS failure
        FROM routed JOIN documents USING (doc_id) WHERE route = 'raw'""",
        "routed",
    ),
)
def decode_raw_text(spark, sf_dir):
    return ingest.raw_contents(_routed(spark, sf_dir)).select(
        "key", F.get("content", F.lit(0)).alias("content"), "failure"
    )


@query(
    "C06_reference_contents",
    sql(
        """SELECT payload, url AS key, CASE WHEN NOT bad THEN CASE mime WHEN 'application/pdf' THEN 'link/pdf' ELSE replace(mime, 'image/', 'link/') END
        ELSE mime END AS type, CASE WHEN bad THEN 'This kind of request is not served' END AS failure FROM (
        SELECT *, min(CASE WHEN bad THEN i END) OVER (PARTITION BY payload) AS first_bad FROM (
        SELECT payload, url, mime, i, mime NOT IN ('application/pdf', 'image/png', 'image/jpeg', 'image/webp') AS bad FROM (
        SELECT payload, unnest(json_extract_string(j, '$.references[*].url')) AS url,
        unnest(json_extract_string(j, '$.references[*].mimeType')) AS mime,
        generate_subscripts(json_extract_string(j, '$.references[*].url'), 1) AS i FROM routed WHERE route = 'references')))
        WHERE first_bad IS NULL OR i <= first_bad""",
        "routed",
    ),
)
def reference_contents(spark, sf_dir):
    return ingest.reference_contents(_routed(spark, sf_dir)).select("payload", "key", "type", "failure")


@query(
    "C07_link_mime",
    sql(
        """SELECT mime, count(*) AS refs, CASE mime WHEN 'application/pdf' THEN 'link/pdf' WHEN 'image/png' THEN 'link/png'
        WHEN 'image/jpeg' THEN 'link/jpeg' WHEN 'image/webp' THEN 'link/webp' END AS link_mime FROM (
        SELECT unnest(json_extract_string(j, '$.references[*].mimeType')) AS mime FROM routed) GROUP BY mime""",
        "routed",
    ),
)
def link_mime(spark, sf_dir):
    rows = _routed(spark, sf_dir).select(F.explode("request.references.mimeType").alias("mime"))
    return rows.groupBy("mime").agg(F.count("*").alias("refs")).withColumn("link_mime", ingest.link_mime(F.col("mime")))


@query(
    "C08_known_mime_types",
    sql(
        f"SELECT id, mime_type, mime_type IN {tuple(FILE_MIME_TYPES)} AS known FROM files", "files"
    ),
)
def known_mime_types(spark, sf_dir):
    return inputs.files(spark, sf_dir).select(
        "id", "mime_type", F.col("mime_type").isin(FILE_MIME_TYPES).alias("known")
    )


@query(
    "C09_validate_requests",
    sql(
        """SELECT payload, route NOT IN ('malformed', 'unsupported') AS valid, CASE WHEN route IN ('malformed', 'unsupported')
        THEN 'The request names no file, no raw text and no reference' END AS reason FROM routed""",
        "routed",
    ),
)
def validate_requests(spark, sf_dir):
    return ingest.validate_requests(_requests(spark, sf_dir)).select("payload", "valid", "reason")


@query(
    "C10_validate_uploads",
    """SELECT id AS "documentId", CASE WHEN reason IS NULL THEN '{"rawData":{"id":"' || id || '","data":"' || to_base64(data) ||
    '","mimeType":"' || mime || '"}}' END AS payload, reason FROM (SELECT *, CASE WHEN id IS NULL OR NOT regexp_matches(id, '\\S')
    OR data IS NULL OR mime IS NULL OR NOT regexp_matches(mime, '\\S')
    THEN 'Id, content or type of the upload is missing'
    WHEN mime = 'application/zip' THEN 'Unknown upload type: application/zip' END AS reason FROM (
    SELECT CASE WHEN doc_id % 5 = 1 THEN ' ' ELSE 'up' || doc_id END AS id, CASE WHEN doc_id % 5 <> 2 THEN encode(text) END AS data,
    CASE doc_id % 5 WHEN 3 THEN '' WHEN 4 THEN 'application/zip' ELSE 'text/plain' END AS mime FROM documents))""",
)
def validate_uploads(spark, sf_dir):
    kind = F.col("doc_id") % 5
    uploads = inputs.given(spark, sf_dir, "documents").select(
        F.when(kind == 1, " ").otherwise(F.concat(F.lit("up"), F.col("doc_id"))).alias("documentId"),
        F.when(kind != 2, F.col("text").cast("binary")).alias("documentContent"),
        F.when(kind == 3, "").when(kind == 4, "application/zip").otherwise("text/plain").alias("mimeType"),
    )
    return ingest.uploads_to_requests(uploads)


@query(
    "C11_is_url",
    sql("SELECT content_id, starts_with(content_id, 'http') AS is_url FROM transports", "transports"),
)
def is_url(spark, sf_dir):
    return ingest.drive_transports(_routed(spark, sf_dir)).select(
        "content_id", keys.is_url(F.col("content_id")).alias("is_url")
    )


@query(
    "C12_page_url_paths",
    "SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path FROM pages",
)
def page_url_paths(spark, sf_dir):
    return inputs.given(spark, sf_dir, "pages").select("page_id", "url", keys.url_path(F.col("url")).alias("path"))


FORMS = ["document/d/", "presentation/d/", "spreadsheets/d/", "drive/folders/", "other/"]


@query(
    "C12_id_from_url",
    """SELECT url, CASE WHEN form = 'other/' OR page_id % 5 = 4 THEN NULL ELSE 'p' || page_id END AS id FROM (
    SELECT page_id, form, 'https://files.example/u/0/' || form || CASE WHEN page_id % 5 <> 4 THEN 'p' || page_id ELSE '' END ||
    '/edit?from=' || url AS url FROM pages,
    (VALUES ('document/d/'), ('presentation/d/'), ('spreadsheets/d/'), ('drive/folders/'), ('other/')) v(form))""",
)
def id_from_url(spark, sf_dir):
    """Every page under each form of shared link; a fifth of the links hold no id."""
    pages = inputs.given(spark, sf_dir, "pages")
    held = F.when(F.col("page_id") % 5 != 4, F.concat(F.lit("p"), F.col("page_id"))).otherwise("")
    urls = pages.withColumn("form", F.explode(F.array(*[F.lit(x) for x in FORMS]))).select(
        F.concat(F.lit("https://files.example/u/0/"), "form", held, F.lit("/edit?from="), "url").alias("url")
    )
    return urls.select("url", keys.id_from_url(F.col("url")).alias("id"))


@query(
    "C13_id_from_url_or_id",
    sql(
        """SELECT content_id, CASE WHEN contains(content_id, '/document/d/') THEN regexp_extract(content_id, '/document/d/([^/?]*)', 1)
        WHEN starts_with(content_id, 'http') THEN NULL ELSE content_id END AS id FROM transports""",
        "transports",
    ),
)
def id_from_url_or_id(spark, sf_dir):
    return ingest.drive_transports(_routed(spark, sf_dir)).select(
        "content_id", keys.id_from_url_or_id(F.col("content_id")).alias("id")
    )


REACHED = """tree AS (SELECT 'root' AS id, 'root' AS path UNION ALL SELECT f.id, t.path || '/' || f.id FROM tree t JOIN files f
    ON f.parent_id = t.id WHERE f.mime_type = '{folder}' AND NOT contains('/' || t.path || '/', '/' || f.id || '/'))"""


@query(
    "C14_expand_folders",
    "WITH RECURSIVE "
    + sql("", "files").removeprefix("WITH ").rstrip()
    + ", "
    + REACHED.format(folder=MIME_FOLDER)
    + f""" SELECT f.id, f.mime_type, CASE WHEN f.mime_type NOT IN {tuple(FILE_MIME_TYPES)}
    THEN 'Unknown file type: ' || f.mime_type END AS failure FROM files f JOIN (SELECT DISTINCT id FROM tree) t ON f.parent_id = t.id
    WHERE f.mime_type IN {tuple(crawl.EXTRACTABLE)}
    OR f.mime_type NOT IN {tuple(FILE_MIME_TYPES)}""",
)
def expand_folders(spark, sf_dir):
    """Everything below the root folder, through a cycle."""
    files = inputs.files(spark, sf_dir)
    root = files.filter("id = 'root'").select(
        F.concat(F.lit("https://drive.google.com/drive/folders/"), "id").alias("content_id"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return crawl.expand(root, files).select("id", "mime_type", "failure")


@query(
    "C14_expand_requests",
    sql(
        f"""SELECT content_id, f.id, f.mime_type, CASE WHEN r.root IS NULL THEN 'The link holds no file id'
        WHEN f.mime_type NOT IN {tuple(FILE_MIME_TYPES)} THEN 'Unknown file type: ' || f.mime_type END AS failure FROM (
        SELECT content_id, CASE WHEN contains(content_id, '/document/d/') THEN regexp_extract(content_id, '/document/d/([^/?]*)', 1)
        WHEN starts_with(content_id, 'http') THEN NULL ELSE content_id END AS root FROM transports) r
        LEFT JOIN files f ON f.id = r.root WHERE f.mime_type IS NULL OR NOT contains(f.mime_type, 'drawing')""",
        "transports",
        "files",
    ),
)
def expand_requests(spark, sf_dir):
    transports = ingest.drive_transports(_routed(spark, sf_dir))
    return crawl.expand(transports, inputs.files(spark, sf_dir)).select("content_id", "id", "mime_type", "failure")


@query(
    "C15_add_mime_type",
    sql(
        """SELECT row_key AS content_id, CASE WHEN idx % 2 = 0 THEN 'kept' ELSE coalesce(mime_type, 'none') END AS mime,
        CASE WHEN idx % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS entries FROM chunk_keys""",
        "chunk_keys",
    ),
)
def add_mime_type(spark, sf_dir):
    """Half of the rows have the entry already, under which it stays."""
    rows = inputs.chunk_keys(spark, sf_dir)
    metadata = F.when(
        F.col("idx") % 2 == 0, F.create_map(F.lit(METADATA_MIME_KEY), F.lit("kept"))
    ).otherwise(F.create_map(F.lit("origin"), F.col("doc_key")))
    merged = ingest.add_mime(metadata, F.coalesce("mime_type", F.lit("none")), METADATA_MIME_KEY)
    return rows.select(
        F.col("row_key").alias("content_id"),
        merged[METADATA_MIME_KEY].alias("mime"),
        F.size(merged).cast("bigint").alias("entries"),
    )


def _all_transports(spark, sf_dir):
    return inputs.files(spark, sf_dir).filter(F.col("mime_type") != MIME_FOLDER).select(
        F.col("id").alias("content_id"),
        F.create_map(F.lit(METADATA_MIME_KEY), F.col("mime_type")).alias("metadata"),
    )


def _extracted(spark, sf_dir):
    return extract.extract_contents(
        _all_transports(spark, sf_dir),
        inputs.files(spark, sf_dir),
        inputs.doc_bodies(spark, sf_dir),
        inputs.sheet_bodies(spark, sf_dir),
        inputs.slide_bodies(spark, sf_dir),
        ascii_titles=True,
    )


@query(
    "C16_extract_by_type",
    sql(
        """SELECT 'f' || doc_id AS content_id, lower(source || '_doc_' || lang || '_no_' || doc_id) || '___f' || doc_id AS key,
        CASE WHEN doc_id % 7 < 5 THEN coalesce(n, 0) END::BIGINT AS lines, CASE WHEN doc_id % 7 < 5 THEN coalesce(chars, 0) END::BIGINT AS chars,
        CASE WHEN doc_id % 7 >= 5 THEN 'Files of this type are not read: ' || CASE WHEN doc_id % 7 = 5 THEN 'application/vnd.google-apps.drawing'
        ELSE 'application/vnd.google-apps.unknown' END END AS failure FROM documents LEFT JOIN (
        SELECT doc_id, count(*) AS n, sum(length(line)) AS chars FROM (
        SELECT doc_id, line FROM doc_lines WHERE doc_id % 7 < 3 UNION ALL SELECT doc_id, line FROM sheet_lines WHERE doc_id % 7 = 3
        UNION ALL SELECT doc_id, line FROM slide_lines WHERE doc_id % 7 = 4) GROUP BY doc_id) USING (doc_id)""",
        "doc_lines",
        "sheet_lines",
        "slide_lines",
    ),
)
def extract_by_type(spark, sf_dir):
    length = F.aggregate("content", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x))
    return _extracted(spark, sf_dir).select(
        "content_id",
        "key",
        F.when(F.col("content").isNotNull(), F.size("content")).cast("bigint").alias("lines"),
        length.alias("chars"),
        "failure",
    )


@query(
    "C17_paragraph_text",
    sql(
        """SELECT 'f' || doc_id AS id, i::BIGINT AS pos, array_to_string(list_transform(list_filter(string_split(line, ', '),
        lambda x: x <> ''), lambda x: x || chr(10)), ' ') AS text FROM lines WHERE i % 3 <> 2""",
        "lines",
    ),
)
def paragraph_text(spark, sf_dir):
    rows = inputs.doc_bodies(spark, sf_dir).select("id", F.posexplode("content").alias("pos", "c"))
    return rows.filter("c.paragraph IS NOT NULL").select(
        "id", F.col("pos").cast("bigint").alias("pos"), extract.paragraph_text(F.col("c.paragraph")).alias("text")
    )


def _numbered(rows, lines):
    return rows.select("id", F.posexplode(lines).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


ORDERED = """SELECT 'f' || doc_id AS id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS pos, line FROM {}"""


@query("C18_document_lines", sql(ORDERED.format("doc_lines"), "doc_lines"))
def document_lines(spark, sf_dir):
    return _numbered(inputs.doc_bodies(spark, sf_dir), extract.document_lines(F.col("content")))


@query("C19_sheet_lines", sql(ORDERED.format("sheet_lines"), "sheet_lines"))
def sheet_lines(spark, sf_dir):
    return _numbered(inputs.sheet_bodies(spark, sf_dir), extract.sheet_lines(F.col("sheets")))


@query("C20_slide_lines", sql(ORDERED.format("slide_lines"), "slide_lines"))
def slide_lines(spark, sf_dir):
    return _numbered(inputs.slide_bodies(spark, sf_dir), extract.slide_lines(F.col("slides")))


@query(
    "C21_document_key",
    """SELECT doc_id, lower(regexp_replace(source, ' +', '_', 'g') || '_doc_' || lang || '_no_' || doc_id) || '___f' || doc_id AS key
    FROM documents""",
)
def document_key(spark, sf_dir):
    return inputs.given(spark, sf_dir, "documents").select(
        "doc_id", keys.new_doc_key(inputs.file_name(), inputs.file_id()).alias("key")
    )


@query(
    "C21_document_key_accents",
    r"""SELECT doc_id, lower(regexp_replace(regexp_replace(strip_accents(text), ' +', '_', 'g'), '[\[\]()\n\r]', '', 'g'))
    || '___f' || doc_id AS key FROM documents""",
)
def document_key_accents(spark, sf_dir):
    """Keys from the texts themselves as titles, their decomposed accents taken off."""
    key = keys.new_doc_key(F.col("text"), inputs.file_id())
    return inputs.given(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_replace(key, r"\p{M}", "").alias("key")
    )


@query(
    "C22_union_contents",
    sql(
        """SELECT type, count(*) AS contents FROM (
        SELECT 'text/plain' AS type FROM documents WHERE doc_id % 7 < 5
        UNION ALL SELECT 'text/plain' FROM documents WHERE doc_id % 10 = 2
        UNION ALL SELECT unnest(['link/pdf', 'link/png']) FROM documents WHERE doc_id % 10 = 5
        UNION ALL SELECT 'link/pdf' FROM documents WHERE doc_id % 10 = 6) GROUP BY type"""
    ),
)
def union_contents(spark, sf_dir):
    routed = _routed(spark, sf_dir)
    whole = ingest.union_contents(
        _extracted(spark, sf_dir).filter("failure IS NULL"),
        ingest.contents_of(ingest.raw_contents(routed)),
        ingest.contents_of(ingest.reference_contents(routed)),
    )
    return whole.groupBy("type").agg(F.count("*").alias("contents"))


# --- E: errors and retries -----------------------------------------------------


def _failures(spark, sf_dir):
    files = inputs.files(spark, sf_dir)
    routed = _routed(spark, sf_dir)
    now = F.lit("2024-01-01").cast("timestamp").alias("ts")
    found = crawl.expand(ingest.drive_transports(routed), files)
    # every file is tried for extraction, with the retry count of its document
    tried = extract.extract_contents(
        _all_transports(spark, sf_dir).withColumn(
            "metadata",
            F.map_concat(
                "metadata",
                F.create_map(
                    F.lit("retries"), (F.substring("content_id", 2, 20).try_cast("int") % 205).cast("string")
                ),
            ),
        ),
        files,
        inputs.doc_bodies(spark, sf_dir),
        inputs.sheet_bodies(spark, sf_dir),
        inputs.slide_bodies(spark, sf_dir),
        ascii_titles=True,
    )
    return errors.union_failures(
        crawl.failures_of(found).select("content_id", "metadata", "failure", now),
        ingest.message_failures(routed, ingest.raw_contents(routed), ingest.reference_contents(routed)),
        tried.filter("failure IS NOT NULL").select("content_id", "metadata", "failure", now),
    )


FAILURES = f"""failed AS (
    SELECT 'id' AS stage, content_id, CASE WHEN contains(content_id, 'settings') THEN 'The link holds no file id'
        ELSE 'Unknown file type: application/x-other' END AS message, retries FROM transports
        WHERE contains(content_id, 'settings') OR doc_id % 7 = 6
    UNION ALL SELECT 'message', payload, CASE WHEN route = 'malformed' THEN 'Malformed request'
        WHEN doc_id % 10 = 3 THEN 'The raw text is not base64 twice over' ELSE 'This kind of request is not served' END, NULL FROM routed
        WHERE doc_id % 10 IN (3, 4, 6, 8, 9)
    UNION ALL SELECT 'content', 'f' || doc_id, 'Files of this type are not read: ' || CASE WHEN doc_id % 7 = 5
        THEN 'application/vnd.google-apps.drawing' ELSE '{MIME_UNKNOWN}' END, doc_id % 205 FROM documents WHERE doc_id % 7 >= 5)"""
FAILED = sql("", "transports", "routed").rstrip() + ", " + FAILURES


@query("C23_failures_by_stage", FAILED + " SELECT stage, message, count(*) AS failures FROM failed GROUP BY stage, message")
def failures_by_stage(spark, sf_dir):
    return _failures(spark, sf_dir).groupBy("stage", "message").agg(F.count("*").alias("failures"))


@query("E01_union_failures", FAILED + " SELECT stage, content_id AS element, message FROM failed")
def union_failures(spark, sf_dir):
    return _failures(spark, sf_dir).select("stage", "element", "message")


KIND = "CASE WHEN stage <> 'message' AND coalesce(retries, 0) <= 100 THEN 'retriable' ELSE 'discardable' END"


@query("E02_split_by_kind", FAILED + f" SELECT {KIND} AS kind, count(*) AS failures FROM failed GROUP BY 1")
def split_by_kind(spark, sf_dir):
    classified = errors.classify(_failures(spark, sf_dir))
    both = errors.retriable(classified).unionByName(errors.discardable(classified))
    return both.groupBy("kind").agg(F.count("*").alias("failures"))


@query(
    "E03_classify_failures",
    FAILED
    + f""" SELECT {KIND} AS kind, stage, content_id AS element, (coalesce(retries, 0) + CASE WHEN {KIND} = 'retriable' THEN 1 ELSE 0 END)::BIGINT
    AS retry_count, CASE stage WHEN 'id' THEN 'DocumentIdError' WHEN 'content' THEN 'DocumentContentError' ELSE 'IngestionError' END AS class_name
    FROM failed""",
)
def classify_failures(spark, sf_dir):
    return errors.classify(_failures(spark, sf_dir)).select(
        "kind", "stage", "element", F.col("retry_count").cast("bigint").alias("retry_count"), "class_name"
    )


@query(
    "E04_hold_retries",
    FAILED
    + f""" SELECT epoch({T0})::BIGINT + 600 AS released_at, '{{"googleDrive":[{{"urlOrId":"' || content_id || '"}}]}}' AS payload,
    (retries + 1)::VARCHAR AS retries FROM failed WHERE {KIND} = 'retriable'""",
)
def hold_retries(spark, sf_dir):
    messages = errors.retry_messages(errors.classify(_failures(spark, sf_dir)))
    return errors.hold_retries(messages).select(
        F.unix_timestamp("released_at").alias("released_at"),
        "payload",
        F.col("attributes")["retries"].alias("retries"),
    )


@query(
    "E05_retry_messages",
    FAILED
    + f""" SELECT '{{"googleDrive":[{{"urlOrId":"' || content_id || '"}}]}}' AS payload, (retries + 1)::VARCHAR AS retries
    FROM failed WHERE {KIND} = 'retriable'""",
)
def retry_messages(spark, sf_dir):
    return errors.retry_messages(errors.classify(_failures(spark, sf_dir))).select(
        "payload", F.col("attributes")["retries"].alias("retries")
    )


@query(
    "E06_error_strings",
    FAILED
    + f""" SELECT content_id AS element, '{{"className":"' || CASE stage WHEN 'id' THEN 'DocumentIdError' WHEN 'content' THEN 'DocumentContentError'
    ELSE 'IngestionError' END || '","message":"' || message || '"}}' AS error FROM failed WHERE {KIND} = 'discardable'""",
)
def error_strings(spark, sf_dir):
    return errors.error_strings(errors.classify(_failures(spark, sf_dir))).select("element", "error")


# --- key grammar ---------------------------------------------------------------


@query(
    "F01_document_of_key",
    sql(f"SELECT row_key, {doc_key('row_key')} AS doc_key FROM chunk_keys", "chunk_keys"),
)
def document_of_key(spark, sf_dir):
    return inputs.chunk_keys(spark, sf_dir).select("row_key", keys.doc_key(F.col("row_key")).alias("doc_key"))


@query(
    "F02_file_of_key",
    sql(f"SELECT row_key, {file_id('row_key')} AS file_id FROM chunk_keys", "chunk_keys"),
)
def file_of_key(spark, sf_dir):
    return inputs.chunk_keys(spark, sf_dir).select("row_key", keys.file_id(F.col("row_key")).alias("file_id"))


@query(
    "F02_key_parts",
    """WITH k AS (SELECT replace(text, ' ', '___') AS key FROM documents)
    SELECT key, len(p)::BIGINT AS size, coalesce(p[len(p)], '') AS last FROM (SELECT key, """
    + parts("key")
    + " AS p FROM k)",
)
def key_parts(spark, sf_dir):
    """Whole texts as keys: their words are the parts."""
    rows = inputs.given(spark, sf_dir, "documents").select(F.replace("text", F.lit(" "), F.lit("___")).alias("key"))
    return rows.select("key", keys.key_parts(F.col("key")).alias("p")).select(
        "key",
        F.size("p").cast("bigint").alias("size"),
        F.coalesce(F.try_element_at("p", F.lit(-1)), F.lit("")).alias("last"),
    )


# --- S: streams ----------------------------------------------------------------


WINDOWS = """SELECT epoch(w)::BIGINT AS window_start, n AS messages FROM (
    SELECT time_bucket(INTERVAL '{size}', ts) AS w, count(*) AS n FROM events GROUP BY 1)
    WHERE w + INTERVAL '{size}' <= (SELECT max(ts) FROM events) - INTERVAL '1 minute'"""


@query("S01_minute_windows", WINDOWS.format(size="1 minute"))
def minute_windows(spark, sf_dir):
    """Windows the watermark has passed; the last ones stay open until more data comes."""
    rows = run_stream(spark, jobs.window_counts(event_stream(spark, sf_dir)), "s01")
    return rows.select(F.unix_timestamp("window_start").alias("window_start"), "messages")


@query("S02_ten_minute_windows", WINDOWS.format(size="10 minutes"))
def ten_minute_windows(spark, sf_dir):
    rows = run_stream(spark, jobs.retry_counts(event_stream(spark, sf_dir)), "s02")
    return rows.select(F.unix_timestamp("window_start").alias("window_start"), "messages")


def _late_stream(spark, sf_dir):
    """All events, the newest one again, and all of them again when nearly every window has closed.

    The stream is run three times on one checkpoint, each time over files of any number.  Spark tests
    lateness against the watermark of the batch before, so the run in the middle is what makes the
    last one late.
    """
    folder, out, checkpoint = (new_folder(spark, name) for name in ("late", "s03", "s03-checkpoint"))
    events = inputs.given(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    newest = events.agg(F.max("ts").alias("ts"))
    file_system.make_folder(spark, folder)
    stream = jobs.window_counts(spark.readStream.schema(events.schema).parquet(folder))
    for rows in (events, events.join(newest, "ts"), events):
        rows.select("event_id", "ts").write.mode("append").parquet(folder)
        jobs.run_available(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


@query("S03_late_rows_dropped", WINDOWS.format(size="1 minute"))
def late_rows_dropped(spark, sf_dir):
    """Rows later than the allowed minute change nothing."""
    return _late_stream(spark, sf_dir).select(F.unix_timestamp("window_start").alias("window_start"), "messages")


@query(
    "S04_one_result_per_window",
    f"SELECT window_start, 1::BIGINT AS results FROM ({WINDOWS.format(size='1 minute')})",
)
def one_result_per_window(spark, sf_dir):
    rows = _late_stream(spark, sf_dir).groupBy(F.unix_timestamp("window_start").alias("window_start"))
    return rows.agg(F.count("*").alias("results"))


@query(
    "F06_ids_per_minute",
    "SELECT DISTINCT user_id::VARCHAR AS id, epoch(date_trunc('minute', ts))::BIGINT AS window_start FROM events",
)
def ids_per_minute(spark, sf_dir):
    """Ids of every minute, from a folder that fills up while the stream is run five times."""
    folder, out, checkpoint = (new_folder(spark, name) for name in ("ids", "f06", "f06-checkpoint"))
    ids = inputs.given(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("id")
    )
    file_system.make_folder(spark, folder)
    stream = jobs.ids_per_window(spark.readStream.schema(ids.schema).parquet(folder))
    ends = ids.agg(F.min(F.unix_timestamp("ts")).alias("a"), F.max(F.unix_timestamp("ts")).alias("b")).first()
    fifth = F.floor((F.unix_timestamp("ts") - F.lit(ends.a)) * 5 / F.lit((ends.b or 0) - (ends.a or 0) + 1))
    for k in range(5):
        ids.where(fifth == k).write.mode("append").parquet(folder)
        jobs.run_available(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out).select(
        "id", F.unix_timestamp("window_start").alias("window_start")
    )


@query("F06_deduplicate_ids_stream", "SELECT DISTINCT user_id::VARCHAR AS id FROM events")
def deduplicate_ids_stream(spark, sf_dir):
    """Ids of one micro-batch within the window, then over the whole table."""
    ids = event_stream(spark, sf_dir).select("ts", F.col("user_id").cast("string").alias("id"))
    return run_stream(spark, jobs.deduplicate(ids), "f06").select("id")


@query(
    "M10_tokens_per_line",
    sql(
        """SELECT doc_id, sum(CASE WHEN line = '' THEN 0 ELSE len(string_split(line, ' ')) END)::BIGINT AS tokens FROM lines GROUP BY doc_id""",
        "lines",
    ),
)
def tokens_per_line(spark, sf_dir):
    rows = inputs.given(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("doc_id").agg(F.sum(token_count(F.col("line"))).alias("tokens"))


@query(
    "F07_refresh_requests",
    sql(
        f"""SELECT '{{"googleDrive":[{{"urlOrId":"' || web_view_link || '"}}]}}' AS payload FROM files
        WHERE web_view_link IS NOT NULL AND id IN (SELECT {file_id('row_key')} FROM chunk_keys)
        AND modified_time > (SELECT max(modified_time) FROM files) - INTERVAL '6 hours'""",
        "files",
        "chunk_keys",
    ),
)
def refresh_requests(spark, sf_dir):
    files = inputs.files(spark, sf_dir)
    newest = files.agg(F.max("modified_time").alias("m")).first().m
    return index.refresh_requests(inputs.chunk_keys(spark, sf_dir), files, F.lit(newest)).select("payload")
