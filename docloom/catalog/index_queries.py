"""Chunks, embeddings, stores and refresh (inventory B-05 onwards, M, F and I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import inputs
from docloom.catalog.registry import query
from docloom.catalog.sql import LINK, T0, parts, sql
from docloom.fixed_values import EMBEDDING_INPUT_TYPES
from docloom.functions import keys
from docloom.functions.vectors import as_double, l2_norm, shorten
from docloom.operators import admin, chunk, index, inference
from docloom.session import materialise, new_folder
from docloom.sources.schemas import EMBEDDING_PREDICTION
from docloom.streaming import jobs

SIZE = "len(embedding)::BIGINT AS dimensions, round(embedding[1]::DOUBLE, 6) AS first"


def _sized(rows):
    return rows.select(
        "id",
        F.size("embedding").cast("bigint").alias("dimensions"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"),
    )


# --- M: chunks -----------------------------------------------------------------


@query("M01_spread_rows", "SELECT doc_id, n_chars FROM documents")
def spread_rows(spark, sf_dir):
    return inference.spread(inputs.given(spark, sf_dir, "documents").select("doc_id", "n_chars"))


def _typed_contents(spark, sf_dir):
    """Documents as text, pages as linked files of four types, a few of no known type."""
    page = F.col("page_id") % 5
    kind = F.when(page == 0, "link/pdf").when(page == 1, "link/png").when(page == 2, "link/jpeg")
    kind = kind.when(page == 3, "link/webp").otherwise("application/zip")
    pages = inputs.given(spark, sf_dir, "pages").select(
        F.col("url").alias("key"), F.array("url", F.lit(" ")).alias("content"), kind.alias("type")
    )
    return inputs.contents(spark, sf_dir).select("key", "content", "type").unionByName(pages)


PAGE_TYPE = """CASE page_id % 5 WHEN 0 THEN 'link/pdf' WHEN 1 THEN 'link/png' WHEN 2 THEN 'link/jpeg'
    WHEN 3 THEN 'link/webp' ELSE 'application/zip' END"""


@query(
    "M02_chunk_strategy",
    sql(
        f"""SELECT key, 'text' AS strategy FROM contents UNION ALL SELECT url, CASE {PAGE_TYPE} WHEN 'link/pdf' THEN 'pdf'
        WHEN 'application/zip' THEN NULL ELSE 'image' END FROM pages""",
        "contents",
    ),
)
def chunk_strategy(spark, sf_dir):
    return _typed_contents(spark, sf_dir).select("key", chunk.chunk_strategy(F.col("type")).alias("strategy"))


@query("M02_unchunkable", f"SELECT url AS key, 'Type is not supported: application/zip' AS failure FROM pages WHERE {PAGE_TYPE} = 'application/zip'")
def unchunkable(spark, sf_dir):
    return chunk.unchunkable(_typed_contents(spark, sf_dir))


@query("M03_chunk_texts", sql("SELECT key, idx::BIGINT AS idx, chunk FROM chunks", "chunks"))
def chunk_texts(spark, sf_dir):
    return inputs.fresh_chunks(spark, sf_dir).select("key", F.col("idx").cast("bigint").alias("idx"), "chunk")


@query(
    "M04_chunk_links",
    f"""SELECT url AS key, 0::BIGINT AS idx, {PAGE_TYPE} || ' ' || url AS chunk FROM pages WHERE {PAGE_TYPE} <> 'application/zip'""",
)
def chunk_links(spark, sf_dir):
    contents = _typed_contents(spark, sf_dir)
    linked = contents.filter(chunk.chunk_strategy(F.col("type")).isin("pdf", "image"))
    answered = inference.chunk_links(linked).withColumn("chunks", chunk.parse_chunk_response(F.col("response")))
    return chunk.explode_chunks(answered).withColumn("idx", F.col("idx").cast("bigint"))


@query(
    "M05_non_blank_lines",
    "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')))::BIGINT AS lines FROM documents",
)
def non_blank_lines(spark, sf_dir):
    lines = chunk.non_blank(F.split("text", "\n"))
    return inputs.given(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("lines"))


@query(
    "M06_parse_chunk_response",
    "SELECT page_id, CASE WHEN page_id % 3 <> 2 THEN 2 END::BIGINT AS chunks, CASE WHEN page_id % 3 <> 2 THEN url END AS first FROM pages",
)
def parse_chunk_response(spark, sf_dir):
    """Two of three responses are JSON arrays of strings, the third is plain text."""
    pages = inputs.given(spark, sf_dir, "pages")
    body = F.when(F.col("page_id") % 3 != 2, F.to_json(F.array("url", F.lit("x")))).otherwise(F.col("url"))
    parsed = pages.select("page_id", chunk.parse_chunk_response(body).alias("c"))
    return parsed.select(
        "page_id",
        F.when(F.col("c").isNotNull(), F.size("c")).cast("bigint").alias("chunks"),
        F.get("c", F.lit(0)).alias("first"),
    )


# --- M: embeddings -------------------------------------------------------------


def _embedded(spark, sf_dir):
    return inference.embed_texts(inputs.fresh_chunks(spark, sf_dir))


@query(
    "M07_embed_chunks",
    sql("SELECT row_key, bucket, round(v, 6) AS value FROM chunk_weights WHERE v <> 0", "chunk_weights"),
)
def embed_chunks(spark, sf_dir):
    """The non-zero entries of every chunk's vector."""
    rows = index.indexable(_embedded(spark, sf_dir))
    return (
        rows.select("row_key", F.posexplode("embedding").alias("bucket", "v"))
        .filter("v <> 0")
        .select("row_key", F.col("bucket").cast("bigint").alias("bucket"), F.round(F.col("v").cast("double"), 6).alias("value"))
    )


@query(
    "M08_prediction_vectors",
    """SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'video' ELSE 'none' END AS kind,
    CASE WHEN vec_id % 4 < 3 THEN round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings""",
)
def prediction_vectors(spark, sf_dir):
    """Predictions that hold a text, an image or a video vector, or none."""
    vector = F.col("embedding").cast("array<double>")
    kind = F.col("vec_id") % 4
    segment = F.struct(
        F.lit(0).alias("startOffsetSec"), F.lit(5).alias("endOffsetSec"), vector.alias("embedding")
    )
    prediction = F.struct(
        F.when(kind == 0, vector).alias("textEmbedding"),
        F.when(kind == 1, vector).alias("imageEmbedding"),
        F.when(kind == 2, F.array(segment)).alias("videoEmbeddings"),
    ).cast(f"struct<{EMBEDDING_PREDICTION.replace(' array', ': array')}>".replace(":: ", ": "))
    found = inputs.given(spark, sf_dir, "embeddings").select("vec_id", kind.alias("k"), prediction.alias("p"))
    return found.select(
        "vec_id",
        F.when(F.col("k") == 0, "text").when(F.col("k") == 1, "image").when(F.col("k") == 2, "video").otherwise("none").alias("kind"),
        F.round(F.get(inference.prediction_vector(F.col("p")), F.lit(0)), 6).alias("first"),
    )


@query("M09_pair_chunks_and_vectors", sql("SELECT row_key, doc_key, content FROM chunk_keys", "chunk_keys"))
def pair_chunks(spark, sf_dir):
    """Pairing by position from whole arrays gives the same keys as rows that stayed together."""
    contents = inputs.contents(spark, sf_dir)
    lists = contents.select("key", chunk.chunk_array(chunk.text_of(F.col("content"))).alias("chunks"))
    vectors = F.transform("chunks", lambda c: F.array(F.length(c).cast("double")))
    paired = index.pair_vectors(lists.select("key", "chunks", vectors.alias("vectors")))
    return paired.select("row_key", "doc_key", "content")


@query(
    "M10_embedding_statistics",
    sql(
        """SELECT key, sum(len(string_split(chunk, ' ')))::BIGINT AS tokens, count(*) FILTER (len(string_split(chunk, ' ')) > 2048) AS truncated,
        count(*) AS instances FROM chunks GROUP BY key""",
        "chunks",
    ),
)
def embedding_statistics(spark, sf_dir):
    return inference.embedding_statistics(_embedded(spark, sf_dir))


KINDS = [*EMBEDDING_INPUT_TYPES, "SOUND"]


@query(
    "M11_embedding_instances",
    """SELECT kind, url, kind = 'TEXT' AS has_text, CASE WHEN contains(kind, 'IMAGE') THEN url END AS image, CASE WHEN contains(kind, 'VIDEO') THEN url END AS video,
    CASE WHEN kind = 'SOUND' THEN 'Embedding input type is not supported' WHEN page_id % 9 = 8 AND contains(kind, 'IMAGE') THEN 'The image has neither bytes nor a place'
    WHEN page_id % 9 = 8 AND contains(kind, 'VIDEO') THEN 'The video has neither bytes nor a place'
    WHEN page_id % 9 = 8 THEN 'Nothing to embed: neither text nor image nor video' END AS failure
    FROM (SELECT page_id, CASE WHEN page_id % 9 <> 8 THEN url END AS url FROM pages),
    (VALUES ('TEXT'), ('IMAGE_RAW'), ('IMAGE_LINK'), ('VIDEO_RAW'), ('VIDEO_LINK'), ('SOUND')) v(kind)""",
)
def embedding_instances(spark, sf_dir):
    """Every page under every input type; a ninth of them without data."""
    pages = inputs.given(spark, sf_dir, "pages").select(
        F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"),
        F.when(F.col("page_id") % 9 != 8, F.col("url")).alias("url"),
    )
    rows = pages.withColumn("i", inference.embedding_instance(F.col("kind"), F.col("url")))
    return rows.select(
        "kind",
        "url",
        (F.col("kind") == "TEXT").alias("has_text"),
        F.coalesce("i.image.bytesBase64Encoded", "i.image.gcsUri").alias("image"),
        F.coalesce("i.video.bytesBase64Encoded", "i.video.gcsUri").alias("video"),
        inference.instance_failure(F.col("i")).alias("failure"),
    )


@query(
    "M07_embed_instances",
    """SELECT kind, page_id, failure, CASE WHEN failure IS NULL THEN round(('0x' || substr(h, 1, 2))::INT / 255, 6) END AS v1,
    CASE WHEN failure IS NULL THEN round(('0x' || substr(h, 3, 2))::INT / 255, 6) END AS v2, CASE WHEN failure IS NULL THEN round(('0x' || substr(h, 5, 2))::INT / 255, 6) END AS v3,
    CASE WHEN failure IS NULL THEN round(('0x' || substr(h, 7, 2))::INT / 255, 6) END AS v4 FROM (
    SELECT kind, page_id, md5(CASE WHEN contains(kind, 'RAW') THEN to_base64(encode(html)) ELSE url END) AS h,
    CASE WHEN kind = 'SOUND' THEN 'Embedding input type is not supported' WHEN page_id % 9 = 8 AND contains(kind, 'IMAGE') THEN 'The image has neither bytes nor a place'
    WHEN page_id % 9 = 8 AND contains(kind, 'VIDEO') THEN 'The video has neither bytes nor a place'
    WHEN page_id % 9 = 8 THEN 'Nothing to embed: neither text nor image nor video' WHEN kind = 'VIDEO_LINK' AND length(url) % 7 = 3 THEN 'ValueError: no such video' END AS failure
    FROM pages, (VALUES ('TEXT'), ('IMAGE_RAW'), ('IMAGE_LINK'), ('VIDEO_RAW'), ('VIDEO_LINK'), ('SOUND')) v(kind))""",
)
def embed_instances(spark, sf_dir):
    """Every page under every input type, its raw bytes too; some are missing, and on some the model fails."""
    missing = F.col("page_id") % 9 == 8
    pages = inputs.given(spark, sf_dir, "pages").select(
        F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"),
        "page_id",
        F.when(~missing, F.col("url")).alias("text"),
        F.when(~missing, F.col("html").cast("binary")).alias("bytes"),
    )

    def model(instances):
        if any(len((instance["video"] or {}).get("gcsUri") or "") % 7 == 3 for instance in instances):
            raise ValueError("no such video")
        return inference.digest_instances(instances)

    found = inference.embed_instances(pages, model, batch_bytes=1 << 16)
    entry = [F.round(F.get("embedding", F.lit(k)), 6).alias(f"v{k + 1}") for k in range(4)]
    return found.select("kind", "page_id", F.col("embed_error").alias("failure"), *entry)


@query(
    "M12_shorten_vectors",
    """SELECT vec_id, len(s)::BIGINT AS dimensions, round(s[1] / sqrt(list_dot_product(s, s)), 6) AS first, 1.0::DOUBLE AS norm
    FROM (SELECT vec_id, list_slice(embedding, 1, 16)::DOUBLE[] AS s FROM embeddings)""",
)
def shorten_vectors(spark, sf_dir):
    short = inputs.given(spark, sf_dir, "embeddings").select("vec_id", shorten(F.col("embedding"), 16).alias("s"))
    return short.select(
        "vec_id",
        F.size("s").cast("bigint").alias("dimensions"),
        F.round(F.get("s", F.lit(0)), 6).alias("first"),
        F.round(l2_norm(as_double(F.col("s"))), 6).alias("norm"),
    )


# --- B: stores -----------------------------------------------------------------


def _cell_columns(cells):
    return cells.select("row_key", "qualifier", F.unix_timestamp("ts").alias("ts"), "value")


@query(
    "B05_content_cells",
    sql(
        f"""SELECT row_key, q AS qualifier, epoch({T0})::BIGINT AS ts, CASE q WHEN 'link' THEN link ELSE content END AS value
        FROM linked, (VALUES ('content'), ('link')) v(q)""",
        "linked",
    ),
)
def content_cells(spark, sf_dir):
    return _cell_columns(index.content_cells(inputs.linked_rows(spark, sf_dir), inputs.at(F.lit(0))))


def _new_vectors(spark, sf_dir):
    """Vectors of even label come again, negated, under their own id and under a new one."""
    even = inputs.given(spark, sf_dir, "embeddings").filter("label % 2 = 0")
    ids = F.explode(F.array(F.col("vec_id").cast("string"), F.concat(F.lit("n"), "vec_id")))
    return even.select(ids.alias("id"), F.transform("embedding", lambda x: -x).alias("embedding"))


@query(
    "B06_upsert_vectors",
    f"""SELECT id, {SIZE} FROM (SELECT vec_id::VARCHAR AS id, embedding FROM embeddings WHERE label % 2 <> 0
    UNION ALL SELECT p || vec_id, list_transform(embedding, lambda x: -x) FROM embeddings, (VALUES (''), ('n')) v(p) WHERE label % 2 = 0)""",
)
def upsert_vectors(spark, sf_dir):
    return _sized(index.upsert_vectors(inputs.vectors(spark, sf_dir), _new_vectors(spark, sf_dir)))


@query(
    "B06_rewrite_buckets",
    sql("SELECT row_key, content FROM owned WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT row_key, content FROM changed", "owned", "changed"),
)
def rewrite_buckets(spark, sf_dir):
    """A bucketed table on disk, its touched buckets rewritten for a change set, read back."""
    path = new_folder(spark, "buckets")
    index.write_bucketed(inputs.chunk_keys(spark, sf_dir).select("row_key", "content"), path, buckets=16)
    new = materialise(inputs.changed_keys(spark, sf_dir), "changed")
    index.rewrite_buckets(
        spark,
        path,
        new,
        lambda old: old.join(new.select(keys.owner(F.col("row_key")).alias("o")).distinct(), keys.owner(F.col("row_key")) == F.col("o"), "left_anti")
        .select("row_key", "content")
        .unionByName(new.select("row_key", "content")),
    )
    return spark.read.parquet(path).select("row_key", "content")


@query("B07_group_upserts", sql("SELECT row_key, (idx // 15)::BIGINT AS batch_id FROM chunk_keys", "chunk_keys"))
def group_upserts(spark, sf_dir):
    rows = index.group_upserts(inputs.chunk_keys(spark, sf_dir))
    return rows.select("row_key", F.col("batch_id").cast("bigint").alias("batch_id"))


@query(
    "B08_fill_ids",
    f"""SELECT id, {SIZE} FROM (SELECT vec_id::VARCHAR AS id, embedding FROM embeddings
    UNION ALL SELECT 'vec' || vec_id || '_1', embedding FROM embeddings)""",
)
def fill_ids(spark, sf_dir):
    """Two vectors per request, the second without id."""
    pair = F.array(
        F.struct(F.col("vec_id").cast("string").alias("id"), "embedding"),
        F.struct(F.lit(None).cast("string").alias("id"), "embedding"),
    )
    lists = inputs.given(spark, sf_dir, "embeddings").select("vec_id", pair.alias("vectors"))
    prefix = F.concat(F.lit("vec"), F.col("vec_id"), F.lit("_"))
    return _sized(index.fill_ids(lists, prefix))


@query("B09_delete_vectors", f"SELECT vec_id::VARCHAR AS id, {SIZE} FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def delete_vectors(spark, sf_dir):
    gone = inputs.given(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return _sized(index.delete_ids(inputs.vectors(spark, sf_dir), gone))


@query(
    "B10_delete_content_rows",
    sql("SELECT row_key, qualifier, epoch(ts)::BIGINT AS ts, value FROM cells WHERE row_key NOT IN (SELECT row_key FROM changed)", "cells", "changed"),
)
def delete_content_rows(spark, sf_dir):
    return _cell_columns(index.delete_rows(inputs.cells(spark, sf_dir), inputs.changed_keys(spark, sf_dir)))


@query(
    "B11_append_exchanges",
    sql(
        f"""SELECT session, epoch(ts)::BIGINT AS ts, exchange FROM exchanges UNION ALL
        SELECT session, epoch({T0})::BIGINT + 86400, question || '___' || answer FROM qa WHERE regexp_matches(session, '\\S')""",
        "qa",
    ),
)
def append_exchanges(spark, sf_dir):
    """Every stored exchange is asked and answered once more a day later."""
    from docloom.operators import converse

    stored = inputs.exchanges(spark, sf_dir)
    whole = index.append_exchanges(stored, converse.parse_exchanges(stored), inputs.at(F.lit(86400)))
    return whole.select("session", F.unix_timestamp("ts").alias("ts"), "exchange")


@query(
    "B12_delete_sessions",
    sql("SELECT session, exchange FROM exchanges WHERE session NOT IN (SELECT 'session' || doc_id FROM labels)", "exchanges"),
)
def delete_sessions(spark, sf_dir):
    gone = inputs.given(spark, sf_dir, "labels").select(F.concat(F.lit("session"), "doc_id").alias("session"))
    return index.delete_sessions(inputs.exchanges(spark, sf_dir), gone).select("session", "exchange")


@query(
    "B13_keep_cell_versions",
    sql(
        """SELECT row_key, qualifier, epoch(ts)::BIGINT AS ts, value FROM (SELECT *, row_number() OVER
        (PARTITION BY row_key, qualifier ORDER BY ts DESC, value) AS rn FROM cells) WHERE rn <= 5""",
        "cells",
    ),
)
def keep_cell_versions(spark, sf_dir):
    return _cell_columns(index.keep_versions(inputs.cells(spark, sf_dir)))


@query(
    "B14_keep_exchanges",
    sql(
        f"""SELECT session, epoch(ts)::BIGINT AS ts, exchange FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, exchange) AS rn
        FROM exchanges) WHERE rn <= 5 AND ts >= {T0} + INTERVAL '75 minutes' - INTERVAL '1 hour'""",
        "exchanges",
    ),
)
def keep_exchanges(spark, sf_dir):
    kept = index.keep_exchanges(inputs.exchanges(spark, sf_dir), inputs.at(F.lit(75 * 60)))
    return kept.select("session", F.unix_timestamp("ts").alias("ts"), "exchange")


# --- F: changes ----------------------------------------------------------------


STALE = """SELECT row_key FROM chunk_keys WHERE doc_id IN (SELECT doc_id FROM labels) AND row_key NOT IN (SELECT row_key FROM changed)"""


@query("F03_stale_keys", sql(STALE, "chunk_keys", "changed"))
def stale_keys(spark, sf_dir):
    return index.stale_keys(inputs.chunk_keys(spark, sf_dir), inputs.changed_keys(spark, sf_dir))


@query(
    "F04_change_set",
    sql(f"SELECT row_key AS key, 'DELETE' AS op FROM ({STALE}) UNION ALL SELECT row_key, 'UPSERT' FROM changed", "chunk_keys", "changed"),
)
def change_set(spark, sf_dir):
    return index.change_set(inputs.chunk_keys(spark, sf_dir), inputs.changed_keys(spark, sf_dir))


def _sized_by_text(rows):
    return rows.select(
        F.col("row_key").alias("id"), F.array(F.length("content").cast("float")).alias("embedding")
    )


@query(
    "F04_apply_to_vectors",
    sql(
        """SELECT row_key AS id, round(length(content)::DOUBLE, 6) AS first FROM chunk_keys WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT row_key, round(length(content)::DOUBLE, 6) FROM changed""",
        "chunk_keys",
        "changed",
    ),
)
def apply_to_vectors(spark, sf_dir):
    """A vector per chunk (its length) after the change set."""
    new = inputs.changed_keys(spark, sf_dir).withColumn("embedding", F.array(F.length("content").cast("float")))
    old = _sized_by_text(inputs.chunk_keys(spark, sf_dir))
    return _sized(index.replace_vectors(old, new)).select("id", "first")


@query(
    "F04_apply_to_cells",
    sql(
        f"""SELECT row_key, qualifier, epoch(ts)::BIGINT AS ts, value FROM cells WHERE row_key NOT IN ({STALE}) UNION ALL
        SELECT row_key, q, epoch({T0})::BIGINT + 200 * 3600, CASE q WHEN 'link' THEN 'new' ELSE content END FROM changed,
        (VALUES ('content'), ('link')) v(q)""",
        "cells",
        "chunk_keys",
        "changed",
    ),
)
def apply_to_cells(spark, sf_dir):
    new = inputs.changed_keys(spark, sf_dir)
    cells = inputs.cells(spark, sf_dir)
    stale = index.stale_keys(cells, new)
    added = index.content_cells(new.withColumn("link", F.lit("new")), inputs.at(F.lit(200 * 3600)))
    return _cell_columns(index.apply_to_cells(cells, added, stale))


@query(
    "F05_source_links",
    sql(
        f"""SELECT row_key, {LINK.format(parts=parts('row_key'), mime='f.mime_type')} AS link FROM chunk_keys c
        LEFT JOIN files f ON f.id = 'f' || c.doc_id""",
        "chunk_keys",
        "files",
    ),
)
def source_links(spark, sf_dir):
    """Links by looking the file type up, for keys of files and of raw texts."""
    rows = inputs.chunk_keys(spark, sf_dir).select("row_key")
    return index.with_links(rows, inputs.files(spark, sf_dir)).select("row_key", "link")


@query(
    "F08_latest_cells",
    sql(
        """SELECT row_key, max_by(value, ts) FILTER (qualifier = 'content') AS content, max_by(value, ts) FILTER (qualifier = 'link') AS link
        FROM cells GROUP BY row_key""",
        "cells",
    ),
)
def latest_cells(spark, sf_dir):
    from docloom.sources import stores

    return stores.latest_cells(inputs.cells(spark, sf_dir))


# --- I: admin ------------------------------------------------------------------


@query("I01_list_keys", sql("SELECT row_key FROM chunk_keys", "chunk_keys"))
def list_keys(spark, sf_dir):
    return admin.list_keys(inputs.chunk_keys(spark, sf_dir))


@query(
    "I02_list_documents",
    sql(
        "SELECT DISTINCT string_split(doc_key, '___')[1] AS name, string_split(doc_key, '___')[2] AS drive_id FROM chunk_keys WHERE doc_key LIKE '%\\_\\_\\_%' ESCAPE '\\'",
        "chunk_keys",
    ),
)
def list_documents(spark, sf_dir):
    return admin.list_documents(inputs.chunk_keys(spark, sf_dir))


@query(
    "I03_list_urls",
    sql(
        "SELECT id AS file_id, web_view_link FROM files WHERE id IN (SELECT 'f' || doc_id FROM chunk_keys WHERE doc_key NOT LIKE 'raw%')",
        "chunk_keys",
        "files",
    ),
)
def list_urls(spark, sf_dir):
    return admin.list_urls(inputs.chunk_keys(spark, sf_dir), inputs.files(spark, sf_dir))


BOTH = "SELECT 'vector' AS store, row_key FROM chunk_keys WHERE {keep} UNION ALL SELECT 'content', row_key FROM cells WHERE {keep}"


def _both(vectors, content):
    return vectors.select(F.lit("vector").alias("store"), F.col("id").alias("row_key")).unionByName(
        content.select(F.lit("content").alias("store"), "row_key")
    )


@query("I04_delete_keys", sql(BOTH.format(keep="row_key NOT IN (SELECT row_key FROM changed)"), "chunk_keys", "cells", "changed"))
def delete_keys(spark, sf_dir):
    vectors = _sized_by_text(inputs.chunk_keys(spark, sf_dir))
    return _both(*admin.delete_keys(vectors, inputs.cells(spark, sf_dir), inputs.changed_keys(spark, sf_dir)))


@query(
    "I05_delete_documents",
    sql(
        BOTH.format(keep="row_key NOT IN (SELECT row_key FROM chunk_keys WHERE doc_key NOT LIKE 'raw%' AND doc_id IN (SELECT doc_id FROM labels))"),
        "chunk_keys",
        "cells",
    ),
)
def delete_documents(spark, sf_dir):
    """All chunks of the labelled files, given by name and file id."""
    gone = admin.list_documents(inputs.changed_keys(spark, sf_dir))
    vectors = _sized_by_text(inputs.chunk_keys(spark, sf_dir))
    return _both(*admin.delete_documents(vectors, inputs.cells(spark, sf_dir), gone))


# --- S-05 ----------------------------------------------------------------------


@query(
    "S05_session_state",
    sql(
        """SELECT session, epoch(ts)::BIGINT AS ts, exchange FROM (SELECT *, row_number() OVER
        (PARTITION BY session ORDER BY ts DESC, exchange) AS rn FROM exchanges) WHERE rn <= 5""",
        "exchanges",
    ),
)
def session_state(spark, sf_dir):
    """Newest exchanges of every session, kept as stream state."""
    stored = inputs.exchanges(spark, sf_dir)
    folder = new_folder(spark, "exchanges")
    stored.write.parquet(folder)
    out, checkpoint = new_folder(spark, "s05"), new_folder(spark, "s05-checkpoint")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    try:
        stream = jobs.session_state(spark.readStream.schema(stored.schema).parquet(folder))
        # one batch: a state with a time to live asks for further empty batches without end
        run = jobs.each_batch(
            stream, lambda rows, _: rows.write.mode("append").parquet(out), checkpoint, once=True
        )
        if not run.awaitTermination(600):
            run.stop()
            raise TimeoutError("the session stream did not finish")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema("session string, ts timestamp, exchange string").parquet(out).select(
        "session", F.unix_timestamp("ts").alias("ts"), "exchange"
    )
