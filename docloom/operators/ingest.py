"""Parse, validate and route ingestion messages.

A failure is a row, not an exception: every function returns ordinary columns, and
what cannot be used ends in an error row that keeps the whole payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.fixed_values import INGESTION_MIME_TYPES, LINK_MIME_TYPES
from docloom.functions import keys
from docloom.functions.text import base64_text, is_blank, literal_map
from docloom.sources.schemas import REQUEST

CORRUPT = "_corrupt"


def is_ingestion_mime(mime: Column) -> Column:
    return F.coalesce(mime.isin(INGESTION_MIME_TYPES), F.lit(False))


def link_mime(mime: Column) -> Column:
    """Link version of a MIME type, null where there is none."""
    return F.try_element_at(literal_map(LINK_MIME_TYPES), mime)


def parse_requests(messages: DataFrame) -> DataFrame:
    """Add ``request`` (null when the payload is not a valid request).

    Unknown properties are ignored.  Broken JSON and MIME types outside the fixed list
    make the whole message invalid.
    """
    parsed = F.from_json(
        "payload",
        f"{REQUEST}, {CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    raw_mime = F.col("r.rawData.mimeType")
    bad_mime = (raw_mime.isNotNull() & ~is_ingestion_mime(raw_mime)) | F.coalesce(
        F.exists("r.references", lambda x: x["mimeType"].isNotNull() & ~is_ingestion_mime(x["mimeType"])),
        F.lit(False),
    )
    usable = F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull() & ~bad_mime
    # exploding one value keeps later filters from repeating the parse inside themselves
    return (
        messages.select("*", F.explode(F.array(parsed)).alias("r"))
        .withColumn(
            "request",
            F.when(usable, F.struct("r.googleDrive", "r.rawData", "r.references")),
        )
        .drop("r")
    )


def route(requests: DataFrame) -> DataFrame:
    """Add ``route``: the first member present decides, in the order drive, raw, references."""
    return requests.withColumn(
        "route",
        F.when(F.col("request").isNull(), "malformed")
        .when(F.col("request.googleDrive").isNotNull(), "drive")
        .when(F.col("request.rawData").isNotNull(), "raw")
        .when(F.col("request.references").isNotNull(), "references")
        .otherwise("unsupported"),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``valid`` and ``reason``: at least one member has to be given."""
    present = F.coalesce(
        F.col("request.googleDrive").isNotNull()
        | F.col("request.rawData").isNotNull()
        | F.col("request.references").isNotNull(),
        F.lit(False),
    )
    return requests.withColumn("valid", present).withColumn(
        "reason",
        F.when(~present, "The request names no file, no raw text and no reference"),
    )


def uploads_to_requests(uploads: DataFrame) -> DataFrame:
    """Multipart uploads to request payloads; an incomplete row gets a ``reason`` instead."""
    complete = (
        ~is_blank(F.col("documentId")) & F.col("documentContent").isNotNull() & ~is_blank(F.col("mimeType"))
    )
    body = F.struct(
        F.struct(
            F.col("documentId").alias("id"),
            base64_text(F.col("documentContent")).alias("data"),
            F.col("mimeType"),
        ).alias("rawData")
    )
    return uploads.select(
        "documentId",
        F.when(complete & is_ingestion_mime(F.col("mimeType")), F.to_json(body)).alias("payload"),
        F.when(~complete, "Id, content or type of the upload is missing")
        .when(~is_ingestion_mime(F.col("mimeType")), F.concat(F.lit("Unknown upload type: "), F.col("mimeType")))
        .alias("reason"),
    )


def drive_transports(routed: DataFrame) -> DataFrame:
    """One row per requested file or folder, carrying the message attributes."""
    return routed.filter(F.col("route") == "drive").select(
        "ts",
        F.col("attributes").alias("metadata"),
        F.explode("request.googleDrive.urlOrId").alias("content_id"),
    )


def decode_text(data: Column, rounds: int = 2) -> Column:
    """Undo ``rounds`` of base64; null when any round meets something else."""
    decoded = data
    for _ in range(rounds):
        decoded = F.try_to_binary(decoded, F.lit("base64")).cast("string")
    return decoded


def raw_contents(routed: DataFrame, decode_rounds: int = 2) -> DataFrame:
    """Raw text messages as contents; ``content`` is null where the message has to fail."""
    raw = F.col("request.rawData")
    text = F.when(raw["mimeType"] == "text/plain", decode_text(raw["data"], decode_rounds))
    decoded = routed.filter(F.col("route") == "raw").select(
        "ts",
        # a drop of failed rows later on would otherwise decode once more
        F.explode(F.array(text)).alias("text"),
        "payload",
        "attributes",
        raw["id"].alias("key"),
        raw["mimeType"].alias("type"),
    )
    return decoded.select(
        "ts",
        "payload",
        "attributes",
        "key",
        F.when(F.col("text").isNotNull(), F.array("text")).alias("content"),
        "type",
        F.when(F.col("type").isNull() | (F.col("type") != "text/plain"), "This kind of request is not served")
        .when(F.col("text").isNull(), "The raw text is not base64 twice over")
        .alias("failure"),
    )


def reference_contents(routed: DataFrame) -> DataFrame:
    """References up to the first unsupported one; that one becomes a single failure row.

    The position of the first unsupported reference is found inside the message's own
    array, so nothing is shuffled.
    """
    refs = F.col("request.references")
    supported = F.transform(refs, lambda r: link_mime(r["mimeType"]).isNotNull())
    first_bad = F.array_position(supported, F.lit(False))
    kept = F.when(first_bad > 0, F.slice(refs, 1, first_bad.cast("int"))).otherwise(refs)
    rows = routed.filter(F.col("route") == "references").select(
        "ts", "payload", "attributes", F.explode(kept).alias("ref")
    )
    ok = link_mime(F.col("ref.mimeType")).isNotNull()
    return rows.select(
        "ts",
        "payload",
        "attributes",
        F.col("ref.url").alias("key"),
        F.when(ok, F.array("ref.url")).alias("content"),
        F.coalesce(link_mime(F.col("ref.mimeType")), F.col("ref.mimeType")).alias("type"),
        F.when(~ok, "This kind of request is not served").alias("failure"),
    )


def request_of(owner: Column, key: Column, content_type: Column, content: Column) -> Column:
    """The request that brings a content in again: its file, its reference, or the text itself."""
    mime_of_link = literal_map({link: mime for mime, link in LINK_MIME_TYPES.items()})
    mime = F.try_element_at(mime_of_link, content_type)
    text = F.array_join(content, "\n")
    coded = base64_text(base64_text(text.cast("binary")).cast("binary"))
    files = F.struct(F.array(F.struct(keys.id_of_owner(owner).alias("urlOrId"))).alias("googleDrive"))
    reference = F.struct(F.array(F.struct(key.alias("url"), mime.alias("mimeType"))).alias("references"))
    raw = F.struct(F.struct(key.alias("id"), coded.alias("data"), F.lit("text/plain").alias("mimeType")).alias("rawData"))
    return (
        F.when(keys.owns_file(owner), F.to_json(files)).when(mime.isNotNull(), F.to_json(reference)).otherwise(F.to_json(raw))
    )


def contents_of(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("failure").isNull()).select("key", "content", "type")


def message_failures(routed: DataFrame, *failed: DataFrame) -> DataFrame:
    """Failed messages of every branch in one shape: stage, payload, reason."""
    rejected = routed.filter(F.col("route").isin("malformed", "unsupported")).select(
        "ts",
        F.lit("message").alias("stage"),
        F.col("payload").alias("element"),
        F.when(F.col("route") == "malformed", "Malformed request")
        .otherwise("This kind of request is not served")
        .alias("message"),
    )
    for branch in failed:
        rejected = rejected.unionByName(
            branch.filter(F.col("failure").isNotNull()).select(
                "ts",
                F.lit("message").alias("stage"),
                F.col("payload").alias("element"),
                F.col("failure").alias("message"),
            )
        )
    return rejected


def add_mime(metadata: Column, mime: Column, name: str) -> Column:
    """Add an entry to a metadata map unless the key is there already."""
    base = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    return F.when(F.map_contains_key(base, F.lit(name)), base).otherwise(
        F.map_concat(base, F.create_map(F.lit(name), mime))
    )


def union_contents(*contents: DataFrame) -> DataFrame:
    whole = contents[0].select("key", "content", "type")
    for more in contents[1:]:
        whole = whole.unionByName(more.select("key", "content", "type"))
    return whole
