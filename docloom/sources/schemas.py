"""Explicit schemas of every input and store; nothing is inferred."""

REQUEST = (
    "googleDrive array<struct<urlOrId: string>>, "
    "rawData struct<id: string, data: string, mimeType: string>, "
    "references array<struct<url: string, mimeType: string>>"
)

MESSAGES = "ts timestamp, payload string, attributes map<string,string>"
UPLOADS = "documentId string, documentContent binary, mimeType string"
FILES = (
    "id string, parent_id string, mime_type string, modified_time timestamp, name string, web_view_link string"
)

PARAGRAPH = "struct<elements: array<struct<text_run: struct<content: string>>>>"
DOC_BODIES = (
    f"id string, content array<struct<paragraph: {PARAGRAPH}, "
    f"table: struct<rows: array<struct<cells: array<struct<content: array<struct<paragraph: {PARAGRAPH}>>>>>>>>>"
)
SHEET_BODIES = "id string, sheets array<struct<title: string, cells: array<array<string>>>>"
SLIDE_BODIES = (
    "id string, slides array<struct<page_elements: array<struct<shape: struct<text: struct<"
    "text_elements: array<struct<text_run: struct<content: string>>>>>>>>>"
)

CONTENTS = "key string, content array<string>, type string"
CHUNKS = "key string, idx int, chunk string"
INDEXABLE = "row_key string, doc_key string, content string, embedding array<float>"
CONTENT_CELLS = "row_key string, qualifier string, ts timestamp, value string"
EXCHANGES = "session string, ts timestamp, exchange string"
VECTORS = "id string, embedding array<float>"
PARAMETERS = (
    "struct<botContextExpertise: string, includeOwnKnowledgeEnrichment: boolean, maxNeighbors: int, "
    "temperature: double, maxOutputTokens: int, topK: int, topP: double>"
)
QUESTIONS = f"request_id string, text string, session_id string, parameters {PARAMETERS}"
ERRORS = (
    "kind string, stage string, content_id string, metadata map<string,string>, retry_count int, "
    "element string, class_name string, message string, ts timestamp, request string"
)
MODEL_RESPONSE = "parts array<string>, block_reason string, block_message string"
EMBEDDING_PREDICTION = (
    "textEmbedding array<double>, imageEmbedding array<double>, "
    "videoEmbeddings array<struct<startOffsetSec: int, endOffsetSec: int, embedding: array<double>>>"
)
EMBEDDING_INSTANCE = (
    "text string, image struct<bytesBase64Encoded: string, gcsUri: string, mimeType: string>, "
    "video struct<bytesBase64Encoded: string, gcsUri: string, "
    "videoSegmentConfig: struct<startOffsetSec: int, endOffsetSec: int, intervalSec: int>>"
)
