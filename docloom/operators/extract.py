"""Text lines out of nested document, sheet and slide bodies.

Everything is array expressions on the body's own row: no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.fixed_values import (
    FILE_MIME_TYPES,
    METADATA_MIME_KEY,
    MIME_DOCUMENT,
    MIME_PRESENTATION,
    MIME_SPREADSHEET,
    MIME_UNKNOWN,
)
from docloom.functions.keys import new_doc_key
from docloom.functions.text import is_blank


def _strings() -> Column:
    return F.array().cast("array<string>")


def paragraph_text(paragraph: Column) -> Column:
    """Non-empty runs joined by one space; null when there are no elements at all."""
    runs = F.transform(paragraph["elements"], lambda e: F.coalesce(e["text_run"]["content"], F.lit("")))
    return F.array_join(F.filter(runs, lambda r: r != ""), " ")


def _table_text(table: Column) -> Column:
    cells = F.flatten(F.transform(table["rows"], lambda r: r["cells"]))
    blocks = F.flatten(F.transform(cells, lambda c: c["content"]))
    return F.array_join(
        F.transform(blocks, lambda b: F.coalesce(paragraph_text(b["paragraph"]), F.lit(""))), " "
    )


def _clean(lines: Column, line_break: str) -> Column:
    kept = F.filter(lines, lambda x: ~is_blank(x))
    return F.coalesce(F.transform(kept, lambda x: F.replace(x, F.lit("\n"), F.lit(line_break))), _strings())


def document_lines(content: Column) -> Column:
    texts = F.transform(
        content, lambda c: F.coalesce(paragraph_text(c["paragraph"]), _table_text(c["table"]))
    )
    return _clean(texts, "")


def sheet_lines(sheets: Column) -> Column:
    """Cells of all sheets in row order; a sheet without cells gives none."""
    rows = F.flatten(F.transform(sheets, lambda s: F.coalesce(s["cells"], F.array().cast("array<array<string>>"))))
    cells = F.flatten(F.transform(rows, lambda r: F.coalesce(r, _strings())))
    return _clean(cells, " ")


def slide_lines(slides: Column) -> Column:
    def runs(element: Column) -> Column:
        return F.coalesce(
            F.transform(
                element["shape"]["text"]["text_elements"],
                lambda t: F.coalesce(t["text_run"]["content"], F.lit("")),
            ),
            _strings(),
        )

    def slide(s: Column) -> Column:
        return F.coalesce(F.flatten(F.transform(s["page_elements"], runs)), _strings())

    return _clean(F.flatten(F.transform(slides, slide)), "")


def extract_contents(
    transports: DataFrame,
    files: DataFrame,
    documents: DataFrame,
    sheets: DataFrame,
    slides: DataFrame,
    ascii_titles: bool = False,
) -> DataFrame:
    """Contents of every transport by its MIME type: ``key, content, type, failure``.

    The transports are split by type first, so each body table is joined only with its
    own ids.  A missing body or an unsupported type is a failure row.
    """
    mime = F.try_element_at(F.col("metadata"), F.lit(METADATA_MIME_KEY))
    typed = transports.withColumn(
        "mime_type", F.when(mime.isin(FILE_MIME_TYPES), mime).otherwise(F.lit(MIME_UNKNOWN))
    )
    named = typed.join(files.select(F.col("id").alias("content_id"), "name"), "content_id", "left")

    def branch(mime_type: str, bodies: DataFrame, lines: Column) -> DataFrame:
        mine = named.filter(F.col("mime_type") == mime_type)
        body = bodies.select(F.col("id").alias("content_id"), lines.alias("content"))
        return mine.join(body, "content_id", "left")

    parts = [
        branch(MIME_DOCUMENT, documents, document_lines(F.col("content"))),
        branch(MIME_SPREADSHEET, sheets, sheet_lines(F.col("sheets"))),
        branch(MIME_PRESENTATION, slides, slide_lines(F.col("slides"))),
        named.filter(~F.col("mime_type").isin(MIME_DOCUMENT, MIME_SPREADSHEET, MIME_PRESENTATION)).withColumn(
            "content", F.lit(None).cast("array<string>")
        ),
    ]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    supported = F.col("mime_type").isin(MIME_DOCUMENT, MIME_SPREADSHEET, MIME_PRESENTATION)
    return whole.select(
        "content_id",
        "metadata",
        new_doc_key(F.col("name"), F.col("content_id"), ascii_titles).alias("key"),
        "content",
        F.lit("text/plain").alias("type"),
        F.when(~supported, F.concat(F.lit("Files of this type are not read: "), F.col("mime_type")))
        .when(F.col("content").isNull() | F.col("name").isNull(), "No such body")
        .alias("failure"),
    )
