"""Cut texts into chunks, and choose how by content type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.fixed_values import CHUNK_MAX_TOKENS, CHUNK_MIN_TOKENS
from docloom.functions.html import page_text
from docloom.functions.text import collapse_spaces, is_blank

TARGET_TOKENS = 400
SENTENCE_ENDS = [".", "?", "!"]


def chunk_strategy(content_type: Column) -> Column:
    """``text``, ``pdf`` or ``image``; null for a type that cannot be chunked."""
    return (
        F.when(content_type == "text/plain", "text")
        .when(content_type.isin("application/pdf", "link/pdf"), "pdf")
        .when(
            content_type.isin(
                "image/png", "link/png", "image/jpeg", "link/jpeg", "image/webp", "link/webp"
            ),
            "image",
        )
    )


def non_blank(parts: Column) -> Column:
    return F.filter(parts, lambda p: ~is_blank(p))


def ends_sentence(word: Column) -> Column:
    return reduce(lambda a, b: a | b, [word.endswith(end) for end in SENTENCE_ENDS])


def text_of(lines: Column) -> Column:
    """All lines as one text with single spaces; blank lines vanish with the spaces around them."""
    return collapse_spaces(F.array_join(lines, " "))


def chunk_array(
    text: Column,
    target: int = TARGET_TOKENS,
    minimum: int = CHUNK_MIN_TOKENS,
    maximum: int = CHUNK_MAX_TOKENS,
    overlap: bool = True,
) -> Column:
    """Chunks of one text, in order.

    A word's position is the number of words before it, so the running token sum needs
    no window: everything happens inside the row and a text never has to be shuffled.

    * A piece is a sentence, or a run of at most ``limit`` words of a longer sentence.
    * A piece starting at word ``s`` belongs to chunk number ``floor(s / target)``.
    * A last chunk below ``minimum`` joins the chunk before it if both fit ``maximum``.
    * With ``overlap`` a chunk starts with the last piece of the chunk before it.

    Choosing ``limit`` as below keeps every chunk, overlap included, within ``maximum``.
    """
    limit = (maximum - target) // 2
    if limit < 1:
        raise ValueError("target must stay well below maximum")
    first_word = "lead" if overlap else "start"

    def pieces(words: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(1), F.size(words)),
            lambda i: ends_sentence(F.get(words, i - 1)),
        )
        bounds = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(F.size(words))))
        return bind(
            bounds,
            lambda b: F.flatten(
                F.transform(
                    F.slice(b, 1, F.size(b) - 1),
                    lambda s, i: F.sequence(s, F.get(b, i + 1) - 1, F.lit(limit)),
                )
            ),
        )

    def heads(starts: Column) -> Column:
        """Start of every chunk, with the start of the piece before it."""

        def head(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(starts, i - 1), F.lit(0))
            opens = (i == 0) | (F.floor(s / target) != F.floor(before / target))
            return F.when(opens, F.struct(s.alias("start"), before.alias("lead")))

        return F.filter(F.transform(starts, head), lambda h: h.isNotNull())

    def merge_last(h: Column, n: Column) -> Column:
        too_small = n - F.get(h, F.size(h) - 1)["start"] < minimum
        fits = n - F.get(h, F.size(h) - 2)[first_word] <= maximum
        return F.when((F.size(h) > 1) & too_small & fits, F.slice(h, 1, F.size(h) - 1)).otherwise(h)

    def cut(words: Column, h: Column) -> Column:
        def chunk(c: Column, i: Column) -> Column:
            end = F.coalesce(F.get(h, i + 1)["start"], F.size(words))
            return F.array_join(F.slice(words, c[first_word] + 1, end - c[first_word]), " ")

        return F.transform(h, chunk)

    def chunks(words: Column) -> Column:
        return bind(
            pieces(words),
            lambda starts: bind(
                heads(starts), lambda h: bind(merge_last(h, F.size(words)), lambda m: cut(words, m))
            ),
        )

    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(
        bind(F.split(text, " "), chunks)
    )


def bind(value: Column, body) -> Column:
    """Name an intermediate value once, so that it is computed once, by a one-element transform."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_chunks(chunked: DataFrame, *keep: str) -> DataFrame:
    """``key, idx, chunk`` rows (and the columns to keep) of a table with a ``chunks`` array.

    The outer form keeps Spark from evaluating the array twice more in a derived filter.
    """
    rows = chunked.select("key", *keep, F.posexplode_outer("chunks").alias("idx", "chunk"))
    return rows.filter("idx IS NOT NULL").select("key", "idx", "chunk", *keep)


def chunk_texts(contents: DataFrame, *keep: str, **options) -> DataFrame:
    """``key, idx, chunk`` (and the columns to keep) of all text contents."""
    texts = contents.filter(chunk_strategy(F.col("type")) == "text").withColumn("text", text_of(F.col("content")))
    return explode_chunks(
        texts.select("key", *keep, chunk_array(F.col("text"), **options).alias("chunks")), *keep
    )


def chunk_pages(contents: DataFrame, pages: DataFrame, *keep: str) -> DataFrame:
    """``key, chunks, chunk_error`` (and the columns to keep) of linked contents, from the pages they name.

    ``pages`` has ``url`` and ``html``, one row a url.  A link whose page is not there, or has no
    content, is an error row; a page without text has no chunks.
    """
    links = contents.select("key", *keep, F.explode("content").alias("url")).filter(~is_blank(F.col("url")))
    read = links.join(pages.select("url", F.col("html").alias("_html")), "url", "left")
    chunks = chunk_array(text_of(F.split(page_text(F.col("_html")), "\n")))
    return read.select(
        "key",
        *keep,
        F.when(F.col("_html").isNotNull(), chunks).alias("chunks"),
        F.when(F.col("_html").isNull(), F.concat(F.lit("The link was not read: "), F.col("url"))).alias("chunk_error"),
    )


def unchunkable(contents: DataFrame) -> DataFrame:
    """Contents whose type has no chunking strategy."""
    return contents.filter(chunk_strategy(F.col("type")).isNull()).select(
        "key", F.concat(F.lit("Type is not supported: "), F.coalesce("type", F.lit("null"))).alias("failure")
    )


def parse_chunk_response(response: Column) -> Column:
    """JSON string array written by a model; null when it is something else."""
    return F.from_json(response, "array<string>")
