"""The content key: building it, taking it apart, and reading ids out of file URLs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.fixed_values import FILE_URL_MARKERS, KEY_SEPARATOR, URL_PROTOCOLS


def key_parts(key: Column) -> Column:
    """Split on the separator and drop trailing empty parts; a key without separator is one part.

    Only a key that ends with a separator has such parts, so all others are a plain split.
    """
    parts = F.split(key, KEY_SEPARATOR)
    from_end = F.array_position(F.transform(F.reverse(parts), lambda p: p != ""), F.lit(True))
    kept = F.when(from_end > 0, F.slice(parts, 1, (F.size(parts) - from_end + 1).cast("int"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.when(key.endswith(KEY_SEPARATOR), kept).otherwise(parts)


def part(key: Column, position: int) -> Column:
    return F.get(key_parts(key), F.lit(position))


def is_drive_key(key: Column) -> Column:
    """Three parts: title, file id, chunk position."""
    return F.size(key_parts(key)) == 3


def doc_key(key: Column) -> Column:
    """The document a chunk key belongs to."""
    parts = key_parts(key)
    return F.when(
        F.size(parts) == 3,
        F.concat_ws(KEY_SEPARATOR, F.get(parts, F.lit(0)), F.get(parts, F.lit(1))),
    ).otherwise(F.get(parts, F.lit(0)))


def file_id(key: Column) -> Column:
    parts = key_parts(key)
    return F.when(F.size(parts) == 3, F.get(parts, F.lit(1))).otherwise(F.lit(""))


def owner(key: Column) -> Column:
    """What a chunk belongs to whatever its title: the file id, or the reference itself.

    A renamed file keeps its owner, so its old chunks are found again.  Where a title or an id
    holds the separator itself, the parts don't tell which is the id: then everything before the
    chunk position is the owner, which no other document shares.
    """
    parts = key_parts(key)
    whole = F.concat_ws(KEY_SEPARATOR, F.slice(parts, 1, F.size(parts) - 1))
    return (
        F.when(F.size(parts) == 3, F.get(parts, F.lit(1)))
        .when(F.size(parts) > 3, whole)
        .otherwise(F.get(parts, F.lit(0)))
    )


FILE_OWNER, TEXT_OWNER = "file:", "text:"


def owner_of_file(id_: Column) -> Column:
    """Owner to store with the chunks of a file: its id, whatever title it has now."""
    return F.concat(F.lit(FILE_OWNER), id_)


def owner_of_text(key: Column) -> Column:
    """Owner to store with the chunks of a text or a reference: its key."""
    return F.concat(F.lit(TEXT_OWNER), key)


def owns_file(owner: Column) -> Column:
    return owner.startswith(FILE_OWNER)


def id_of_owner(owner: Column) -> Column:
    """File id or key of a stored owner."""
    return F.substring(owner, F.lit(len(FILE_OWNER) + 1), F.length(owner))


def chunk_key(document_key: Column, position: Column) -> Column:
    return F.concat_ws(KEY_SEPARATOR, document_key, position.cast("string"))


@F.pandas_udf(T.StringType())
def decompose_accents(text: pd.Series) -> pd.Series:
    """Unicode canonical decomposition; Spark has no such function."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFD", s))


def new_doc_key(title: Column, document_id: Column, ascii_only: bool = False) -> Column:
    """Readable document key from a title and a file id.

    Only titles with other characters than ASCII are handed to Python.  With ``ascii_only`` the
    caller vouches that there are none and the whole expression stays in generated code.
    """
    accented = F.when(title.rlike("[^\\x00-\\x7F]"), title)
    plain = title if ascii_only else F.coalesce(decompose_accents(accented), title)
    plain = F.regexp_replace(plain, " +", "_")
    plain = F.regexp_replace(plain, r"[\[\]()\n\r]", "")
    return F.concat(F.lower(plain), F.lit(KEY_SEPARATOR), document_id)


def is_url(text: Column) -> Column:
    """An absolute URL with a known protocol and, if a port is given, a numeric one."""
    protocols = "|".join(URL_PROTOCOLS)
    return F.coalesce(text.rlike(rf"(?i)^ *({protocols}):"), F.lit(False)) & ~text.rlike(
        r"^[^:]+://[^/?#:]*:[^/?#]*[^0-9/?#][^/?#]*"
    )


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)


def id_from_url(url: Column) -> Column:
    """File or folder id of a shared link; null when the link holds none."""
    path = url_path(url)
    found = F.lit(None).cast("string")
    for marker in reversed(FILE_URL_MARKERS):
        found = F.when(
            path.contains(marker), F.nullif(F.regexp_extract(path, marker + "([^/]*)", 1), F.lit(""))
        ).otherwise(found)
    return found


def id_from_url_or_id(text: Column) -> Column:
    """A shared link gives its id (or null), anything else is an id already."""
    return F.when(is_url(text), id_from_url(text)).otherwise(text)
