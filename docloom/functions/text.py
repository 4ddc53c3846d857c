"""Small text predicates and maps shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of space that are not a single blank already.
SPACES = r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]"


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return text.isNull() | ~text.rlike(r"\S")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def strip_line_breaks(text: Column) -> Column:
    return F.regexp_replace(text, r"[\n\r]", "")


def base64_text(data: Column) -> Column:
    """Base64 in one line; Spark breaks long values with CR LF by default."""
    return strip_line_breaks(F.base64(data))


def token_count(text: Column) -> Column:
    """Words of a text whose spaces are collapsed: spaces + 1, or 0 for empty text."""
    return F.when(text == "", F.lit(0)).otherwise(
        F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    )


def contains_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def literal_map(pairs: dict[str, str]) -> Column:
    entries: list[Column] = []
    for key, value in pairs.items():
        entries += [F.lit(key), F.lit(value)]
    return F.create_map(*entries)


def or_default(text: Column, *defaults) -> Column:
    """First value that is neither null nor blank."""
    values = [F.when(~is_blank(text), text)]
    values += [F.when(~is_blank(F.lit(d)), F.lit(d)) if isinstance(d, str) else d for d in defaults]
    return F.coalesce(*values)
