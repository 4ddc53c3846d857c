"""The visible text of HTML pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is not text of the page.
HIDDEN = ("script", "style", "template", "noscript")
#: Elements that begin and end a line.
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p",
    "pre", "section", "table", "td", "th", "title", "tr", "ul",
)
#: Named characters; the ampersand comes last, so that no text is decoded twice.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "middot": "·", "copy": "©", "reg": "®", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "euro": "€", "amp": "&",
}

#: Patterns and replacements in order: comments, hidden elements, block tags, other tags.
STEPS = [
    ("(?is)<!--.*?-->", " "),
    *((rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ") for name in HIDDEN),
    (rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n"),
    ("<[a-zA-Z/!?][^>]*>", ""),
]


def page_text(html: Column) -> Column:
    """Text of a page, one line for each block that has any; null for null."""
    text = html
    for pattern, instead in STEPS:
        text = F.regexp_replace(text, pattern, instead)
    for name, character in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(character))
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r ]+", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")
