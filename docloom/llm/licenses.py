"""License notices in texts: ordered signature rules with a keyword gate.

Every text is turned into lower-case words parted by single spaces.  Each rule is a regular
expression over that form with keywords, of which any match has one; only rules with a keyword
among the text's words are tried.  Detections are intervals of words.  One that lies within an interval of higher priority, or of equal priority that starts
earlier or is longer, is suppressed.  Everything is DataFrame functions without a shuffle.

Defined cases: null and empty texts have no words, no labels and score 0; equal rows are judged
each by itself; columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of the contract on the original text, and what parts words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: (keywords, one for each way of calling it, how the license is called, versions).
FAMILIES = {
    "mit": ("mit|expat|x11", "mit|expat|x11", ""),
    "apache": ("apache", "apache(?: software)?", "1 0|1 1|2 0|2"),
    "gpl": ("general", "(?:gnu )?general public", "1|2|3|1 0|2 0|3 0"),
    "lgpl": ("lesser|library", "(?:gnu )?(?:lesser|library) general public", "2|2 1|3|3 0"),
    "agpl": ("affero", "(?:gnu )?affero general public", "1|3|3 0"),
    "fdl": ("documentation", "(?:gnu )?free documentation", "1 1|1 2|1 3"),
    "bsd": ("bsd", "(?:[234] clause |simplified |modified |new |revised |original )?bsd(?: [0234] clause)?", ""),
    "mpl": ("mozilla", "mozilla public", "1 0|1 1|2 0"),
    "epl": ("eclipse", "eclipse public", "1 0|2 0"),
    "cddl": ("cddl|development", "cddl|common development and distribution", "1 0|1 1"),
    "eupl": ("european", "european union public", "1 1|1 2"),
    "isc": ("isc", "isc", ""),
    "zlib": ("zlib", "zlib(?: libpng)?", ""),
    "boost": ("boost", "boost software", "1 0"),
    "artistic": ("artistic", "artistic", "1 0|2 0"),
    "python": ("python|psf", "python software foundation|psf", "2"),
    "ofl": ("font", "sil open font", "1 0|1 1"),
    "unlicense": ("unlicense", "unlicense", ""),
    "wtfpl": ("fuck", "do what the fuck you want to public", "2"),
    "ms-pl": ("microsoft", "microsoft public", ""),
    "cpl": ("common", "common public", "1 0"),
    "osl": ("open", "open software", "1 0|2 0|2 1|3 0"),
    "afl": ("academic", "academic free", "2 0|2 1|3 0"),
    "odbl": ("database", "open database", "1 0"),
    "nc-gov": ("open", "open government", "1 0|2 0|3 0"),
    "proprietary": ("proprietary|commercial", "proprietary|commercial", ""),
}

#: label: short names as they stand in identifiers.
SHORT = {
    "mit": "mit",
    "apache": "apache 2 0|apache 1 1",
    "gpl": "gpl [123](?: 0)?(?: only| or later)?|gplv[123]",
    "lgpl": "lgpl [23](?: [01])?(?: only| or later)?|lgplv[23]",
    "agpl": "agpl 3(?: 0)?(?: only| or later)?|agplv3",
    "bsd": "bsd [234] clause|0bsd",
    "mpl": "mpl [12] [01]",
    "epl": "epl [12] 0",
    "cc0": "cc0(?: 1 0)?",
    "isc": "isc",
    "zlib": "zlib",
    "unlicense": "unlicense",
}

#: Creative Commons: label, the words after "cc by", and those of the long name.
COMMONS = {
    "cc-by-nc-nd": ("nc nd", "noncommercial no ?derivatives|non commercial no ?derivatives"),
    "cc-by-nc-sa": ("nc sa", "noncommercial share ?alike|non commercial share ?alike"),
    "cc-by-nc": ("nc", "noncommercial|non commercial"),
    "cc-by-nd": ("nd", "no ?derivatives"),
    "cc-by-sa": ("sa", "share ?alike"),
    "cc-by": ("", ""),
}

#: How a name stands in a notice: form, priority, confidence.
FORMS = [
    ("(?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of the )?(?:{name}) licen[sc]e", 3, 1.0),
    ("(?:permission|use|redistribution) (?:is|are) (?:granted|governed|permitted) (?:by|under) (?:the )?(?:{name}) licen[sc]e", 3, 1.0),
    ("under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[sc]e)?", 2, 0.9),
    ("(?:{name}) licen[sc]e", 1, 0.8),
    ("licen[sc]e (?:is )?(?:the )?(?:{name})", 1, 0.7),
]
VERSIONED = [
    ("(?:{name}) licen[sc]e (?:version |v ?)?(?:{version})", 3, 1.0),
    ("(?:{name}) (?:version |v ?)?(?:{version})", 2, 0.8),
]
PRIORITIES = (1, 2, 3)


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keywords parted by |, pattern, label, priority, confidence), in their order."""
    made = []
    for label, (keywords, name, versions) in FAMILIES.items():
        made += [(keywords, form.format(name=name), label, p, c) for form, p, c in FORMS]
        for version in versions.split("|") if versions else ():
            made += [(keywords, form.format(name=name, version=version), label, p, c) for form, p, c in VERSIONED]
    for label, name in SHORT.items():
        made.append(("spdx", f"spdx licen[sc]e identifier (?:{name})", label, 3, 1.0))
        for word in ("licensed", "license", "licence"):
            made.append((word, f"{word} (?:under )?(?:the )?(?:{name})", label, 2, 0.9))
    for label, (short, long) in COMMONS.items():
        tail = f" {short}" if short else ""
        for version in ("", " 1 0", " 2 0", " 2 5", " 3 0", " 4 0"):
            made.append(("cc", f"cc by{tail}{version}", label, 3 if version else 2, 1.0 if version else 0.8))
        full = f" (?:{long})" if long else ""
        made.append(("creative", f"creative commons attribution{full}(?: [1-4] [05])?(?: international| unported)?", label, 3, 1.0))
    made += [
        ("reserved", "all rights reserved", "proprietary", 1, 0.5),
        ("domain", "(?:dedicated to|released into|placed in|in) the public domain", "public-domain", 2, 0.7),
        ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9](?: [0-9]{4})*", "copyright", 1, 0.3),
        ("warranty", "without warranty of any kind", "disclaimer", 1, 0.3),
        ("warranties", "without warranties or conditions of any kind", "apache", 2, 0.7),
        ("permission", "permission is hereby granted free of charge to any person obtaining a copy", "mit", 3, 1.0),
        ("redistribution", "redistribution and use in source and binary forms with or without modification", "bsd", 3, 1.0),
    ]
    return made


def normal_text(text: Column) -> Column:
    """Lower-case words, each with a space before it, and a space at the end."""
    words = F.regexp_replace(F.translate(text, UPPER, LOWER), PARTS, " ")
    return F.concat(F.lit(" "), F.btrim(words), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(normal: Column, pattern: Column) -> Column:
    """Intervals of words (start, end) that match a pattern, from left to right."""
    marked = F.regexp_replace(normal, F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )")), F.lit("\u0001$0\u0002"))
    pieces = F.split(marked, "\u0001")
    empty = F.struct(
        F.lit(0).alias("words"), F.array().cast("array<struct<start:int,end:int>>").alias("found")
    )

    def add(state: Column, piece: Column) -> Column:
        size = F.when(F.contains(piece, F.lit("\u0002")), _spaces(F.substring_index(piece, "\u0002", 1))).otherwise(0)
        one = F.struct(state["words"].alias("start"), (state["words"] + size).alias("end"))
        return F.struct(
            (state["words"] + _spaces(piece)).alias("words"),
            F.when(size > 0, F.array_append(state["found"], one)).otherwise(state["found"]).alias("found"),
        )

    return F.when(F.size(pieces) > 1, F.aggregate(pieces, empty, add)["found"]).otherwise(empty["found"])


def _rule_table() -> Column:
    return F.array(
        *[
            F.struct(
                F.array(*map(F.lit, keywords.split("|"))).alias("keywords"),
                F.lit(pattern).alias("pattern"),
                F.lit(label).alias("label"),
                F.lit(priority).alias("priority"),
                F.lit(confidence).alias("confidence"),
                F.lit(order).alias("rank"),
            )
            for order, (keywords, pattern, label, priority, confidence) in enumerate(rules())
        ]
    )


def _detections() -> Column:
    """All detections of the rules that the keywords let through, in sweeping order."""
    active = F.filter(F.col("rules"), lambda rule: F.arrays_overlap("keywords", rule["keywords"]))
    found = F.flatten(
        F.transform(
            active,
            lambda rule: F.transform(
                places(F.col("normal"), rule["pattern"]),
                lambda at: F.struct(
                    at["start"].alias("start"),
                    (-at["end"]).alias("before"),
                    (-rule["priority"]).alias("minor"),
                    rule["rank"].alias("rank"),
                    rule["label"].alias("label"),
                    rule["confidence"].alias("confidence"),
                ),
            ),
        )
    )
    return F.array_sort(found)


def _suppress(found: Column) -> Column:
    """Sweep by start: the furthest end so far of each priority tells what is contained."""
    start = F.struct(
        *[F.lit(-1).alias(f"end{p}") for p in PRIORITIES],
        F.array().cast("array<string>").alias("labels"),
        F.lit(0.0).alias("score"),
        F.lit(0).alias("n"),
    )

    def add(state: Column, one: Column) -> Column:
        end, priority = -one["before"], -one["minor"]
        contained = reduce(
            lambda a, b: a | b, [(priority <= p) & (state[f"end{p}"] >= end) for p in PRIORITIES]
        )
        ends = [
            F.when(~contained & (priority == p), F.greatest(state[f"end{p}"], end))
            .otherwise(state[f"end{p}"])
            .alias(f"end{p}")
            for p in PRIORITIES
        ]
        return F.struct(
            *ends,
            F.when(contained, state["labels"])
            .otherwise(F.array_union(state["labels"], F.array(one["label"])))
            .alias("labels"),
            F.when(contained, state["score"]).otherwise(F.greatest(state["score"], one["confidence"])).alias("score"),
            (state["n"] + F.when(contained, 0).otherwise(1)).alias("n"),
        )

    return F.aggregate(found, start, add)


def scan(documents: DataFrame) -> DataFrame:
    """Per document the contract's columns, and how many detections stay."""
    text = F.coalesce("text", F.lit(""))
    words = sorted({word for keywords, *_ in rules() for word in keywords.split("|")})
    known = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        normal_text(text).alias("normal"),
    )
    known = known.withColumn(
        "keywords",
        F.array_intersect(F.array(*map(F.lit, words)), F.split("normal", " ")),
    ).withColumn("rules", _rule_table())
    known = known.withColumn("swept", F.when(F.size("keywords") > 0, _suppress(_detections())))
    base = F.transform(
        F.array(*[F.struct(F.lit(k).alias("phrase"), F.lit(v).alias("label")) for k, v in BASE.items()]),
        lambda one: F.struct(
            one["label"].alias("label"),
            F.transform(places(F.col("normal"), one["phrase"]), lambda at: at["start"]).alias("starts"),
        ),
    )
    known = known.withColumn("base", base)
    known = known.withColumn("starts", F.flatten(F.transform("base", lambda b: b["starts"])))
    known = known.withColumn(
        "named",
        F.coalesce(
            F.transform(F.filter("base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"]),
            F.array().cast("array<string>"),
        ),
    )
    labels = F.array_union("named", F.coalesce(F.col("swept.labels"), F.array().cast("array<string>")))
    return known.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("named")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.coalesce(F.col("swept.score"), F.lit(0.0)).alias("score"),
        F.coalesce(F.col("swept.n"), F.lit(0)).cast("long").alias("n_detections"),
    )
