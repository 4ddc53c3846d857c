"""Quality rules: word, symbol and repetition counts of a text, and lines that a host repeats.

Everything is DataFrame functions; the texts themselves are never shuffled.  Lines are normalised
(lower case, no white space at the ends) and hashed.  For every host the
distinct documents with a line are counted; a line in more than ``LINE_DOCUMENTS`` documents of
its host and more than ``LINE_SHARE`` of them is boilerplate and counts as removed.  A document
left with less than ``LEAST_LEFT`` of its characters is rejected.

Defined cases: null and empty texts have no words; rows without a source form one host; equal rows
(id, source and text) are one document for the line counts and get the same verdict; rows with
equal ids and different texts are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, and what parts words, in the quality contract.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
RUN = 8

LINE_DOCUMENTS = 5
LINE_SHARE = 0.001
LEAST_LEFT = 0.3
LEAST_WORDS = 20
MOST_REPEATED = 30


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def with_runs(known: DataFrame) -> DataFrame:
    """Adds ``runs``: a hash of each eight consecutive words, made of pairs, fours and eights."""
    known = known.withColumn("runs", F.transform("words", lambda word: F.xxhash64(word)))
    for width in (1, 2, 4):
        known = known.withColumn("runs", F.transform("runs", _joined(width)))
    count = F.greatest(F.size("words") - (RUN - 1), F.lit(0))
    return known.withColumn("runs", F.slice("runs", 1, count))


def _joined(width: int):
    return lambda own, i: F.xxhash64(own, F.get("runs", i + width))


def with_repeats(known: DataFrame) -> DataFrame:
    """Adds ``repeated``: words in runs that the text has twice or more; few texts go past the first test."""
    unique = F.size(F.array_distinct("runs")) == F.size("runs")
    placed = F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    known = known.withColumn("placed", F.when(unique, nothing).otherwise(placed))

    def again(entry: Column, k: Column) -> Column:
        before, after = F.get("placed", k - 1)["h"], F.get("placed", k + 1)["h"]
        return F.coalesce(before == entry["h"], F.lit(False)) | F.coalesce(after == entry["h"], F.lit(False))

    places = F.array_sort(F.transform(F.filter("placed", again), lambda entry: entry["i"]))
    start = F.struct(F.lit(0).alias("covered"), F.lit(-RUN).alias("last"))

    def add(total: Column, at: Column) -> Column:
        more = F.least(F.lit(RUN), at - total["last"])
        return F.struct((total["covered"] + more).alias("covered"), at.alias("last"))

    return known.withColumn("repeated", F.aggregate(places, start, add)["covered"])


def _solid_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def normal_line(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def counts(documents: DataFrame) -> DataFrame:
    """doc_id, host, text_hash, the contract's counts, and the lines as (hash, words)."""
    text = F.coalesce("text", F.lit(""))
    base = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("host"),
        F.xxhash64("text").alias("text_hash"),
        text.alias("text"),
    )
    known = base.withColumn("words", words_of(F.col("text"))).withColumn("lines", _solid_lines(F.col("text")))
    known = with_repeats(with_runs(known))
    return known.select(
        "doc_id",
        "host",
        "text_hash",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length("text").cast("long").alias("n_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("repeated").cast("long").alias("n_repeat_words"),
    )


def line_rows(documents: DataFrame) -> DataFrame:
    """doc_id, host, text_hash, and for each line of the text its hash and characters."""
    lines = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("host"),
        F.xxhash64("text").alias("text_hash"),
        F.explode(_solid_lines(F.coalesce("text", F.lit("")))).alias("line"),
    )
    return lines.select(
        "doc_id",
        "host",
        "text_hash",
        F.xxhash64(normal_line(F.col("line"))).alias("line"),
        F.length("line").alias("chars"),
    )


def boilerplate(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """(host, line) of the lines above the limits of their host."""
    hosts = documents.groupBy(F.col("source").cast("string").alias("host")).agg(F.count("*").alias("documents"))
    spread = (
        lines.groupBy("host", "line")
        .agg(F.count_distinct(F.xxhash64("doc_id", "text_hash")).alias("found"))
        .where(F.col("found") > LINE_DOCUMENTS)
    )
    return (
        spread.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
        .where(F.col("found") > LINE_SHARE * F.col("documents"))
        .select("host", "line")
    )


def removed_chars(documents: DataFrame) -> DataFrame:
    """Per document with boilerplate (doc_id, text_hash, host) the characters of the lines removed."""
    lines = line_rows(documents)
    marked = boilerplate(documents, lines).select(F.col("host").alias("h"), F.col("line").alias("l"))
    hit = lines.join(marked, (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")))
    return hit.groupBy("doc_id", "host", "text_hash").agg(F.sum("chars").alias("chars"))


def judge(documents: DataFrame) -> DataFrame:
    """Per document the contract's counts, base_failed, kept and removed_chars."""
    facts = counts(documents)
    # Equal rows have their lines in the sum once each: copies divide it again.
    copies = facts.groupBy("doc_id", "host", "text_hash").agg(F.count("*").alias("copies"))
    removed = removed_chars(documents).join(_names(copies), _same("doc_id", "host", "text_hash")).select(
        F.col("doc_id").alias("d"),
        F.col("host").alias("h"),
        F.col("text_hash").alias("t"),
        (F.col("chars") / F.col("copies")).cast("long").alias("removed"),
    )
    joined = facts.join(
        removed,
        F.col("doc_id").eqNullSafe(F.col("d"))
        & F.col("host").eqNullSafe(F.col("h"))
        & (F.col("text_hash") == F.col("t")),
        "left",
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_chars") - F.coalesce("removed", F.lit(0))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= LEAST_LEFT * F.col("n_chars"))).alias("kept"),
        F.coalesce("removed", F.lit(0)).cast("long").alias("removed_chars"),
    )


def _names(copies: DataFrame) -> DataFrame:
    return copies.select(*[F.col(c).alias(f"{c}_2") for c in ("doc_id", "host", "text_hash")], "copies")


def _same(*columns: str) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_2"))
    return same
