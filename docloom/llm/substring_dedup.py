"""Removal of token windows that already start in an earlier document.

Every window of ``WINDOW`` words has a Rabin-Karp hash.  Identical windows choose the same least
hash among their runs of ``GRAM`` words, so windows that stand in two different texts are found
through those fewer keys first (see :mod:`sieve`); the windows that may be shared are then counted
in Spark, each with the smallest document it starts in, and the repeated ones of a document are
merged into maximal removal intervals.

Defined cases: a null text and a text of less than a window lose nothing; a row without ``doc_id``
is ordered with no other and loses nothing; rows with equal ``doc_id`` don't remove from each
other; equal words are equal windows whatever white space parts them; columns besides ``doc_id``
and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import sieve, words
from docloom.session import materialise

WINDOW = 13
GRAM = 5

WHOLE_TEXT = -1
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_NONE = np.empty(0, dtype=np.int32)

Batches = Iterator[pa.RecordBatch]


def _window_keys(found: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start words and hashes of all windows, and for each the least hash of its grams."""
    at, hashes = found.window_hashes(WINDOW)
    if len(at) == 0:
        return at, hashes, hashes
    gram_at, grams = found.window_hashes(GRAM)
    by_word = np.full(len(found.hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
    by_word[gram_at] = grams
    least, width, wanted = by_word, 1, WINDOW - GRAM + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return at, hashes, least[at]


def _is_first(rows: pa.RecordBatch, owners: np.ndarray, first: Broadcast) -> np.ndarray:
    """Whether a row may be the one with the least id of its text."""
    return sieve.passes(first.value, sieve.row_keys(owners, rows.column("doc_id")))


def _grams(first: Broadcast) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, found in words.chunks(batch, "text"):
                at, _, keys = _window_keys(found)
                text_of = found.text_of[at]
                owners = words.signed(found.text_hashes())
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (text_of[1:] != text_of[:-1])
                new &= _is_first(rows, owners, first)[text_of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.signed(keys[new])), pa.array(owners[text_of[new]])], names=["key", "owner"]
                )

    return run


def _windows(first: Broadcast, shared: Broadcast) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, found in words.chunks(batch, "text"):
                at, hashes, keys = _window_keys(found)
                owners = words.signed(found.text_hashes())
                hit = sieve.passes(shared.value, keys) & _is_first(rows, owners, first)[found.text_of[at]]
                at, hashes = at[hit], hashes[hit]
                text_of = found.text_of[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(words.signed(hashes)),
                        rows.column("doc_id").take(pa.array(text_of)),
                        pa.array(owners[text_of]),
                        pa.array((at - found.first[text_of]).astype(np.int32)),
                    ],
                    names=["window", "doc_id", "text_hash", "at"],
                )

    return run


def _lengths(batches: Batches) -> Batches:
    for batch in batches:
        for rows, found in words.chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(words.signed(found.text_hashes())),
                    pa.array(found.counts().astype(np.int64)),
                ],
                names=["doc_id", "text_hash", "n_words"],
            )


def _facts(shared: Broadcast) -> Callable[[Batches], Batches]:
    """Per row its word count, and its text where something may be removed, else its digest."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, found in words.chunks(batch, "text"):
                at, _, keys = _window_keys(found)
                touched = np.zeros(rows.num_rows, dtype=bool)
                touched[found.text_of[at[sieve.passes(shared.value, keys)]]] = True
                texts = rows.column("text")
                digests = [None if touched[i] else kept_digest(found, i, None) for i in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(words.signed(found.text_hashes())),
                        pa.array(found.counts().astype(np.int64)),
                        pa.array(digests, type=pa.string()),
                        texts.take(pa.array(np.arange(rows.num_rows), mask=~touched)),
                    ],
                    names=["doc_id", "text_hash", "n_words", "whole_sha256", "text"],
                )

    return run


def kept_digest(found: words.Words, row: int, removed: np.ndarray | None) -> str:
    first, last = found.first[row], found.first[row + 1]
    if first == last:
        return hashlib.sha256(b"").hexdigest()
    own = found.data[found.starts[first] : found.ends[last - 1]].tobytes().split()
    if removed is not None:
        own = [word for word, gone in zip(own, removed, strict=True) if not gone]
    return hashlib.sha256(b" ".join(own)).hexdigest()


def removal_mask(starts: np.ndarray, count: int) -> np.ndarray:
    """Words of a text of ``count`` words that windows at the given starts cover."""
    steps = np.zeros(count + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + WINDOW, count), -1)
    return np.cumsum(steps[:-1]) > 0


def _cut(batches: Batches) -> Batches:
    for batch in batches:
        counts = batch.column("n_words").to_pylist()
        wholes = batch.column("whole_sha256").to_pylist()
        row = 0
        removed, digests, limits = [], [], []
        for rows, found in words.chunks(batch, "text"):
            for i, starts in enumerate(rows.column("starts")):
                at = starts.values.to_numpy() if starts.is_valid else _NONE
                count, whole = counts[row], wholes[row]
                if (at == WHOLE_TEXT).any():
                    removed.append(count)
                    digests.append(EMPTY_SHA256)
                    limits.append([0, count])
                elif whole is not None:
                    removed.append(0)
                    digests.append(whole)
                    limits.append([])
                else:
                    mask = removal_mask(at, count)
                    removed.append(int(mask.sum()))
                    digests.append(kept_digest(found, i, mask))
                    limits.append(np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist())
                row += 1
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_words"),
                pa.array(removed, type=pa.int64()),
                pa.array(digests, type=pa.string()),
                pa.array(limits, type=pa.list_(pa.int32())),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "limits"],
        )


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, limits array<int>"


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Per document its word count, removed words, digest of what stays, and removal limits.

    ``limits`` lists the maximal removal intervals as word numbers: start, end, start, end.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = texts.where("doc_id is not null")
    lengths = materialise(named.mapInArrow(_lengths, "doc_id long, text_hash long, n_words long"), "lengths")
    first = sieve.firsts(lengths, "text_hash")
    shared = sieve.shared_bitmap(named, _grams(first))
    windows = named.mapInArrow(_windows(first, shared), "window long, doc_id long, text_hash long, at int")
    least = (
        windows.groupBy("window")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where(F.col("least") < F.col("most"))
        .select("window", "least")
    )
    repeated = windows.join(least, "window").where(F.col("doc_id") > F.col("least"))
    # All windows of a copy start in the first row of its text too: it goes as a whole, told by its hash.
    long_enough = lengths.where(F.col("n_words") >= WINDOW)
    originals = (
        long_enough.groupBy("text_hash", "n_words")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where(F.col("least") < F.col("most"))
        .select("text_hash", "n_words", "least")
    )
    copies = long_enough.join(originals, ["text_hash", "n_words"]).where(F.col("doc_id") > F.col("least"))
    marks = (
        repeated.select("doc_id", "text_hash", "at")
        .union(copies.select("doc_id", "text_hash", F.lit(WHOLE_TEXT)))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("at").alias("starts"))
    )
    facts = texts.mapInArrow(
        _facts(shared), "doc_id long, text_hash long, n_words long, whole_sha256 string, text string"
    )
    return facts.join(marks, ["doc_id", "text_hash"], "left").mapInArrow(_cut, RESULT)
