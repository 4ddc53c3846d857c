"""Benchmark passages in documents, by Wu-Manber multi-pattern search.

A pattern is a window of 13 consecutive words of a benchmark item, written with single spaces; an
item of fewer words is one pattern.  Patterns of similar length form a class.  In a class, the
table of shifts tells for each block of bytes how far the search may jump; blocks that end a
pattern's first part lead to the bucket of the patterns with that suffix, and a direct comparison
confirms an occurrence.

The tables are made from a slice of items whose size is checked (``SLICE_BYTES``) and broadcast;
a larger benchmark is searched slice by slice over the same documents and the hits are merged.

Defined cases: null and empty texts have no words and no hits; items without words or without an
id are no patterns; equal windows of several items count for each of them; equal rows of
documents are judged each by itself, also with equal ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]

WINDOW = 13
#: Bytes of benchmark text whose tables are in memory at once.
SLICE_BYTES = 4 << 20
#: Lower-cases A-Z and turns what parts words into spaces; bytes of other letters stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class Class:
    """Shift table and suffix buckets for patterns of at least ``least`` bytes."""

    def __init__(self, patterns: list[bytes]):
        self.least = min(map(len, patterns))
        self.block = max(1, min(12, self.least // 3))
        self.default = self.least - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[bytes]] = {}
        for pattern in patterns:
            for end in range(self.block, self.least + 1):
                piece = pattern[end - self.block : end]
                jump = self.least - end
                if jump < self.shift.get(piece, self.default):
                    self.shift[piece] = jump
            self.buckets.setdefault(pattern[self.least - self.block : self.least], []).append(pattern)

    def occurrences(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of all occurrences, in order of their starts."""
        least, block, default, shift = self.least, self.block, self.default, self.shift
        at, size, jump = least, len(text), shift.get
        while at <= size:
            step = jump(text[at - block : at], default)
            if step:
                at += step
                continue
            start = at - least
            for pattern in self.buckets[text[at - block : at]]:
                if text.startswith(pattern, start):
                    yield start, pattern
            at += 1


class Patterns:
    """All windows of a slice of items: which items have each, and the classes to search."""

    def __init__(self, items: Iterable[tuple[int, str]]):
        self.items: dict[bytes, set[int]] = {}
        self.sizes: dict[bytes, int] = {}
        for item, text in items:
            found = normal_words(text)
            size = min(WINDOW, len(found))
            for start in range(len(found) - size + 1 if found else 0):
                pattern = b" " + b" ".join(found[start : start + size]) + b" "
                self.items.setdefault(pattern, set()).add(item)
                self.sizes[pattern] = size
        by_length: dict[int, list[bytes]] = {}
        for pattern in self.items:
            by_length.setdefault(min(len(pattern), 64).bit_length(), []).append(pattern)
        self.classes = [Class(patterns) for patterns in by_length.values()]

    def search(self, found: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Marks of the words hit in a text, and the items whose windows occur."""
        hit, items = np.zeros(len(found) + 1, dtype=np.int64), set()
        text = b" " + b" ".join(found) + b" "
        for group in self.classes:
            word, counted = 0, 0
            for start, pattern in group.occurrences(text):
                word += text.count(b" ", counted, start)
                counted = start
                hit[word] += 1
                hit[word + self.sizes[pattern]] -= 1
                items |= self.items[pattern]
        return np.cumsum(hit[:-1]) > 0, items


_tables: dict[str, Patterns] = {}


def _patterns(name: str, items: Broadcast) -> Patterns:
    if name not in _tables:
        if len(_tables) >= 4:
            _tables.clear()
        _tables[name] = Patterns(items.value)
    return _tables[name]


def _search(slices: list[tuple[str, Broadcast]], column: str) -> Callable[[Batches], Batches]:
    """Appends n_words, n_hit and items to the rows."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [normal_words(x.as_py()) for x in batch.column(column)] if len(slices) > 1 else None
            state: list[tuple[np.ndarray, set[int]]] = []
            for number, (name, items) in enumerate(slices):
                patterns = _patterns(name, items)
                for i in range(batch.num_rows):
                    own = texts[i] if texts is not None else normal_words(batch.column(column)[i].as_py())
                    hit, names = patterns.search(own)
                    if number:
                        hit, names = hit | state[i][0], names | state[i][1]
                        state[i] = hit, names
                    else:
                        state.append((hit, names))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([len(hit) for hit, _ in state], type=pa.int64()),
                    pa.array([int(hit.sum()) for hit, _ in state], type=pa.int64()),
                    pa.array([sorted(names) for _, names in state], type=pa.list_(pa.int64())),
                ],
                names=[*batch.schema.names, "n_words", "n_hit", "items"],
            )

    return run


def item_slices(benchmark: DataFrame) -> list[tuple[str, Broadcast]]:
    """The benchmark items on all executors, in slices of bounded size; one empty slice at least."""
    context = benchmark.sparkSession.sparkContext
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "item_id is not null and text is not null"
    )
    slices, held, size = [], [], 0
    for row in named.toLocalIterator():
        held.append((row.item_id, row.text))
        size += len(row.text)
        if size > SLICE_BYTES:
            slices.append((uuid.uuid4().hex, context.broadcast(held)))
            held, size = [], 0
    if held or not slices:
        slices.append((uuid.uuid4().hex, context.broadcast(held)))
    return slices


def find_passages(documents: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """All columns of documents, and n_words, n_hit, and the sorted ids of the items that occur.

    Columns of these three names are replaced.
    """
    documents = documents.drop("n_words", "n_hit", "items")
    schema = documents.select(
        "*",
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<long>").alias("items"),
    ).schema
    return documents.mapInArrow(_search(item_slices(benchmark), column), schema)


def contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def judge(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document the counts, the digest of the items' ids and the verdict."""
    found = find_passages(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
