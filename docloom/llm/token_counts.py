"""Token counts of whole texts by a two-tier lookup on the map side.

The first tier is a table of the token counts of frequent pre-tokens, broadcast in a compact form:
one string of all keys and one byte a count, ``TABLE_ENTRIES`` at most (under 2 MB).  The second
is a cache in each worker, into which misses are encoded.  Pre-tokens are never shuffled.  Which
keys the table has changes the speed and nothing else; it is filled from a bounded sample of
``SAMPLE_ROWS`` documents.

A null text is empty: no bytes, no tokens.  Special strings in a text are one token each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import bpe

Batches = Iterator[pa.RecordBatch]

#: Documents, about, that the table of frequent pre-tokens is made from, and its entries.
SAMPLE_ROWS = 1024
TABLE_ENTRIES = 1 << 15
SUMMARIES = 8
SEPARATOR = "\x00"


def _summary(path: str) -> Callable[[Batches], Batches]:
    """The most frequent pre-tokens of one task's part of the sample."""

    def run(batches: Batches) -> Batches:
        known, seen = bpe.vocabulary(path), Counter()
        for batch in batches:
            for text in batch.column("text"):
                for span, special in known.spans(text.as_py() or ""):
                    if special is None:
                        seen.update(p for p in known.pre_tokens.findall(span) if len(p) < bpe.CACHE_BYTES)
            if len(seen) > 8 * TABLE_ENTRIES:
                seen = Counter(dict(seen.most_common(4 * TABLE_ENTRIES)))
        most = [(p, n) for p, n in seen.most_common(TABLE_ENTRIES) if SEPARATOR not in p]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in most], type=pa.string()), pa.array([n for _, n in most], type=pa.int64())],
            names=["piece", "n"],
        )

    return run


def frequent_lengths(documents: DataFrame, path: str) -> Broadcast:
    """The first tier, on all executors: (keys joined, counts)."""
    rows = documents.count()
    sample = documents.select("text").where("text is not null")
    if rows > SAMPLE_ROWS:
        sample = sample.sample(fraction=SAMPLE_ROWS / rows, seed=7)
    seen: Counter = Counter()
    for row in sample.repartition(SUMMARIES).mapInArrow(_summary(path), "piece string, n long").toLocalIterator():
        seen[row.piece] += row.n
    known = bpe.vocabulary(path)
    pieces = [p for p, _ in seen.most_common(TABLE_ENTRIES)]
    lengths = np.array([len(known.encode_piece(p.encode())) for p in pieces], dtype=np.uint8)
    return documents.sparkSession.sparkContext.broadcast((SEPARATOR.join(pieces), lengths.tobytes()))


def _count(path: str, table: Broadcast, limit: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        known = bpe.vocabulary(path)
        cache = length_cache(path, table)
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                n = 0
                for span, special in known.spans(text):
                    n += sum(map(cache.__getitem__, known.pre_tokens.findall(span))) if special is None else 1
                sizes.append(len(text.encode()))
                counts.append(n)
            counts = np.array(counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, type=pa.int64()), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


class Lengths(bpe.Cache):
    """The second tier; when full it goes back to the first."""

    def __init__(self, path: str, pieces: list[str], lengths: bytes):
        known = bpe.vocabulary(path)
        super().__init__(lambda piece: len(known.encode_piece(piece.encode())))
        self.first = dict(zip(pieces, lengths, strict=True))
        self.update(self.first)

    def clear(self) -> None:
        super().clear()
        self.update(self.first)


_caches: dict[tuple[str, int], Lengths] = {}


def length_cache(path: str, table: Broadcast) -> Lengths:
    key = path, hash(table.value[0])
    if key not in _caches:
        _caches.clear()
        joined, lengths = table.value
        _caches[key] = Lengths(path, joined.split(SEPARATOR) if lengths else [], lengths)
    return _caches[key]


def count_tokens(documents: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per document doc_id, n_bytes, n_tokens and whether it has more than ``limit`` tokens."""
    table = frequent_lengths(documents, path)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_count(path, table, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
