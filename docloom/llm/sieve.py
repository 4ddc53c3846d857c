"""Which keys have several owners, as a bitmap of bounded size.

A pass over all texts gives (key, owner) pairs.  Each task adds them up in slices and sends every
distinct key of a slice once, in blocks of sorted keys: most of a key's bytes are those of the key
before it.  Keys with at least two owners set one bit each in a map of about as many bits as keys, at
least 8 MB and at most 64 MB whatever the input.  A second pass lets through keys whose bit is set, so every shared key passes; the few
others that pass cost time only, since the exact step after it looks at the keys themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from docloom.llm.words import mix

Batches = Iterator[pa.RecordBatch]

LEAST_BITS, MOST_BITS = 26, 29
SEGMENT_BITS = 13
#: Pairs that a task adds up before it sends them.
SLICE_KEYS = 1 << 21
#: Keys that a bucket is expected to get at most, of texts with a key in so many bytes.
BUCKET_KEYS = 1 << 20
BYTES_A_KEY = 6
LEAST_BUCKET_BITS = 4
#: Stands for a missing id.
NO_ID = -(2**63)



def _blocks(rows: Callable[[Batches], Batches], bucket_bits: int) -> Callable[[Batches], Batches]:
    """Slices of (key, owner) pairs as sorted distinct keys, by the leading bits of the key."""

    def block(keys: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.append(starts, len(keys)))
        several = np.logical_or.reduceat(owners != np.repeat(owners[starts], counts), starts)
        keys = keys[starts]
        bucket = keys >> np.uint64(64 - bucket_bits)
        limits = np.append(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(keys))
        parts = list(zip(limits[:-1], limits[1:], strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[limits[:-1]].astype(np.int32)),
                pa.array([pack_sorted(keys[a:b]) for a, b in parts], pa.binary()),
                pa.array([pack(np.flatnonzero(several[a:b])) for a, b in parts], pa.binary()),
            ],
            names=["bucket", "keys", "several"],
        )

    def run(batches: Batches) -> Batches:
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = 0
        for batch in rows(batches):
            keys.append(batch.column("key").to_numpy().view(np.uint64))
            owners.append(batch.column("owner").to_numpy())
            size += len(keys[-1])
            if size >= SLICE_KEYS:
                yield block(np.concatenate(keys), np.concatenate(owners))
                keys, owners, size = [], [], 0
        if size:
            yield block(np.concatenate(keys), np.concatenate(owners))

    return run


def map_bits(keys: int) -> int:
    """Bits of a map, as a power of two, for so many keys."""
    return min(max(keys.bit_length(), LEAST_BITS), MOST_BITS)


def _mark(bits: int, bucket_bits: int) -> Callable[[pa.Table], pa.Table]:
    """The part of the map that a bucket's shared keys set."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        several = [k[unpack(x.as_py()).astype(np.int64)] for k, x in zip(keys, table.column("several"), strict=True)]
        every = np.sort(np.concatenate(keys))
        shared = np.concatenate([*several, every[1:][every[1:] == every[:-1]]])
        slots = (shared >> np.uint64(64 - bits)).astype(np.int64)
        part = np.zeros(1 << (bits - bucket_bits), dtype=bool)
        part[slots - (bucket << (bits - bucket_bits))] = True
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})

    return run


def shared_bitmap(texts: DataFrame, rows: Callable[[Batches], Batches]) -> Broadcast:
    """The bitmap of the keys with several owners among the (key, owner) batches of texts.

    A key that two slices have counts as shared: texts with one owner are to come once, as far as
    :func:`firsts` can tell, else their keys pass too.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = map_bits(size // BYTES_A_KEY)
    bucket_bits = min(max((size // (BYTES_A_KEY * BUCKET_KEYS)).bit_length(), LEAST_BUCKET_BITS), bits - 3)
    blocks = texts.mapInArrow(_blocks(rows, bucket_bits), "bucket int, keys binary, several binary")
    marked = blocks.groupBy("bucket").applyInArrow(_mark(bits, bucket_bits), "bucket int, bits binary")
    whole = np.zeros((1 << bits) // 8, dtype=np.uint8)
    width = len(whole) >> bucket_bits
    for row in marked.toLocalIterator():
        whole[row.bucket * width : (row.bucket + 1) * width] = np.frombuffer(row.bits, dtype=np.uint8)
    return texts.sparkSession.sparkContext.broadcast(whole)


def shared_keys(pairs: DataFrame) -> DataFrame:
    """Keys of (key, owner) rows with more than one owner."""
    return (
        pairs.groupBy("key")
        .agg(F.min("owner").alias("least"), F.max("owner").alias("most"))
        .where(F.col("least") < F.col("most"))
        .select("key")
    )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maps: dict[int, np.ndarray] = {}
    for batch in batches:
        slots = np.unique(batch.column("slot").to_numpy())
        for segment in np.unique(slots >> SEGMENT_BITS):
            bits = maps.setdefault(int(segment), np.zeros(1 << SEGMENT_BITS, dtype=bool))
            own = slots[(slots >> SEGMENT_BITS) == segment] if len(slots) < 64 else slots[
                np.searchsorted(slots, segment << SEGMENT_BITS) : np.searchsorted(slots, (segment + 1) << SEGMENT_BITS)
            ]
            bits[own & ((1 << SEGMENT_BITS) - 1)] = True
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(maps), type=pa.int64()),
            pa.array([np.packbits(bits).tobytes() for bits in maps.values()], type=pa.binary()),
        ],
        names=["segment", "bits"],
    )


def bitmap(keys: DataFrame, count: int = 0) -> Broadcast:
    """The bitmap of the given keys, about ``count`` of them, on all executors."""
    bits = map_bits(8 * count)
    slots = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("slot"))
    segments = slots.repartition(F.shiftright("slot", SEGMENT_BITS)).mapInArrow(_segments, "segment long, bits binary")
    whole = np.zeros((1 << bits) // 8, dtype=np.uint8)
    width = (1 << SEGMENT_BITS) // 8
    for row in segments.toLocalIterator():
        whole[row.segment * width : (row.segment + 1) * width] = np.frombuffer(row.bits, dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)


def row_keys(names: np.ndarray, ids: pa.Array) -> np.ndarray:
    """A key for each row's name (of its contents) and id."""
    numbers = ids.fill_null(NO_ID).to_numpy().view(np.uint64)
    return mix(names.view(np.uint64) ^ mix(numbers))


def _row_keys(batches: Batches) -> Batches:
    for batch in batches:
        keys = row_keys(batch.column("name").to_numpy(), batch.column("least"))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])


def firsts(rows: DataFrame, name: str) -> Broadcast:
    """The bitmap of the rows with the least ``doc_id`` of each name; a few others may pass.

    What passes is one row of equal ones in nearly all cases, and never none.
    """
    least = rows.groupBy(F.col(name).alias("name")).agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"))
    return bitmap(least.mapInArrow(_row_keys, "key long"), rows.count())


def passes(whole: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For unsigned keys, whether their bit is set."""
    slots = keys >> np.uint64(65 - (8 * len(whole)).bit_length())
    bits = whole[(slots >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slots & np.uint64(7)).astype(np.uint8))
    return (bits & 1).astype(bool)
