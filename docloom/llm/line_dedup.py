"""Removal of lines that equal, or are within one edit of, an earlier line of the corpus.

Deletion neighbourhoods: two lines are within one edit (a character put in, taken out or replaced)
exactly when deleting one character at the same place of both, or one character of the longer
line, makes them equal.  Long lines would have as many variants as characters, so the
neighbourhood is taken in two steps.

1. One edit leaves one half of a line as it is.  Hashes of the halves that occur in two different
   lines are found in Spark (see :mod:`sieve`); few lines have any.
2. For those, all variants with one character less in the other half are emitted as hashed keys.
   Equal keys join a line with the earliest line of the key, by aggregation, never all pairs.
   The edit distance of each pair found is then verified on the texts.

Lines are compared as they stand but for white space at both ends.  Order is by (doc_id, line
number).  A line goes when an earlier line equals it, or, from ``LEAST_NEAR`` characters on, when
an earlier line is within one edit, whether or not that one stays.

Defined cases: blank lines stay; null and empty texts have no lines; rows without ``doc_id`` come
last; rows with equal ``doc_id`` are ordered by a hash of their texts, and equal rows are one row
repeated, so they keep the same lines; a document that had words and has none left is marked as
emptied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import sieve, words
from docloom.session import materialise

Batches = Iterator[pa.RecordBatch]

#: Shorter lines go only when they are equal to an earlier one.
LEAST_NEAR = 20

_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_STRIP = np.array([*range(9, 14), 32], dtype=np.uint32)


class Lines:
    """The non-blank lines of a slice of texts as code points, with hashes of any of their ranges."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n" if texts else ""
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        breaks = np.flatnonzero(self.points == 10)
        starts = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else np.empty(0, dtype=np.int64)
        lines_of = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
        text_of = np.repeat(np.arange(len(texts)), lines_of)
        number = np.arange(len(breaks)) - np.repeat(np.cumsum(lines_of) - lines_of, lines_of)
        # White space at both ends does not count: the first and last other characters are the limits.
        solid = np.flatnonzero(~np.isin(self.points, _STRIP))
        first, last = np.searchsorted(solid, starts), np.searchsorted(solid, breaks)
        has = first < last
        self.starts, self.ends = solid[first[has]], solid[last[has] - 1] + 1
        self.text_of, self.number = text_of[has], number[has]
        values = words.mix(self.points.astype(np.uint64) + np.uint64(0x1000))
        self.sums = words.prefix_sums(values, _BASE)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
        return words.mix(words.range_hashes(self.sums, starts, ends, _BASE) ^ np.asarray(tag).astype(np.uint64))

    def names(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends, 0)

    def halves(self) -> np.ndarray:
        """Four keys a line: either half, as the shorter and as the longer line of a pair."""
        size = self.ends - self.starts
        keys = np.empty((len(size), 4), dtype=np.uint64)
        for k, shorter in enumerate((size, size - 1)):
            left = shorter // 2
            tag = (shorter.astype(np.uint64) + np.uint64(1)) << np.uint64(1)
            keys[:, 2 * k] = self.hashes(self.starts, self.starts + left, tag)
            keys[:, 2 * k + 1] = self.hashes(self.ends - (shorter - left), self.ends, tag + np.uint64(1))
        return keys


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    _, offsets = words.buffers(batch.column("text"))
    for row, end in words.row_slices(offsets):
        rows = batch.slice(row, end - row)
        yield rows, Lines([t or "" for t in rows.column("text").to_pylist()])


_POSITION = "doc_id long, text_hash long, line int"


def _own(rows: pa.RecordBatch, found: Lines, pick: np.ndarray) -> list[pa.Array]:
    text_of = pa.array(found.text_of[pick])
    return [
        rows.column("doc_id").take(text_of),
        rows.column("text_hash").take(text_of),
        pa.array(found.number[pick].astype(np.int32)),
    ]


def _names(batches: Batches) -> Batches:
    for batch in batches:
        for rows, found in _slices(batch):
            everything = np.arange(len(found.starts))
            yield pa.RecordBatch.from_arrays(
                [*_own(rows, found, everything), pa.array(words.signed(found.names()))],
                names=["doc_id", "text_hash", "line", "name"],
            )


def _half_keys(batches: Batches) -> Batches:
    for batch in batches:
        for _, found in _slices(batch):
            near = found.ends - found.starts >= LEAST_NEAR
            names, keys = found.names()[near], found.halves()[near]
            _, first = np.unique(names, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.signed(keys[first].ravel())), pa.array(words.signed(np.repeat(names[first], 4)))],
                names=["key", "owner"],
            )


def _near_candidates(shared: Broadcast) -> Callable[[Batches], Batches]:
    """Lines with a shared half, their texts and which of the four halves are shared."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, found in _slices(batch):
                keys = found.halves()
                hit = sieve.passes(shared.value, keys.ravel()).reshape(keys.shape)
                pick = np.flatnonzero(hit.any(axis=1) & (found.ends - found.starts >= LEAST_NEAR))
                texts = [
                    found.points[s:e].tobytes().decode("utf-32-le", "surrogatepass")
                    for s, e in zip(found.starts[pick], found.ends[pick], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *_own(rows, found, pick),
                        pa.array(words.signed(found.names()[pick])),
                        pa.array(np.packbits(hit[pick], axis=1, bitorder="little")[:, 0].astype(np.int32)),
                        pa.array(texts, type=pa.string()),
                    ],
                    names=["doc_id", "text_hash", "line", "name", "halves", "body"],
                )

    return run


WHOLE, LONGER, REPLACED = 0, 1, 2


def variants(body: str, halves: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys of a line's deletion neighbourhood, for those of its halves that are shared.

    Each key has a role.  ``WHOLE``: the line itself, as the shorter of a pair.  ``LONGER``: the
    line without the character at each place, which pairs with a whole line.  ``REPLACED``: the
    same with the place, which pairs with its like.  Places lie in the half that may differ.
    """
    points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sums = words.prefix_sums(words.mix(points.astype(np.uint64) + np.uint64(0x1000)), _BASE)
    size, found = len(points), {WHOLE: [], LONGER: [], REPLACED: []}

    def without(places: np.ndarray) -> np.ndarray:
        # What follows the place moves one to the left.
        inverse = words.powers(_BASE, 2)[1][1]
        return words.mix(sums[places] + (sums[size] - sums[places + 1]) * inverse + np.uint64(size - 1))

    own = words.mix(sums[size : size + 1] + np.uint64(size))
    for k, shorter in enumerate((size, size - 1)):
        left = shorter // 2
        for side in (0, 1):
            if not halves >> (2 * k + side) & 1:
                continue
            # With the left half shared the difference is on the right, and the other way round.
            low, high = (left, size) if side == 0 else (0, size - (shorter - left))
            places = np.arange(low, high)
            if k == 0:
                found[WHOLE].append(own)
                found[REPLACED].append(words.mix(without(places) ^ words.mix(places.astype(np.uint64) + np.uint64(1))))
            else:
                found[LONGER].append(without(places))
    once = {role: np.unique(np.concatenate(keys)) for role, keys in found.items() if keys}
    if not once:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32)
    roles = np.repeat(np.array(list(once), dtype=np.int32), [len(keys) for keys in once.values()])
    return np.concatenate(list(once.values())), roles


def _variant_rows(batches: Batches) -> Batches:
    for batch in batches:
        for row in range(0, batch.num_rows, 64):
            rows = batch.slice(row, 64)
            found = [
                variants(body, halves)
                for body, halves in zip(rows.column("body").to_pylist(), rows.column("halves").to_pylist(), strict=True)
            ]
            keys, roles = (np.concatenate(part) for part in zip(*found, strict=True))
            at = pa.array(np.repeat(np.arange(len(found)), [len(k) for k, _ in found]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(words.signed(keys)),
                    pa.array(roles),
                    rows.column("name").take(at),
                    rows.column("first").take(at),
                ],
                names=["key", "role", "name", "first"],
            )


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "line")


def near_lines(texts: DataFrame) -> DataFrame:
    """Names of the lines that have an earlier line within one edit."""
    shared = sieve.bitmap(sieve.shared_keys(texts.mapInArrow(_half_keys, "key long, owner long")))
    candidates = materialise(
        texts.mapInArrow(_near_candidates(shared), f"{_POSITION}, name long, halves int, body string")
        .groupBy("name")
        .agg(F.min(_place()).alias("first"), F.max("halves").alias("halves"), F.max("body").alias("body")),
        "lines",
    )
    first = candidates.schema["first"].dataType.simpleString()
    keys = candidates.select("name", "halves", "body", "first").mapInArrow(
        _variant_rows, f"key long, role int, name long, first {first}"
    )
    line = F.struct("first", "name")
    earliest = (
        keys.groupBy("key")
        .agg(
            *[F.min(F.when(F.col("role") == role, line)).alias(f"least_{role}") for role in (WHOLE, LONGER, REPLACED)],
            F.min("first").alias("least"),
            F.max("first").alias("most"),
        )
        .where(F.col("least") < F.col("most"))
        .drop("least", "most")
    )
    # Two lines that are longer than one and the same are no pair: a line meets the other role only.
    other = (
        F.when(F.col("role") == WHOLE, F.col(f"least_{LONGER}"))
        .when(F.col("role") == LONGER, F.col(f"least_{WHOLE}"))
        .otherwise(F.col(f"least_{REPLACED}"))
    )
    # Spark sizes the variants by the few lines they come from, and the texts by their compressed files: it
    # would broadcast them, many times its own bound.
    pairs = (
        keys.join(earliest.hint("merge"), "key")
        .withColumn("other", other)
        .where(F.col("other.first") < F.col("first"))
        .select("name", F.col("other.name").alias("partner"))
        .distinct()
    )
    bodies = candidates.select("name", "body").hint("merge")
    verified = (
        pairs.join(bodies, "name")
        .join(bodies.select(F.col("name").alias("partner"), F.col("body").alias("partner_body")), "partner")
        .where(F.levenshtein("body", "partner_body", 1) >= 0)
    )
    return verified.select("name").distinct()


def kept_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kept): per distinct row the numbers of its non-blank lines that stay."""
    texts = keyed(documents).select("doc_id", "text_hash", "text")
    first = (
        texts.mapInArrow(_names, f"{_POSITION}, name long")
        .groupBy("name")
        .agg(F.min(_place()).alias("first"))
        .join(near_lines(texts), "name", "left_anti")
    )
    return first.groupBy("first.doc_id", "first.text_hash").agg(F.collect_list("first.line").alias("kept"))


def keyed(documents: DataFrame) -> DataFrame:
    """Adds what a row is known by: its id as a long and a hash of its text."""
    return documents.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn(
        "text_hash", F.xxhash64("text")
    )


def _pack(batches: Batches) -> Batches:
    """Texts as bytes: eight of their length, then the text compressed on its own."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        packed = []
        for text in batch.column(at):
            own = text.as_buffer()
            packed.append(None if own is None else own.size.to_bytes(8, "little") + codec.compress(own, asbytes=True))
        yield batch.set_column(at, "text", pa.array(packed, type=pa.binary()))


def _unpacked(codec: pa.Codec, packed: bytes | None) -> str | None:
    if packed is None:
        return None
    return codec.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True).decode("utf-8", "surrogatepass")


def packed_texts(rows: DataFrame) -> DataFrame:
    """The rows with ``text`` packed, for a shuffle of whole texts: two thirds of what Spark's own blocks take."""
    fields = [T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in rows.schema]
    return rows.mapInArrow(_pack, T.StructType(fields))


def _drop(output: list[str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        codec = pa.Codec("zstd")
        for batch in batches:
            texts, totals, removed, emptied = [], [], [], []
            for text, kept in zip(batch.column("text"), batch.column("kept"), strict=True):
                text = _unpacked(codec, text.as_py())
                stay = set(kept.as_py() or ())
                lines = (text or "").split("\n")
                solid = [bool(line.strip(" \t\n\v\f\r")) for line in lines]
                left = [line for i, line in enumerate(lines) if not solid[i] or i in stay]
                total = sum(solid)
                texts.append("\n".join(left) if text is not None else None)
                totals.append(total)
                removed.append(total - len(stay))
                emptied.append(total > 0 and not stay)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(texts, type=pa.string()) if name == "text" else batch.column(name)
                    for name in output
                ]
                + [
                    pa.array(totals, type=pa.int64()),
                    pa.array(removed, type=pa.int64()),
                    pa.array(emptied, type=pa.bool_()),
                ],
                names=[*output, "n_lines", "n_removed_lines", "emptied"],
            )

    return run


def drop_lines(documents: DataFrame) -> DataFrame:
    """All columns with ``text`` cut to the lines that stay, and n_lines, n_removed_lines, emptied.

    Columns of these names, and of the names text_hash and kept, are replaced.
    """
    documents = documents.drop("text_hash", "kept", "n_lines", "n_removed_lines", "emptied")
    names = documents.columns
    kept = kept_lines(documents)
    rows = keyed(documents)
    packed = packed_texts(rows)
    joined = packed.join(
        kept.withColumnRenamed("doc_id", "kept_doc_id").withColumnRenamed("text_hash", "kept_text_hash").hint("merge"),
        F.col("text_hash").eqNullSafe(F.col("kept_text_hash")) & F.col("doc_id").eqNullSafe(F.col("kept_doc_id")),
        "left",
    ).select(*[packed[name] for name in names], "kept")
    schema = rows.select(*names, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed_lines"), F.lit(True).alias("emptied")).schema
    return joined.mapInArrow(_drop(names), schema)
