"""Words, word windows and their hashes for Arrow batches of texts.

The bytes of many texts are treated at once: word limits come from a byte table, a word's hash
mixes its bytes eight at a time, and the Rabin-Karp hash of a short window of words comes from
differences of prefix sums of those.  A polynomial modulo 2**64 is blind to some long sequences of
two symbols (Thue-Morse), so neither words nor whole texts are hashed that way.  Memory follows
``CHUNK_BYTES`` and the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
WHITE = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint8)

#: Longer words are hashed one by one.
LONG_WORD = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE_WORDS = np.uint64(0xD6E8FEB86659FD93)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_white = np.zeros(256, dtype=bool)
_is_white[WHITE] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, count: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below count."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) < count:
        size = max(count, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        both = []
        for factor in (base, inverse):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        known = _powers[int(base)] = (both[0], both[1])
    return known


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all others."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def prefix_sums(values: np.ndarray, base: np.uint64) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of values[starts:ends]: equal for equal contents wherever they stand."""
    inverse = powers(base, len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """The words of consecutive texts: byte limits, owning text, hash."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_of: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # per text the number of its first word, and one closing entry

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def window_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of all runs of ``size`` words within one text."""
        n = len(self.hashes)
        if n < size:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        at = np.flatnonzero(self.text_of[: n - size + 1] == self.text_of[size - 1 :])
        return at, range_hashes(prefix_sums(self.hashes, _BASE_WORDS), at, at + size, _BASE_WORDS)

    def text_hashes(self) -> np.ndarray:
        """A hash of each text's whole word sequence."""
        limits = zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)
        return np.array([xxhash.xxh3_64_intdigest(self.hashes[a:b].tobytes()) for a, b in limits], dtype=np.uint64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def row_slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES each, at least one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end], of its length and its bytes in pieces of eight."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    pieces = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    lengths = ends - starts
    hashes = mix(lengths.astype(np.uint64) + _STEP)
    at = np.flatnonzero(lengths <= LONG_WORD)
    left, place = lengths[at], starts[at]
    while len(at):
        gone = np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        hashes[at] = mix((hashes[at] ^ (pieces[place] << gone)) * _STEP)
        more = left > 8
        at, left, place = at[more], left[more] - 8, place[more] + 8
    for k in np.flatnonzero(lengths > LONG_WORD):
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return hashes


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Runs of bytes other than ASCII white space; with ``lower``, A-Z is lower-cased first."""
    if lower:
        data = _lower[data]
    inside = ~_is_white[data]
    size = len(data)
    before = np.zeros(size, dtype=bool)
    before[1:] = inside[:-1]
    limits = offsets[(offsets > 0) & (offsets < size)]
    before[limits] = False
    after = np.zeros(size, dtype=bool)
    after[:-1] = inside[1:]
    after[limits - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, starts, ends, text_of, hashes, first)


def chunks(batch: pa.RecordBatch, column: str, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """A batch cut into slices of bounded size, each with its words."""
    data, offsets = buffers(batch.column(column))
    for row, end in row_slices(offsets):
        part = data[offsets[row] : offsets[end]]
        yield batch.slice(row, end - row), split_words(part, offsets[row : end + 1] - offsets[row], lower)


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit values as Spark's signed longs."""
    return values.view(np.int64)
