"""Unsigned numbers as few bytes, for what tasks send each other in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte of all of them, compressed: small numbers take little."""
    values = np.ascontiguousarray(values, dtype="<u8")
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used and not planes[used - 1].any():
        used -= 1
    parts = [pa.compress(planes[k].tobytes(), codec="zstd", asbytes=True) for k in range(used)]
    return np.array([len(values), used, *map(len, parts)], dtype="<i8").tobytes() + b"".join(parts)


def unpack(data: bytes) -> np.ndarray:
    count, used = np.frombuffer(data, dtype="<i8", count=2).tolist()
    sizes = np.frombuffer(data, dtype="<i8", offset=16, count=used).tolist()
    planes = np.zeros((8, count), dtype=np.uint8)
    at = 16 + 8 * used
    for k, size in enumerate(sizes):
        plane = pa.decompress(data[at : at + size], decompressed_size=count, codec="zstd", asbytes=True)
        planes[k] = np.frombuffer(plane, dtype=np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)
