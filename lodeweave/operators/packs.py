"""Counts of pairs of ids in few bytes, and the bucket that an id goes to.

A pair ``(a, b)`` of ids under ``size`` is the number ``a * size + b``. Sorted pairs are kept as gaps, all their first bytes, then all their second
bytes and so on; the higher ones are nearly all zero, which compression leaves out. So a pair costs about two bytes and not a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as their number, the number of their bytes, and these byte by byte, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(pa.decompress(data[9:], n * width, "zstd"), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<i8")


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted numbers as their gaps."""
    return packed(np.diff(keys, prepend=0))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys`` sorted, and how often each is there, or the sums of its ``n``."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    if n is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The partition to which ``repartition(buckets, id)`` sends an int, which is its bucket in a bucketed table as well.

    Packs of one bucket carry one of its ids and are sent by that. Another hash would make more files, but no other rows.
    """
    with np.errstate(over="ignore"):
        k = ids.astype(np.uint32) * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % buckets
