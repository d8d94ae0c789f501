"""Arrays as binary columns: one fat row for each task and hash bucket, in place of a row for each element."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def planes(x: np.ndarray) -> bytes:
    """The bytes of an integer array, all lowest bytes first: the zero planes of small numbers then shrink to nothing when shuffled."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    n = len(raw) // width
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n)


def pack_owned(ids: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """(ids, keys, counts, places) of elements in order of id, key and place: each owner once, with its count."""
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]))
    counts = np.diff(np.append(new, len(ids))).astype(np.uint32)
    return planes(np.diff(ids[new], prepend=np.int64(0))), keys[new].tobytes(), planes(counts), planes(places)


def unpack_owned(ids: bytes, keys: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = unplanes(counts, np.uint32)
    return np.repeat(np.cumsum(unplanes(ids, np.int64)), n), np.repeat(np.frombuffer(keys, np.int64), n), unplanes(places, np.uint32)


def column(table: pa.Table, name: str) -> list[bytes]:
    return table.column(name).to_pylist()


def cut(bucket: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the runs of equal values 0..n-1 in a sorted array."""
    return np.searchsorted(bucket, np.arange(n + 1))


def xxhash64(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for a column of 64-bit integers, so that tasks and plans deal rows alike."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: v << np.uint64(r) | v >> np.uint64(64 - r)
    h = (np.uint64(42) + p5 + np.uint64(8)) ^ turn(np.ascontiguousarray(x).view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)
