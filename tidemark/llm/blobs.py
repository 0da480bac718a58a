"""Number columns as compressed blobs, so that a shuffle moves a row for many numbers."""

from __future__ import annotations

import pickle
import sys

import numpy as np
import zstandard
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, compressed: first bytes of all numbers, then second ones, and so on."""
    parts = [(a.dtype.str, np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in arrays]
    return zstandard.compress(pickle.dumps(parts), 1)


def unpack(raw: bytes) -> list[np.ndarray]:
    out = []
    for name, data in pickle.loads(zstandard.decompress(raw)):
        kind = np.dtype(name)
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind))
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def add_up(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c
