"""Words and hashes of a batch of texts in NumPy, without an object per word.

Texts come as an Arrow string column; its buffers are read as bytes. A word is
a run of bytes that a 256-entry table marks as word bytes, and ends at its
document's end. Hashes are functions of a word's bytes only.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix64 finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Word bytes of [^\x20\x09-\x0D]+.
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Word bytes of letters, digits and everything beyond ASCII.
WORD_BYTES = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


class Texts(NamedTuple):
    data: np.ndarray  # bytes of all texts, one after another
    offsets: np.ndarray  # where each text starts; one more for the end


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # bounds[d]:bounds[d+1] are the words of text d


def texts_of(column: pa.Array, lower: bool = True) -> Texts:
    """The bytes of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return Texts(np.empty(0, np.uint8), np.zeros(1, np.int64))
    whole = column.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8)[offsets[0] : offsets[-1]] if whole else np.empty(0, np.uint8)
    return Texts(LOWER[data] if lower else data, offsets - offsets[0])


def slices(batch: pa.RecordBatch, at: int, most_bytes: int):
    """Parts of a batch whose texts (column number at) hold about most_bytes; one longer text stands alone."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(at).fill_null("")), dtype=np.int64)
    group = np.cumsum(sizes) // most_bytes if len(sizes) else sizes
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def words_of(texts: Texts, table: np.ndarray = NOT_SPACE) -> Words:
    data, offsets = texts
    n = len(data)
    inside = np.empty(n + 1, dtype=bool)
    inside[:n] = table[data]
    inside[n] = False
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    last = np.zeros(n + 1, dtype=bool)
    last[:n] = inside[:n] & (~inside[1:] | first[1:])
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    return Words(s, e, np.searchsorted(s, offsets))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        run = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        run[0] = 1
        held = _powers[name] = np.multiply.accumulate(run)
    return held[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ranges() gets the hash of any byte range."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * _power("up", BASE, len(data)), out=sums[1:])
    return sums


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges start:end."""
    down = _power("down", BASE_INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def hash_words(texts: Texts, words: Words) -> np.ndarray:
    return ranges(prefix_sums(texts.data), words.start, words.end)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words within one text, and the bounds of each text's runs."""
    n = np.diff(bounds)
    each = np.maximum(n - size + 1, 0)
    out_bounds = np.r_[0, np.cumsum(each)]
    at = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], each)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        h = mix(h * BASE + hashes[at + k])
    return h, out_bounds


def sequence_digests(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each text's whole sequence of word hashes."""
    n = np.diff(bounds)
    place = (np.arange(len(hashes)) - np.repeat(bounds[:-1], n) + 1).astype(np.uint64)
    out = []
    for salt in (1, 2):
        step = mix(place * np.uint64(0xA24BAED4963EE407) + np.uint64(salt))
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ step), dtype=np.uint64)]
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64)))
    return out[0], out[1]
