"""Shared pieces: written tables that cut lineage, and byte-level text helpers.

``materialize`` writes a table to the folder that the cluster names in
``spark.checkpoint.dir`` and reads it back, so a lost executor costs a re-read only.
Where it is unset the session's warehouse folder is taken on one machine, as in
tests; a cluster without it is refused.

The text helpers turn an Arrow string column into one byte buffer, so that a
task handles about a megabyte of text with a few vector operations. All of them
treat null as the empty text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from foliant.sources.scratch import written

#: Bytes of text that are handled at once inside a task.
CHUNK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


#: A table written to the shared folder and read back: lineage ends there.
materialize = written


def fold_ascii(c):
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- bytes ---------------------------------------------------------------


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n + 1 places where texts begin."""
    arr = pc.fill_null(col.cast(pa.large_string()), "").cast(pa.large_binary())
    _, places, data = arr.buffers()
    off = np.frombuffer(places, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if not len(off):
        off = np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@functools.lru_cache(1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        m = max(n, CHUNK + 4096)
        for k, x in enumerate((_MULT, np.uint64(pow(int(_MULT), -1, 2**64)))):
            p = np.full(m, x, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(buf: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """h with (h[j] - h[i]) * inverse power i as the polynomial hash of bytes i..j."""
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((byte_values() if values is None else values)[buf] * powers(len(buf))[0], dtype=np.uint64, out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((h[end] - h[start]) * powers(len(h))[1][start])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@functools.lru_cache(1)
def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses two texts."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = off[:-1][off[:-1] < n]
    start[first] |= inside[first]
    last = off[1:][off[1:] > 0] - 1
    end[last] |= inside[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of non-space bytes."""
    s, e = runs(~_SPACE[buf], off)
    return s, e, np.searchsorted(off[1:], s, "right")


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row in the same text, and their texts."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    same = doc[:n] == doc[k - 1 :]
    return out[same], doc[:n][same]


def strings(col: pa.Array) -> list[str]:
    return pc.fill_null(col.cast(pa.large_string()), "").to_pylist()
