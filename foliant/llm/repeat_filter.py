"""Two Bloom filters, once-seen and twice-seen, over keys that tasks make.

Filters merge associatively, ``(o1, t1) + (o2, t2) = (o1 | o2, t1 | t2 | o1 & o2)``,
piece by piece, so that no task holds the filters of many. What the merged
twice-seen filter doesn't hold is surely unique. Its size follows the number of
keys up to ``most_bytes``; a fuller filter lets more unique keys through, and the
exact steps behind it sort them out.

``seen`` is the once-seen filter alone, as a condition on a column of hashes: what
it holds goes to an exact join, all else passes in the map.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import mix

#: Bytes of a piece of the filters, the unit of merging.
PIECE = 1 << 13
#: Tasks whose pieces meet in one group at the first of two levels of merging.
FAN_IN = 64


def filter_bits(keys: int, bits_per_key: int = 12, most_bytes: int = 32 << 20) -> int:
    pieces = int(min(most_bytes // PIECE, max(1, keys * bits_per_key // (8 * PIECE))))
    return (1 << (pieces.bit_length() - 1)) * PIECE * 8


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Two places for each key, in one piece of the filter."""
    inner = np.uint64(PIECE * 8 - 1)
    base = (h % np.uint64(bits // (PIECE * 8))) * np.uint64(PIECE * 8)
    return np.stack([base + ((h >> np.uint64(20)) & inner), base + ((h >> np.uint64(42)) & inner)]).astype(np.int64)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at.ravel() >> 3, np.left_shift(1, at.ravel() & 7).astype(np.uint8))


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def maybe_repeated(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return _has(bitmap, _places(keys, len(bitmap) * 8)) if len(keys) else np.zeros(0, bool)


def repeat_filter(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """The twice-seen filter of all keys (64-bit, well mixed) of all rows, of bits / 8 bytes."""

    def fill(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys, n = np.unique(keys_of(batch), return_counts=True)
            if len(keys):
                at = _places(keys, bits)
                _set(twice, at[:, _has(once, at) | (n > 1)])
                _set(once, at)
        part = TaskContext.get().partitionId() // FAN_IN
        full = np.flatnonzero(once.reshape(-1, PIECE).any(1))
        pack = lambda f, r: zlib.compress(f[r * PIECE : (r + 1) * PIECE].tobytes(), 1)
        for lo in range(0, len(full), 512):
            some = full[lo : lo + 512]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(some), pa.int64()), pa.array(some), pa.array([pack(once, r) for r in some], pa.binary()), pa.array([pack(twice, r) for r in some], pa.binary())],
                ["part", "piece", "once", "twice"],
            )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(PIECE, np.uint8), np.zeros(PIECE, np.uint8)
        for o, t in zip(pdf["once"], pdf["twice"]):
            o = np.frombuffer(zlib.decompress(o), np.uint8)
            twice |= np.frombuffer(zlib.decompress(t), np.uint8) | (once & o)
            once |= o
        return pd.DataFrame({"part": [0], "piece": [pdf["piece"].iloc[0]], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})

    shape = "part long, piece long, once binary, twice binary"
    parts = rows.mapInArrow(fill, shape)
    merged = parts.groupBy("part", "piece").applyInPandas(merge, shape).groupBy("piece").applyInPandas(merge, shape)
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.select("piece", "twice").collect():
        out[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(zlib.decompress(r.twice), np.uint8)
    return out


def seen(keys: DataFrame, bits_per_key: int = 12, most_bytes: int = 32 << 20) -> Callable[[Column], Column]:
    """Condition on a long column: true for each of the keys (a table of one long column), seldom for others.

    The filter is broadcast, of ``most_bytes`` at most: a fuller one says yes more often.
    """
    hashes = lambda x: mix(x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    # a key that is there twice in its task is in the twice-seen filter
    bitmap = repeat_filter(keys, lambda batch: np.repeat(hashes(batch.column(0)), 2), filter_bits(keys.count(), bits_per_key, most_bytes))
    shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def holds(c: pa.Array) -> pa.Array:
        return pa.array(maybe_repeated(shared.value, hashes(c)), pa.bool_())

    return holds
