"""Key hashes and sketch cells in Arrow batches: whole columns at a time, in unsigned 64-bit arithmetic that wraps.

The same numbers as functions.bits gives row by row; for many keys these are the ones to use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.bits import FNV_OFFSET, FNV_PRIME, MIX, SPLIT


def fnv1a64(values: pa.Array) -> np.ndarray:
    """64-bit FNV-1a of each binary; of a null what an empty one gives."""
    values = values.fill_null(b"")
    sizes = np.fromiter(map(len, values.to_pylist()), dtype=np.int64, count=len(values))
    data = np.frombuffer(b"".join(values.to_pylist()), dtype=np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    h = np.full(len(values), FNV_OFFSET, dtype=np.uint64)
    for k in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > k)
        h[at] = (h[at] ^ data[starts[at] + k]) * np.uint64(FNV_PRIME)
    return h


def _finalised(x: np.ndarray, shifts: tuple[int, int, int], by: tuple[int, int]) -> np.ndarray:
    for shift, times in zip(shifts, (*by, 1), strict=True):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(times)
    return x


def split_mix(x: np.ndarray) -> np.ndarray:
    return _finalised(x, (30, 27, 31), SPLIT)


def mix64(x: np.ndarray) -> np.ndarray:
    return _finalised(x, (33, 33, 33), MIX)


def key_hash(key: Column) -> Column:
    """The 64-bit hash of a binary key, as a LONG's bits."""
    @F.arrow_udf("long")
    def of(values: pa.Array) -> pa.Array:
        return pa.array(fnv1a64(values).view(np.int64), mask=np.asarray(values.is_null()))

    return of(key)


def sketch_cells(key: Column, seeds: list[int], columns: int) -> Column:
    """The cells (row, col) of a binary key in a sketch with these seeds, one for each row."""
    @F.arrow_udf("array<struct<row:int,col:int>>")
    def of(values: pa.Array) -> pa.Array:
        h = fnv1a64(values)
        cols = np.stack([split_mix(h ^ np.uint64(seed << 32 | seed)) % np.uint64(columns) for seed in seeds], axis=1).astype(np.int32)
        cells = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(len(seeds), dtype=np.int32), len(h))), pa.array(cols.ravel())], names=["row", "col"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * len(seeds)), cells)

    return of(key)


def hash_buckets(key: Column, buckets: int) -> Column:
    """The bucket (a power of two of them) of a binary key in a hash table, by the finalised hash."""
    @F.arrow_udf("int")
    def of(values: pa.Array) -> pa.Array:
        return pa.array((mix64(fnv1a64(values)) & np.uint64(buckets - 1)).astype(np.int32))

    return of(key)
