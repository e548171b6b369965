"""A bitmap over hashed 64-bit keys, of fixed size, that tells which rows can't be needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lectern.llm.words import U64

#: Bits of a bitmap by default: 8 MB for every task, whatever the number of keys.
BITS = 26
#: A bitmap made for a counted number of keys has eight bits a key, from 1 MB up to 128 MB.
LEAST_BITS, MOST_BITS = 23, 30
_PART = 1 << 20


def bits_for(n: int) -> int:
    """The binary logarithm of the bits for ``n`` keys: one in eight cells or fewer is set, until the largest size is reached."""
    return min(MOST_BITS, max(LEAST_BITS, (8 * max(n, 1) - 1).bit_length()))


def cells(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    return ((keys.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)


def holds(bitmap: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether each key may be in the set: never False for one that is."""
    cell = cells(keys, bits)
    return ((bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)


def _set(bitmap: np.ndarray, cell: np.ndarray) -> None:
    """Set the bits of ``cell`` in the packed ``bitmap``; equal bytes are joined first."""
    cell = np.unique(cell)
    byte, first = np.unique(cell >> 3, return_index=True)
    if len(byte):
        bitmap[byte] |= np.bitwise_or.reduceat((128 >> (cell & 7)).astype(np.uint8), first)


def bitmap_of(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of a one-column frame of long keys; merged part by part in Spark."""
    part = min(_PART, 1 << bits) // 8

    def collect(batches):
        seen = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for batch in batches:
            _set(seen, cells(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits))
        yield _rows([(i // part, zstandard.compress(seen[i : i + part].tobytes(), 1)) for i in range(0, len(seen), part) if seen[i : i + part].any()])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
                sums[i] = sums[i] | more if i in sums else more
        yield _rows([(i, zstandard.compress(x.tobytes(), 1)) for i, x in sums.items()])

    schema = "part int, bits binary"
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in keys.mapInArrow(collect, schema).repartition("part").mapInArrow(merge, schema).toLocalIterator():
        more = np.frombuffer(zstandard.decompress(bytes(r["bits"])), dtype=np.uint8)
        out[r["part"] * part :][: len(more)] = more
    return out


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "bits"])
