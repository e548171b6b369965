"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=U64)
_MUL = U64(0x9E3779B97F4A7C15)
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 256
#: Bytes of text that are worked on together.
SLICE = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KEEP = bytes(range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of a common generator)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table that is True for bytes inside words."""
    inside = np.ones(256, dtype=bool)
    for a, b in ranges:
        inside[a : b + 1] = False
    return inside


#: Words are runs without ASCII white space.
SPACED = separators([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of lower-case ASCII letters, digits and non-ASCII characters.
ALNUM = separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


class Words:
    """Words of consecutive texts: byte spans, 64-bit hashes, and each text's range of words."""

    def __init__(self, data: bytes, offsets: np.ndarray, inside: np.ndarray, lower: bool = True):
        self.data = data.translate(_LOWER if lower else _KEEP)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        n = len(raw)
        word = np.zeros(n + 2, dtype=bool)
        word[1:-1] = inside[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
        self.ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        size = self.ends - self.starts
        padded = self.data + bytes(16)
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        h = mix((eight[self.starts] & _MASK[np.minimum(size, 8)]) + size.astype(U64) * _MUL)
        todo = np.flatnonzero(size > 8)
        at = 8
        while len(todo) and at < LONG_WORD:
            left = np.minimum(size[todo] - at, 8)
            h[todo] = mix(h[todo] * _MUL + (eight[self.starts[todo] + at] & _MASK[left]))
            at += 8
            todo = todo[size[todo] > at]
        for i in todo:
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]])
        return h

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words, and which start words have k words left in their text."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=bool)
        m = n - k + 1
        h = np.zeros(m, dtype=U64)
        for j in range(k):
            h = h * U64(0xD6E8FEB86659FD93) + self.hashes[j : j + m]
        return mix(h), self.doc[:m] == self.doc[k - 1 :]

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string column with nulls as empty texts."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_string()).fill_null("")


def slices(col: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, row after the last, bytes, byte offsets) of runs of rows of about ``size`` bytes."""
    n = len(col)
    if not n:
        return
    _, where, data = col.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[col.offset : col.offset + n + 1]
    data = memoryview(data) if data is not None else memoryview(b"")
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, n)
        yield first, last, bytes(data[offsets[first] : offsets[last]]), offsets[first : last + 1] - offsets[first]
        first = last
