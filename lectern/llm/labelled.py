"""Bounded samples of labelled documents, and a fit by adaptive gradient steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; rows where it is 1 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, where: Column | None = None) -> DataFrame:
    """text and label of at most ``limit`` labelled documents, those of smallest id hash.

    Labels without id or value are left out; of several labels for an id the largest holds,
    of several texts the least. The chosen ids are bounded by ``limit``, so they are
    broadcast to the documents.
    """
    rated = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        rated = rated.where(where)
    one = rated.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


#: Entries of a sparse matrix that are multiplied at once (8 MB).
_CHUNK = 1 << 20


class Sparse:
    """Rows of (feature, value) with products in both directions."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
        self.col = np.concatenate([f for f, _ in rows]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
        self.n, self.width = len(rows), width

    @classmethod
    def of_lists(cls, lists: pa.Array, values: np.ndarray) -> Sparse:
        """Rows of an Arrow array of feature lists, each feature with its value."""
        out = cls([], len(values))
        out.n, out.col = len(lists), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        out.row = np.repeat(np.arange(out.n), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        out.val = values[out.col]
        return out

    def _summed(self, to: np.ndarray, by: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for a in range(0, len(self.val), _CHUNK):
            at = slice(a, a + _CHUNK)
            out += np.bincount(to[at], self.val[at] * x[by[at]], minlength=size)
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._summed(self.row, self.col, w, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._summed(self.col, self.row, g, self.width)


def descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Gradient steps with moment estimates; deterministic."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
