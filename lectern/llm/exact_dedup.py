"""Exact deduplication by an extendible-hash index on shared files.

Texts are equal when they are identical after each run of ASCII white space became one
space; a null text is an empty one. Of equal texts the row with the smallest doc_id stays
(a missing id comes after all others; of rows that share that id one stays).

The index has a directory and buckets. The directory maps the leading bits of a text's
64-bit hash to a bucket, which holds the texts of one key range. A bucket of more distinct
keys than ``capacity`` splits by its next bit; where it already uses all bits of the
directory, that doubles. Copies count once, so no group of them can overfill a bucket. Keys
are counted in Spark; the driver sees the counts of at most 2^16 key ranges, and of those
still overfull sixteen more ranges each.

Every row is then sent to the task that owns its bucket, which chains the different texts
of one key: texts of a key that occurs once can have no copy, so only the others travel, one
for each task and different text, compared byte by byte there and again by the owner. The owner sorts its
rows by bucket and key and holds the chain of a single key. What owners write, sorted, with the
directory beside it, is the index, in the shared folder.

An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bitmap import bitmap_of, bits_for, holds
from lectern.llm.groups import join_groups
from lectern.llm.rows import numbered
from lectern.llm.words import U64
from lectern.session import bounded_batches, discard, free_names, materialise

#: Least distinct keys of a bucket before it splits; by default a bucket takes the square root of all keys.
LEAST_CAPACITY = 64
#: Bits by which keys are first counted, and by how many more where a range is still overfull.
FIRST_BITS, MORE_BITS = 16, 4
#: A directory never has more bits; beyond them buckets grow instead.
MOST_BITS = 26
#: Bytes of texts that a task holds to compare copies with, and of a batch it sends.
HELD_BYTES = 16 << 20
_BATCH_BYTES = 4 << 20


def normalised(text: Column | str) -> Column:
    """The text with each run of ASCII white space as one space; empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class Directory:
    """Buckets by the leading bits of a key: ``prefix`` of ``local`` bits each, in key order."""

    def __init__(self):
        self.depth = 0
        self.prefix = np.zeros(1, dtype=np.int64)
        self.local = np.zeros(1, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.prefix)

    def split(self, over: np.ndarray) -> None:
        """Split the buckets marked in ``over`` by their next bit, doubling the directory where they use all its bits."""
        if (self.local[over] == self.depth).any():
            self.depth += 1
        times = np.where(over, 2, 1)
        second = np.zeros(int(times.sum()), dtype=np.int64)
        second[np.cumsum(times)[over] - 1] = 1
        self.local = np.repeat(self.local + over, times)
        self.prefix = np.repeat(self.prefix << over, times) + second

    def slots(self) -> np.ndarray:
        """The bucket of each of the 2^depth slots."""
        return np.repeat(np.arange(len(self), dtype=np.int32), 1 << (self.depth - self.local))

    def ranges(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The first and the next range of ``bits`` leading bits of each bucket."""
        first = self.prefix << (bits - self.local)
        return first, first + (1 << (bits - self.local))


def bucket_of(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    depth = len(slots).bit_length() - 1
    if not depth:
        return np.zeros(len(keys), dtype=np.int32)
    return slots[(keys.astype(np.int64).view(U64) >> U64(64 - depth)).astype(np.int64)]


def directory_of(keys: DataFrame, capacity: int | None = None, first_bits: int = FIRST_BITS) -> Directory:
    """A directory whose buckets hold at most ``capacity`` of the distinct ``keys`` (by default the root of their number)."""
    bits, known, counts = first_bits, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    out, todo = Directory(), keys
    while True:
        rows = todo.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("at")).count().collect()
        known, counts = np.array([r["at"] for r in rows], dtype=np.int64), np.array([r["count"] for r in rows], dtype=np.int64)
        order = np.argsort(known)
        known, before = known[order], np.concatenate([[0], np.cumsum(counts[order])])
        if capacity is None:
            capacity = max(LEAST_CAPACITY, isqrt(int(before[-1])))
        while True:
            first, end = out.ranges(bits)
            size = before[np.searchsorted(known, end)] - before[np.searchsorted(known, first)]
            over = (size > capacity) & (out.local < bits)
            if not over.any():
                break
            out.split(over)
        full = out.prefix[(size > capacity) & (out.local == bits)]
        if not len(full) or bits + MORE_BITS > MOST_BITS:
            return out
        # Ranges that are still overfull: no more of them than all keys hold capacities.
        spark, at = keys.sparkSession, F.shiftrightunsigned("key", 64 - bits)
        overfull = spark.createDataFrame([(int(x),) for x in full], "at long")
        todo = todo.withColumn("at", at).join(overfull, "at", "left_semi").drop("at")
        bits += MORE_BITS


_ENTRY = "bucket int, key long, doc_id long, row long, n long, sha binary, text binary"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _before(a: tuple[int | None, int], b: tuple[int | None, int]) -> bool:
    """Whether row a comes before row b: by id, one without after all others, then by row."""
    return (a[0] is None, a[0] or 0, a[1]) < (b[0] is None, b[0] or 0, b[1])


def entries(texts: DataFrame, slots: np.ndarray, repeated: np.ndarray, bits: int) -> DataFrame:
    """Rows for the owners: one a document, but of texts whose key may repeat one for each task and different text.

    ``texts``: doc_id, row, key, text (normalised). A task compares copies byte by byte with
    the texts that it holds, and sends those on when they pass HELD_BYTES.
    """

    def rows_of(held: dict) -> list[tuple]:
        return [(b, key, doc_id, row, n, sha, text) for sha, (b, key, doc_id, row, n, text) in held.items()]

    def pack(batches):
        held, size = {}, 0
        for batch in batches:
            ids, rows, keys = (batch.column(i) for i in range(3))
            numbers = keys.to_numpy(zero_copy_only=False)
            bucket, may_repeat = bucket_of(slots, numbers), holds(repeated, numbers, bits)
            ids, rows, keys, raw = ids.to_pylist(), rows.to_pylist(), keys.to_pylist(), batch.column(3).cast(pa.large_binary())
            out = []
            for i, again in enumerate(may_repeat.tolist()):
                text = raw[i].as_py()
                sha = hashlib.sha256(text).digest()
                if not again:
                    out.append((bucket[i], keys[i], ids[i], rows[i], 1, sha, None))
                    continue
                if (known := held.get(sha)) is None:
                    held[sha] = [bucket[i], keys[i], ids[i], rows[i], 1, text]
                    size += len(text) + 200
                elif known[5] != text:
                    raise ValueError("two texts share a SHA-256")
                else:
                    known[4] += 1
                    if _before((ids[i], rows[i]), (known[2], known[3])):
                        known[2:4] = ids[i], rows[i]
                if size > HELD_BYTES:
                    yield from _bounded(rows_of(held))
                    held, size = {}, 0
            yield from _bounded(out)
        yield from _bounded(rows_of(held))

    def _bounded(rows):
        first, size = 0, 0
        for i, r in enumerate(rows):
            size += 100 + len(r[6] or b"")
            if size > _BATCH_BYTES or i == len(rows) - 1:
                yield _batch(_ENTRY, list(zip(*rows[first : i + 1], strict=True)))
                first, size = i + 1, 0

    return texts.mapInArrow(pack, _ENTRY)


_OWNED = "bucket int, key long, chain int, sha binary, keep_id long, keep_row long, group_size long"


def chains(entries_: DataFrame) -> DataFrame:
    """The entries of each bucket, in the task that owns it: one row for each different text, numbered within its key."""

    def own(batches):
        key, chain, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (row[0], row[1]) != key:
                    out += _linked(key, chain)
                    key, chain = (row[0], row[1]), []
                same = next((c for c in chain if c[4] == row[6]), None)
                if same is None:
                    chain.append([*row[2:7]])
                else:
                    same[2] += row[4]
                    if _before((row[2], row[3]), (same[0], same[1])):
                        same[0:2] = row[2], row[3]
            if out:
                yield _batch(_OWNED, list(zip(*out, strict=True)))
                out = []
        if out := _linked(key, chain):
            yield _batch(_OWNED, list(zip(*out, strict=True)))

    def _linked(key, chain):
        return [(*key, i, sha, doc_id, row, n) for i, (doc_id, row, n, sha, _) in enumerate(sorted(chain, key=lambda c: c[3]))]

    return entries_.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(own, _OWNED)


def index(texts: DataFrame, keys: DataFrame, capacity: int | None = None) -> tuple[DataFrame, Directory]:
    """The written index of ``texts`` (doc_id, row, key, text), whose ``keys`` (key, count) are counted, and its directory."""
    directory = directory_of(keys, capacity)
    again = keys.where("count > 1").select("key")
    bits = bits_for(again.count())
    return materialise(chains(entries(texts, directory.slots(), bitmap_of(again, bits), bits))), directory


def copies(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``."""
    out, _ = _judged(docs, capacity)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that copies() says stay."""
    judged, (rows, own) = _judged(docs, capacity)
    (gone,) = free_names(rows.columns, "_gone")
    dropped = judged.where("not kept").select((F.col("row") if own else F.col("doc_id")).alias(gone))
    return rows.join(dropped, rows[own or "doc_id"].cast("long") == F.col(gone), "left_anti").drop(*([own] if own else []))


def _judged(docs: DataFrame, capacity: int | None) -> tuple[DataFrame, tuple[DataFrame, str | None]]:
    bounded_batches(docs.sparkSession)
    own = numbered(docs, nulls=True)
    rows, row = own if own else (docs, None)
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(row) if row else F.lit(0)).cast("long").alias("row"), normalised("text").alias("text"))
    texts = texts.select("doc_id", "row", F.xxhash64("text").alias("key"), "text")
    digests = materialise(texts.select("doc_id", "row", "key", F.unhex(F.sha2("text", 256)).alias("sha")))
    keys = materialise(digests.groupBy("key").count())
    entries_, _ = index(texts, keys, capacity)
    discard(keys)
    found = join_groups(digests, entries_.drop("bucket", "chain"), ["key", "sha"], "group_size")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    return found.select("doc_id", "row", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")), (rows, row)
