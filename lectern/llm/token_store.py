"""Token ids on disk: one zstandard frame per document, a trailing seek table, checksums.

A file holds, in ascending doc_id order, an independent zstandard frame per document (its
ids as little-endian unsigned 32-bit integers), a skippable frame with the doc_ids, and
the public seekable-zstandard seek table as last skippable frame: compressed size, size
and checksum (low 32 bits of xxh64 of the content) of every frame. The doc_ids end with a
checksum of themselves and of the seek table, so any damaged byte is noticed. Any
zstandard tool can decompress a file; a reader that wants some documents reads the table
and decompresses only their frames.

A store is a folder with such files and a Parquet manifest of them (order, name, range of
ids, documents, tokens). Tasks write under names of their own and the manifest lists the
files of the attempts that Spark committed, so retried tasks do no harm.

Null texts count as empty, and each document gets the end id. A null doc_id is stored as
the least integer and read back as null; repeated ids keep a frame each, ordered by text.
An empty table gives a manifest without rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.encoder import shared_encoder
from lectern.llm.words import slices, text_column
from lectern.session import bounded_batches, fresh_path, until_exit

# Fixed values of the seekable format.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80

NO_ID = -(1 << 63)
#: Parts of the id line in which wanted ids look for their files.
ID_SLOTS = 256

_MANIFEST = "part int, file string, min_id long, max_id long, n_docs long, n_tokens long"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes frames one after the other; keeps 24 bytes a document until close()."""

    def __init__(self, path: str, level: int = 3):
        self.fs, self.path = _open(path)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.table = array("I")  # compressed size, size, checksum of each frame
        self.ids = array("q")

    def add(self, doc_id: int, content: bytes) -> None:
        frame = self.zip.compress(content)
        self.out.write(frame)
        self.table.extend((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        table = np.frombuffer(self.table, dtype=np.uint32).astype("<u4").tobytes()
        ids = zstandard.compress(np.frombuffer(self.ids, dtype=np.int64).astype("<i8").tobytes())
        frame = struct.pack("<II", SKIPPABLE_IDS, len(ids) + 8) + ids
        frame += struct.pack("<Q", xxhash.xxh64_intdigest(frame + table))
        self.out.write(frame)
        last = struct.pack("<III", len(frame), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        body = table + last + struct.pack("<IBI", len(self.ids) + 1, CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)
        self.out.close()


class FrameReader:
    """Reads the table first and then single frames, each checked against its checksum."""

    def __init__(self, path: str):
        files, path = _open(path)
        self.file = files.open_input_file(path)
        size = self.file.size()
        wrong = ValueError(f"{path} has no seek table, or a damaged one")
        if size < 17:
            raise wrong
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        body = 12 * count + 9
        if (flags, magic) != (CHECKSUMS, SEEKABLE) or not count or body + 8 > size:
            raise wrong
        if self._at(size - body - 8, 8) != struct.pack("<II", SKIPPABLE_SEEK, body):
            raise wrong
        table = self._at(size - body, 12 * count)
        self.table = np.frombuffer(table, dtype="<u4").reshape(count, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        frame = self._at(self.offsets[-2], self.table[-1, 0]) if self.offsets[-1] + body + 8 == size else b""
        end = struct.pack("<III", len(frame), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        if len(frame) < 16 or table[-12:] != end or frame[-8:] != struct.pack("<Q", xxhash.xxh64_intdigest(frame[:-8] + table[:-12])):
            raise wrong
        self.ids = np.frombuffer(zstandard.decompress(frame[8:-8]), dtype="<i8")
        self.unzip = zstandard.ZstdDecompressor()

    def _at(self, offset, size) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(int(size))

    def _content(self, i: int, frame) -> bytes:
        try:
            content = self.unzip.decompress(frame)
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {i} is damaged") from e
        if len(content) != self.table[i, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} has another checksum")
        return content

    def frame(self, i: int) -> bytes:
        return self._content(i, self._at(self.offsets[i], self.table[i, 0]))

    def frames(self, block: int = 4 << 20) -> Iterator[bytes]:
        """All frames in order, read in blocks."""
        n, i = len(self.ids), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + block, side="right")) - 1)
            j = min(j, n)
            data = memoryview(self._at(self.offsets[i], self.offsets[j] - self.offsets[i]))
            for k in range(i, j):
                a = int(self.offsets[k] - self.offsets[i])
                yield self._content(k, data[a : a + int(self.table[k, 0])])
            i = j


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, level: int = 3) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into a store at ``path`` and return its manifest.

    ``tokenizer`` is the path of a tokenizer file that every worker can read.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 1000, "4m")
    end = struct.pack("<I", end_id)
    folder = f"{path}/files"
    files, local = _open(folder)
    files.create_dir(local, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, tokens = None, 0
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            encoder = shared_encoder(tokenizer)
            writer = writer or FrameWriter(f"{folder}/{name}", level)
            ids = batch.column(0).fill_null(NO_ID).to_pylist()
            for first, last, data, offsets in slices(text_column(batch)):
                for doc_id, raw in zip(ids[first:last], encoder.encode(data, offsets), strict=True):
                    writer.add(doc_id, raw + end)
                    tokens += len(raw) // 4 + 1
        if writer and writer.ids:
            writer.close()
            row = {"part": TaskContext.get().partitionId(), "file": name, "min_id": writer.ids[0], "max_id": writer.ids[-1], "n_docs": len(writer.ids), "n_tokens": tokens}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("min_id", pa.int64()), ("max_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, _MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files of a store in order, with the number of tokens before each."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of a store: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary, unsigned 32-bit)."""
    folder = f"{path}/files"

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, rows, size = FrameReader(f"{folder}/{name}"), [], 0
                for doc_id, raw in zip(reader.ids.tolist(), reader.frames(), strict=False):
                    rows.append((doc_id if doc_id != NO_ID else None, start, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None))
                    start += len(raw) // 4
                    size += len(raw)
                    if size > 8 << 20:
                        yield _documents(rows)
                        rows, size = [], 0
                if rows:
                    yield _documents(rows)

    files = manifest(spark, path).select("file", "start")
    n = max(1, files.count())
    return files.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _documents(rows):
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the documents named in ``wanted`` (doc_id); other frames stay compressed.

    An id is in one file only: the last that begins with it or a smaller one. Files and
    wanted ids are dealt to slots of the id line, each with as many files as another, and
    meet there in the order of ids, so neither side is collected.
    """
    folder = f"{path}/files"
    files = manifest(spark, path).select("file", "min_id", "max_id")
    bounds = sorted({int(x) for x in files.approxQuantile("min_id", [i / ID_SLOTS for i in range(1, ID_SLOTS)], 0.001)})
    if not bounds:
        return spark.createDataFrame([], "doc_id long, ids binary")
    slot = lambda c: F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b <= F.col(c)))
    begins = files.select(F.explode(F.sequence(slot("min_id"), slot("max_id"))).alias("slot"), F.col("min_id").alias("doc_id"), F.lit(0).alias("kind"), "file", "max_id")
    ids = wanted.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    none = F.lit(None)
    ids = ids.select(slot("doc_id").alias("slot"), "doc_id", F.lit(1).alias("kind"), none.cast("string").alias("file"), none.cast("long").alias("max_id"))
    before = W.partitionBy("slot").orderBy("doc_id", "kind")
    last = lambda c: F.last(c, ignorenulls=True).over(before).alias(c)
    places = begins.union(ids).select("doc_id", "kind", last("file"), last("max_id")).where("kind = 1 and doc_id <= max_id").select("file", "doc_id")

    def read(batches):
        reader, at = None, ""
        for batch in batches:
            rows = []
            for name, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != at:
                    reader, at = FrameReader(f"{folder}/{name}"), name
                lo, hi = np.searchsorted(reader.ids, doc_id), np.searchsorted(reader.ids, doc_id, side="right")
                rows += [(doc_id, reader.frame(int(i))) for i in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], names=["doc_id", "ids"])

    return places.repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(read, "doc_id long, ids binary")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """The documents' digest columns as read from freshly written files."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_store(docs, path, tokenizer, end_id)
    until_exit(spark, path)
    return read_store(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
