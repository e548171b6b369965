"""Vector compression by product codes, with Lloyd's rounds maintained from changes.

Components become whole numbers, floor(4096 x), and vectors are cut into equal parts. Each
part position has a codebook of 16 entries, which starts as that part of the vectors of
smallest vec_id. A round assigns every part to its nearest entry, and each entry becomes the
floor of the mean of its parts. Running sums and counts of whole numbers are kept from round
to round: the assignments of a round are written beside those of the one before, and only
parts that changed their entry add to the sums of the new one and take away from those of the
old one. What is shuffled is at most one sum for each entry and component a task; what the
driver holds are codebooks, sums and counts, whose size does not depend on the vectors.

Defined cases: vectors that are null or hold a null or non-finite component are dropped, and
so are those without components, of a length that the parts don't divide, or of another length
than the first kept one. Components are held within +-2^24, that is, values within +-4096, so
squares stay exact. Vectors without vec_id come last; of equal ids the smaller vector comes
first. With fewer than 16 vectors codebooks have as many entries. Of equally near entries the lower one is taken;
an entry without parts stays. Labels may be null and form one group; a sum of errors beyond a
long is null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.groups import join_groups
from lectern.session import bounded_batches, discard, materialise

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE, MOST = 4096, 1 << 24
#: Below this magnitude the products of a batch are exact in floating point.
_EXACT = 1 << 20
_SLICE = 4096


def whole_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label and the whole components ``x`` of the vectors that are kept, whatever their length."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten(), np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            size = ends - begins
            good = (bad[ends] == bad[begins]) & (size > 0) & (size % parts == 0)
            whole = np.clip(np.floor(SCALE * np.where(np.isfinite(values), np.clip(values, -MOST, MOST), 0)), -MOST, MOST).astype(np.int32)
            keep = np.repeat(good, size)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size[good])]), pa.int32())
            some = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.ListArray.from_arrays(offsets, pa.array(whole[keep]))], names=["vec_id", "label", "x"])

    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return picked.mapInArrow(run, "vec_id long, label long, x array<int>")


def nearest(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part of the rows of ``x``, and the squared distances summed over parts."""
    parts, _, width = codebooks.shape
    codes, error = np.zeros((len(x), parts), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
    for first in range(0, len(x), _SLICE):
        some = x[first : first + _SLICE].astype(np.int64)
        exact = max(np.abs(some).max(initial=0), np.abs(codebooks).max(initial=0)) < _EXACT
        for p in range(parts):
            part, book = some[:, p * width : (p + 1) * width], codebooks[p]
            if exact:
                far = (book * book).sum(1) - 2 * (part.astype(np.float64) @ book.T.astype(np.float64))
            else:
                far = np.stack([((part - e) ** 2).sum(1) for e in book], axis=1)
            code = far.argmin(1)
            codes[first : first + _SLICE, p] = code
            error[first : first + _SLICE] += ((part - book[code]) ** 2).sum(1)
    return codes, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _binary(codes: np.ndarray) -> pa.Array:
    """One binary value a row."""
    n, size = codes.shape
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), n, [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, parts)


_STATE = "vec_id long, label long, x array<int>, old binary, new binary"


def assign(state: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """The state with each part's assignment by ``codebooks`` as ``new``, and the one before it as ``old``."""
    parts, _, width = codebooks.shape

    def run(batches):
        for batch in batches:
            codes, _ = nearest(_matrix(batch.column(2), parts * width), codebooks)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), _binary(codes)], names=["vec_id", "label", "x", "old", "new"])

    return state.mapInArrow(run, _STATE)


def changes(state: DataFrame, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What parts whose assignment changed add to the sums and counts of entries and take away from them."""
    parts, entries, width = codebooks.shape

    def run(batches):
        total = np.zeros((parts * entries, width + 1), dtype=np.int64)
        for batch in batches:
            x, new = _matrix(batch.column(0), parts * width).astype(np.int64), _codes(batch.column(2), parts).astype(np.int64)
            before = batch.column(1)
            known = np.full(len(x), before.null_count == 0)
            old = _codes(before, parts).astype(np.int64) if before.null_count == 0 else np.full_like(new, -1)
            for p in range(parts):
                moved = new[:, p] != old[:, p]
                own = np.column_stack([x[moved, p * width : (p + 1) * width], np.ones(int(moved.sum()), dtype=np.int64)])
                np.add.at(total, p * entries + new[moved, p], own)
                np.subtract.at(total, p * entries + old[moved & known, p], own[known[moved]])
        slot, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(at), pa.array(total[slot, at])], names=["slot", "at", "value"])

    out = np.zeros((parts * entries, width + 1), dtype=np.int64)
    moves = state.select("x", "old", "new").where("not (old <=> new)").mapInArrow(run, "slot long, at long, value long")
    for r in moves.groupBy("slot", "at").agg(F.sum("value").alias("value")).collect():  # as many as codebooks have numbers
        out[r["slot"], r["at"]] = r["value"]
    out = out.reshape(parts, entries, width + 1)
    return out[..., :width], out[..., width]


def train(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The kept vectors and their final codebooks, parts x entries x components; both are empty for an empty table."""
    order = [F.col("vec_id").asc_nulls_last(), "x", "label"]
    first = whole.orderBy(*order).limit(1).collect()
    size = len(first[0]["x"]) if first else 0
    kept = whole.where(F.size("x") == size)
    start = [r["x"] for r in kept.orderBy(*order).limit(entries).collect()]
    codebooks = np.array(start, dtype=np.int64).reshape(len(start), parts, size // parts).transpose(1, 0, 2)
    if not start:
        return kept, codebooks
    state = kept.select("*", F.lit(None).cast("binary").alias("old"), F.lit(None).cast("binary").alias("new"))
    sums, counts = np.zeros_like(codebooks), np.zeros(codebooks.shape[:2], dtype=np.int64)
    for _ in range(rounds):
        after = materialise(assign(state, codebooks))
        discard(state)
        state = after
        more, number = changes(state, codebooks)
        sums, counts = sums + more, counts + number
        codebooks = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], codebooks)
    discard(state)
    return kept, codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encode(whole: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of whole vectors."""
    parts, _, width = codebooks.shape

    def run(batches):
        for batch in batches:
            codes, error = nearest(_matrix(batch.column(2), parts * width), codebooks)
            text = codes.tobytes().hex()
            code = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return whole.mapInArrow(run, "vec_id long, label long, code string, error long")


def decode(encoded: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``encoded`` with the components, as numbers again, that its codes stand for."""
    parts, _, width = codebooks.shape
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in e]) for e in book]) for book in codebooks])
    of = lambda p: entries[p][F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")]
    return encoded.withColumn("embedding", F.concat(*[of(p) for p in range(parts)]))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the vectors that are kept."""
    bounded_batches(vectors.sparkSession, rows=20_000)
    whole = materialise(whole_vectors(vectors, parts))
    kept, codebooks = train(whole, parts, entries, rounds)
    encoded = materialise(encode(kept, codebooks).withColumn("label", F.struct(F.coalesce("label", F.lit(0)).alias("value"), F.col("label").isNull().alias("none"))))
    discard(whole)
    by_label = encoded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("label_rows"))
    found = join_groups(encoded, by_label, ["label"], "label_rows")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
