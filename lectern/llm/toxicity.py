"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of the lower-cased text (4 to 8 code points,
white space as one sign, a space before the text), hashed into a fixed number of buckets.
On a bounded sample of labelled rows the buckets' document counts per class give log-count
ratios; the most telling buckets are kept (ties: the smaller bucket), and a logistic
regression is fitted on presence times ratio. Every whole text is then scored in one pass.

Null and empty texts have no n-grams and get the intercept's score. Without labels of both
classes every score is 0.0. Repeated rows each get a row; an empty table gives none.
Labels, language, source, doc_id and columns of other names never enter a score. Of several
labels of an id the largest holds, and of several texts the least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.labelled import Sparse, descend, labelled_sample, remainder, sigmoid
from lectern.llm.words import U64, text_column
from lectern.llm.words import slices as slices_of
from lectern.session import bounded_batches, materialise

#: Labelled rows to learn from at most.
TRAIN_ROWS = 12_000
SIZES = (4, 5, 6, 7, 8)
BITS = 20
#: Buckets with a weight.
FEATURES = 4_000
THRESHOLD = 0.7

_PART = 1 << 16


def slices(col: pa.Array):
    """Short runs of texts: every character starts an n-gram of each size."""
    return slices_of(col, 1 << 18)


def _distinct(found) -> tuple[np.ndarray, np.ndarray]:
    """Each (document, bucket) of (bucket, document) arrays once."""
    pair = np.unique(np.concatenate([(d << BITS | b).astype(np.uint64 if len(d) and d[-1] >> 12 else np.uint32) for b, d in found]))
    return (pair >> BITS).astype(np.int64), (pair & ((1 << BITS) - 1)).astype(np.int64)


def _grams(data: bytes, offsets: np.ndarray):
    """(bucket, whether inside a text, document) arrays of the n-grams of consecutive UTF-8 texts, size by size."""
    raw = np.frombuffer(data, dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]  # in code points
    point = np.frombuffer(data.translate(_SPACE).decode().encode("utf-32-le"), dtype="<u4").astype(U64)
    n = len(point)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = bounds[doc + 1] - np.arange(n)
    padded = np.concatenate([point, np.zeros(SIZES[-1], dtype=U64)])
    h = point
    for size in range(2, SIZES[-1] + 1):
        h = h * U64(0xD6E8FEB86659FD93) + padded[size - 1 : size - 1 + n]
        if size in SIZES:
            g = (h + U64(size)) * U64(0x9E3779B97F4A7C15)
            g ^= g >> U64(29)
            g *= U64(0xBF58476D1CE4E5B9)
            yield (g >> U64(64 - BITS)).astype(np.int64), left >= size, doc


_SPACE = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def _lower(batch: pa.RecordBatch) -> pa.Array:
    """Lower-cased texts with a space before each, so that n-grams show where words begin."""
    return pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.utf8_lower(text_column(batch)), pa.scalar(" ", pa.large_string()))


def class_counts(sample: DataFrame) -> np.ndarray:
    """Documents of the sample that have each bucket, per class: shape (2, 2**BITS)."""

    def count(batches):
        total = np.zeros((2, 1 << BITS), dtype=np.uint32)
        for batch in batches:
            label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in slices(_lower(batch)):
                doc, bucket = _distinct((b[ok], d[ok]) for b, ok, d in _grams(data, offsets))
                toxic = label[first:last][doc] > 0
                np.add.at(total[1], bucket[toxic], 1)
                np.add.at(total[0], bucket[~toxic], 1)
        flat = total.ravel()
        parts = [(i, zstandard.compress(flat[i * _PART : (i + 1) * _PART].tobytes(), 1)) for i in range(len(flat) // _PART)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["part", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(zstandard.decompress(raw), dtype=np.uint32)
                sums[i] = sums[i] + more if i in sums else more
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    out = np.zeros(2 << BITS, dtype=np.uint32)
    for r in sample.mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).toLocalIterator():
        out[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(bytes(r["counts"]), dtype=np.uint32)
    return out.reshape(2, -1)


class Model:
    """A weight for each bucket (0 for most) and an intercept."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, col: pa.Array) -> np.ndarray:
        """Scores of lower-cased texts."""
        out = np.full(len(col), self.bias)
        for first, last, data, offsets in slices(col):
            found = []
            for bucket, ok, doc in _grams(data, offsets):
                at = np.flatnonzero((self.weights[bucket] != 0) & ok)
                found.append((bucket[at], doc[at]))
            doc, bucket = _distinct(found)
            out[first:last] += np.bincount(doc, self.weights[bucket], minlength=last - first)
        return sigmoid(out)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, features: int = FEATURES, l2: float = 3e-4) -> Model | None:
    """Fit on labelled rows that are not held out; None without both classes."""
    spark = docs.sparkSession
    bounded_batches(spark)
    cores = spark.sparkContext.defaultParallelism
    sample = materialise(labelled_sample(docs, labels, "toxic", limit, remainder() != 1).repartition(max(16, 4 * cores)))
    n = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    clean, toxic = (x.astype(np.float64) for x in class_counts(sample))
    p, q = (toxic + 0.5) / (n[True] + 1), (clean + 0.5) / (n[False] + 1)
    ratio = np.log(p / q)
    # Gain of knowing the bucket, in nats over all rows; rare buckets have little.
    pooled = (toxic + clean + 0.5) / (n[True] + n[False] + 1)
    gain = toxic * np.log(p / pooled) + (n[True] - toxic) * np.log((1 - p) / np.maximum(1 - pooled, 1e-12))
    gain += clean * np.log(q / pooled) + (n[False] - clean) * np.log((1 - q) / np.maximum(1 - pooled, 1e-12))
    gain[(toxic + clean < 3) | (p >= 1) | (q >= 1)] = -1
    top = np.argsort(-gain, kind="stable")[:features]
    top = np.sort(top[gain[top] > 0])
    scaled = ratio[top]
    del clean, toxic, p, q, ratio, pooled, gain
    place = spark.sparkContext.broadcast(top)

    def rows(batches):
        for batch in batches:
            kept: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for first, _, data, offsets in slices(_lower(batch)):
                for bucket, ok, doc in _grams(data, offsets):
                    at = np.minimum(np.searchsorted(place.value, bucket), len(place.value) - 1)
                    hit = np.flatnonzero(ok & (place.value[at] == bucket))
                    for pair in np.unique((doc[hit] << BITS) + at[hit]).tolist():
                        kept[first + (pair >> BITS)].append(pair & ((1 << BITS) - 1))
            label = batch.column(batch.schema.get_field_index("label"))
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(x)) for x in kept], pa.list_(pa.int32())), label], names=["f", "label"])

    got = sample.select("text", "label").mapInArrow(rows, "f array<int>, label int").toArrow()
    x = Sparse.of_lists(got["f"].combine_chunks(), scaled)
    y = (got["label"].to_numpy() > 0).astype(np.float64)
    del got

    def gradient(w):
        g = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) / x.n
        return np.append(x.back(g) + l2 * w[:-1], g.sum())

    w = descend(gradient, np.append(np.zeros(len(top)), np.log(n[True] / n[False])), steps=400, rate=0.05)
    weights = np.zeros(1 << BITS, dtype=np.float64)
    weights[top] = w[:-1] * scaled
    return Model(weights, float(w[-1]))


def scores(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            s = shared.value.score(_lower(batch)) if shared.value else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double").select(
        "doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, with the columns they came with."""
    spark = docs.sparkSession
    model = train(docs, labels)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def clean(batches):
        for batch in batches:
            s = shared.value.score(_lower(batch)) if shared.value else np.zeros(batch.num_rows)
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(clean, docs.schema)
