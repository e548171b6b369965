"""Quality classifier: cumulative-link regression of graded ratings on hashed text.

One weight vector over hashed words is shared by all grades; ordered thresholds cut its
score into grades: P(grade > g) = sigmoid(w x - t_g) with t_0 < t_1 < ... A document gets
the expected grade and the probability of the upper grades, and is kept by the latter.

Features of a text are its words, the words' last two bytes and how much it repeats words,
with damped counts scaled to length 1. The model is fitted on a bounded sample of rated
rows; every whole text is scored. Null and empty texts have no words and get the score of
an empty text. With fewer than two grades the expected grade is the only grade there is
(0.0 without any) and every document is kept. Repeated rows each get a row; an empty table
gives none, and other columns are ignored, whatever their names. Of several ratings of an id
the largest holds, and of several texts the least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.labelled import Sparse, descend, labelled_sample, sigmoid
from lectern.llm.words import SPACED, U64, Words, slices, text_column
from lectern.session import bounded_batches

#: Rated rows to learn from at most.
TRAIN_ROWS = 6_000
BITS = 18
#: Documents whose probability of an upper grade reaches this are kept.
KEEP = 0.5


def features(col: pa.Array):
    """(row, features, values) of each text."""
    shift = U64(64 - BITS)
    for first, last, data, offsets in slices(col):
        w = Words(data, offsets, SPACED, lower=False)
        raw = np.frombuffer(w.data + b"\0", dtype=np.uint8).astype(np.uint64)
        tail = (raw[w.ends - 1] + raw[np.maximum(w.ends - 2, w.starts)] * U64(256) + U64(1 << 20)) * U64(0x9E3779B97F4A7C15)
        word, tail = (w.hashes >> shift).astype(np.int64), (tail >> shift).astype(np.int64)
        for i in range(last - first):
            a, b = int(w.bounds[i]), int(w.bounds[i + 1])
            if a == b:
                yield first + i, np.zeros(0, np.int64), np.zeros(0)
                continue
            f, n = np.unique(word[a:b], return_counts=True)
            g, m = np.unique(tail[a:b], return_counts=True)
            x, y = np.log1p(n), np.log1p(m)
            same = int(10 * len(f) / (b - a))
            yield (
                first + i,
                np.concatenate([f, (1 << BITS) + g, [(2 << BITS) + same]]),
                np.concatenate([x / np.linalg.norm(x), y / np.linalg.norm(y), [0.5]]),
            )


WIDTH = (2 << BITS) + 11


class Model:
    """Shared weights, ordered thresholds between the grades, and the grades."""

    def __init__(self, weights, thresholds, grades):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def rate(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the upper half of the grades."""
        if len(self.grades) < 2:
            return np.full(len(col), float(self.grades[0]) if self.grades else 0.0), np.ones(len(col))
        s = np.zeros(len(col))
        for i, f, v in features(col):
            s[i] = self.weights[f] @ v
        tail = sigmoid(s[:, None] - self.thresholds[None, :])
        steps = np.diff(np.asarray(self.grades, dtype=np.float64))
        return self.grades[0] + tail @ steps, tail[:, (len(self.grades) - 1) // 2]


def cuts(z: np.ndarray, width: int) -> np.ndarray:
    """Thresholds of parameters: after the weights come the first one and logarithms of the positive steps after it."""
    return z[width] + np.concatenate([[0.0], np.cumsum(np.exp(z[width + 1 :]))])


def gradient(z: np.ndarray, x: Sparse, at: np.ndarray, l2: float) -> np.ndarray:
    """Of the mean negative log-likelihood of the places ``at`` of the rows' grades, and l2 / 2 times the squared weights."""
    width = x.width
    s, t = x.dot(z[:width]), cuts(z, width)
    # The likelihood of a grade is the difference of neighbouring tails.
    tail = np.concatenate([np.ones((x.n, 1)), sigmoid(s[:, None] - t[None, :]), np.zeros((x.n, 1))], axis=1)
    rows = np.arange(x.n)
    p = np.maximum(tail[rows, at] - tail[rows, at + 1], 1e-9)
    slope = tail * (1 - tail)
    hi, lo = slope[rows, at] / p, slope[rows, at + 1] / p
    gs = -(hi - lo) / x.n
    gt = np.zeros(len(t) + 2)
    np.add.at(gt, at, hi / x.n)
    np.add.at(gt, at + 1, -lo / x.n)
    gt = gt[1:-1]
    later = np.cumsum(gt[::-1])[::-1]
    return np.concatenate([x.back(gs) + l2 * z[:width], [gt.sum()], later[1:] * np.exp(z[width + 1 :])])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS, l2: float = 1e-5) -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)

    def rows(batches):
        for batch in batches:
            fs, vs = [[]] * batch.num_rows, [[]] * batch.num_rows
            for i, f, v in features(text_column(batch)):
                fs[i], vs[i] = f, v.astype(np.float32)
            kinds = pa.list_(pa.int32()), pa.list_(pa.float32())
            grade = batch.column(batch.schema.get_field_index("label"))
            yield pa.RecordBatch.from_arrays([pa.array(fs, kinds[0]), pa.array(vs, kinds[1]), grade], names=["f", "v", "label"])

    sample = labelled_sample(docs, labels, label, limit).select("text", "label")
    got = sample.mapInArrow(rows, "f array<int>, v array<float>, label int").toPandas()
    grades = sorted(int(g) for g in got["label"].unique())
    if len(grades) < 2:
        return Model(None, None, grades)
    x = Sparse([(np.asarray(f, np.int64), np.asarray(v, np.float64)) for f, v in zip(got["f"], got["v"], strict=True)], WIDTH)
    above = (got["label"].to_numpy()[:, None] > np.asarray(grades[:-1])[None, :]).astype(np.float64)
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    first = -np.log(share / (1 - share))
    start = np.concatenate([np.zeros(WIDTH), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])

    at = above.sum(axis=1).astype(int)
    z = descend(lambda z: gradient(z, x, at, l2), start, steps=150, rate=0.1)
    return Model(z[:WIDTH], cuts(z, WIDTH), grades)


def rate(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """Per row: doc_id, expected_grade, tail_probability and kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            grade, tail = shared.value.rate(text_column(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(grade), pa.array(tail), pa.array(tail >= keep)],
                names=["doc_id", "expected_grade", "tail_probability", "kept"],
            )

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, expected_grade double, tail_probability double, kept boolean")
