"""The classifiers against plain models, and the pipeline against a plain model of its stages."""

import collections
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import line_dedup, pieces, quality_classifier, toxicity
from lectern.llm.labelled import Sparse

sys.path.insert(0, str(Path(__file__).parent))
import test_pairs as plain

MASK = (1 << 64) - 1


def plain_buckets(text):
    """Distinct hashed n-grams of a text, one code point at a time."""
    t = " " + "".join(" " if c in "\t\n\x0b\f\r" else c for c in text.lower()) if text is not None else " "
    out = set()
    for i in range(len(t)):
        for size in toxicity.SIZES:
            if i + size <= len(t):
                h = 0
                for c in t[i : i + size]:
                    h = (h * 0xD6E8FEB86659FD93 + ord(c)) & MASK
                h = (h + size) * 0x9E3779B97F4A7C15 & MASK
                h ^= h >> 29
                h = h * 0xBF58476D1CE4E5B9 & MASK
                out.add(h >> (64 - toxicity.BITS))
    return out


def test_toxicity_against_a_plain_model(spark, docs_of):
    """Counts, log-count ratios, the choice of features, the gradient steps and the scores."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdé日") for _ in range(rnd.randint(2, 5)))
    rows, labels = [], []
    for i in range(60):
        bad = i % 3 == 0
        rows.append((i, " ".join([word() for _ in range(6)] + (["Gräßlich"] if bad else []))))
        labels.append((i, int(bad)))
    df, lab = docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab, features=300)
    sample = [(r.text, r.label) for r in toxicity.labelled_sample(df, lab, "toxic", 1000, toxicity.remainder() != 1).collect()]
    sets, y = [plain_buckets(t) for t, _ in sample], np.array([float(v > 0) for _, v in sample])
    n1, n0 = y.sum(), len(y) - y.sum()
    count = [collections.Counter(b for s, v in zip(sets, y, strict=True) if v == k for b in s) for k in (0, 1)]
    gain, ratio = {}, {}
    for b in set(count[0]) | set(count[1]):
        c, t = count[0][b], count[1][b]
        p, q, pooled = (t + 0.5) / (n1 + 1), (c + 0.5) / (n0 + 1), (t + c + 0.5) / (n1 + n0 + 1)
        ratio[b] = np.log(p / q)
        if t + c >= 3 and p < 1 and q < 1:
            gain[b] = t * np.log(p / pooled) + (n1 - t) * np.log((1 - p) / (1 - pooled)) + c * np.log(q / pooled) + (n0 - c) * np.log((1 - q) / (1 - pooled))
    chosen = sorted(sorted((b for b in gain if gain[b] > 0), key=lambda b: (-gain[b], b))[:300])
    # Equal gains come in many buckets: the plain model takes the operator's where its own rounding can't tell.
    mine = np.flatnonzero(model.weights)
    least = min(gain[b] for b in chosen)
    assert all(gain[b] >= least - 1e-9 for b in mine) and {b for b in chosen if gain[b] > least + 1e-9} <= set(mine.tolist())
    x = np.array([[ratio[b] * (b in s) for b in mine.tolist()] for s in sets])
    w, m, v = np.append(np.zeros(len(mine)), np.log(n1 / n0)), 0, 0
    for t in range(1, 401):
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        g = np.append(x.T @ (p - y) / len(y) + 3e-4 * w[:-1], (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weight = dict(zip(mine.tolist(), w[:-1] * np.array([ratio[b] for b in mine.tolist()]), strict=True))
    for r in toxicity.scores(docs_of([*rows, (900, None), (901, ""), (902, "GRÄSSLICH gräßlich")]), model).collect():
        text = dict(rows).get(r.doc_id, "GRÄSSLICH gräßlich" if r.doc_id == 902 else "")
        z = w[-1] + sum(weight.get(b, 0.0) for b in plain_buckets(text))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_long_text_scores_like_its_parts(spark, docs_of):
    """A text far beyond a slice has the n-grams of a short one that repeats as often."""
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    df = docs_of([(i, "nasty words here" if i % 2 else "some kind ones") for i in range(40)])
    model = toxicity.train(df, lab)
    got = {r.doc_id: r.score for r in toxicity.scores(docs_of([(1, "nasty words here " * 3), (2, "nasty words here " * 60_000)]), model).collect()}
    assert got[1] == pytest.approx(got[2], abs=1e-9)
    rated = quality_classifier.train(df, lab.withColumnRenamed("toxic", "quality"))
    assert quality_classifier.rate(docs_of([(2, "nasty words here " * 60_000), (3, "x" * 2_000_000)]), rated).count() == 2


@pytest.mark.parametrize("grades", [2, 3, 5])
def test_gradient_of_the_ordinal_model(grades):
    """Against differences of the negative log-likelihood as defined."""
    rnd = np.random.default_rng(grades)
    width, n, l2 = 7, 12, 0.03
    dense = rnd.normal(size=(n, width)) * (rnd.random((n, width)) < 0.6)
    x = Sparse([(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense], width)
    at = rnd.integers(0, grades, n)
    z = rnd.normal(size=width + grades - 1) * 0.5

    def loss(z):
        t = [z[width]]
        for step in z[width + 1 :]:
            t.append(t[-1] + np.exp(step))
        total = 0.0
        for row, g in zip(dense, at, strict=True):
            tail = [1.0, *(1 / (1 + np.exp(-(row @ z[:width] - c))) for c in t), 0.0]
            total -= np.log(tail[g] - tail[g + 1])
        return total / n + l2 / 2 * (z[:width] ** 2).sum()

    eye = np.eye(len(z)) * 1e-6
    want = [(loss(z + e) - loss(z - e)) / 2e-6 for e in eye]
    assert quality_classifier.gradient(z, x, at, l2) == pytest.approx(want, abs=1e-6)


def test_rating_by_hand(spark, docs_of):
    """Expected grade and tail probability from weights and thresholds, for every row of the table."""
    rows = [(i, t) for i, t in enumerate(["good fine good", "bad worse", "fine bad", None, "", "good " * 500])]
    lab = spark.createDataFrame([(0, 3), (1, 1), (2, 2), (5, 3)], "doc_id long, quality int")
    df = docs_of(rows, extra=True)
    model = quality_classifier.train(df, lab)
    import pyarrow as pa

    for r in quality_classifier.rate(df, model).collect():
        ((_, f, v),) = quality_classifier.features(pa.array([dict(rows)[r.doc_id] or ""], pa.large_string()))
        tails = [1 / (1 + np.exp(-(sum(model.weights[a] * b for a, b in zip(f, v, strict=True)) - t))) for t in model.thresholds]
        assert r.expected_grade == pytest.approx(1 + sum(tails)) and r.tail_probability == pytest.approx(tails[1])
        assert r.kept == (r.tail_probability >= 0.5)


def plain_pipeline(rows, items, encode):
    """Stages after toxicity on (doc_id, text, source), one row at a time."""
    places = [(i, n, x.strip(line_dedup._STRIP)) for i, t, _ in rows if i is not None for n, x in enumerate((t or "").split("\n"))]
    long = line_dedup.MIN_CHARS
    again = lambda i, n, x: bool(x) and any((j, m) < (i, n) and (x == y or min(len(x), len(y)) >= long and plain.near(x, y)) for j, m, y in places if y)
    cut = []
    for i, t, s in rows:
        lines = (t or "").split("\n")
        kept = [x for n, x in enumerate(lines) if i is None or not again(i, n, x.strip(line_dedup._STRIP))]
        solid = [x for x in kept if x.strip(" \t\n\x0b\f\r")]
        if len(kept) == len(lines) or solid:
            cut.append((i, t if len(kept) == len(lines) else "\n".join(kept), s))
    sets = [plain.shingles(t, 5) for _, t, _ in cut]
    up = list(range(len(cut)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if cut[a][0] is not None and cut[b][0] is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for a, row in enumerate(cut):
        groups[find(a)].append(row)
    # Of rows of one id any may stand for its group, so the fixture has no such pair.
    one_each = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert all(len({r[1] for r in g if r[0] == min(x[0] for x in g)}) <= 1 for g in groups.values() if g[0][0] is not None)
    known = set()
    for _, t in items:
        w, _ = plain.windows(t)
        known |= {tuple(w[j : j + min(10, len(w))]) for j in range(len(w) - min(10, len(w)) + 1)} if w else set()
    clean = [r for r in one_each if not any(x in known for n in range(1, 11) for x in plain.windows(r[1], n)[1])]
    return sorted(((str(i), encode(t or "")) for i, t, _ in clean), key=str)


def test_pipeline_against_a_plain_model(spark, tmp_path, tokenizers):
    """Nulls in any column, empty and repeated rows, repeated ids, near copies, clashing columns."""
    sentencepiece = pytest.importorskip("sentencepiece")
    import corpus_pipeline

    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    base = [[word() for _ in range(rnd.choice([8, 40, 90]))] for _ in range(12)]
    lines = [" ".join(word() for _ in range(6)) for _ in range(5)]
    passage = [word() for _ in range(14)]
    rows = []
    for i in range(60):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = word()
        text = " ".join(w) + ("\n" + rnd.choice(lines) if rnd.random() < 0.5 else "") + (" " + " ".join(passage[:12]) if rnd.random() < 0.2 else "")
        rows.append((i, text, None if i % 7 == 0 else "s"))
    rows += [(i, " ".join(word() for _ in range(30)) + "\n" + lines[i % 5], "s") for i in range(5)]  # other texts under used ids
    rows += [(900, None, "s"), (901, "", None), (902, "\n \n", "s"), (903, "one", "s"), (903, "one", "s"), (None, "no id here", "s"), (None, None, None)]
    items = [(1, " ".join(passage)), (2, None), (3, "..."), (None, "unseen words of an item")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("_gone", "n_removed", "_row", "score", "label"):
        docs = docs.withColumn(c, F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(((str(r.doc_id), r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_pipeline(rows, items, sp.encode) and len(got) > 15
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unknown_characters_fall_back(tokenizers):
    e = pieces.Encoder(pieces.Pieces({3: "▁", 4: "a", 5: "▁a"}, {3: -2.0, 4: -3.0, 5: -1.0}, {}, 0, "bpe"))
    assert e.encode_text("a\U0001f600a") == [5, 0, 4]
