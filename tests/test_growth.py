"""Increments, trees, folds, styles and sinks against plain models."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import checks, graph, metrics, model
from lectern.sources import files


def plain_components(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


def test_components_by_increments(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(70)]
    steps = [edges[:30], edges[30:45], [], edges[45:]]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    known, aliases, names = graph.components(frame(steps[0])), None, set()
    for i, step in enumerate(steps[1:], 2):
        names |= {r.component for r in known.collect()}
        known, new = graph.merge_components(known, frame(step))
        aliases = new if aliases is None else graph.merge_aliases(aliases, new)
        seen = [e for s in steps[:i] for e in s]
        got, want = {r.node: r.component for r in known.collect()}, plain_components([e for e in seen if e[0] != e[1]])
        assert {n: c for n, c in got.items() if n in want} == want and all(got[n] == n for n in got if n not in want)
        led = {r.alias: r.component for r in aliases.collect()}
        for name in names:  # every id that ever was leads to the component of today
            assert led.get(name, name) == got[name]


def test_ancestors_by_doubling(spark):
    chain = [(i, i - 1 if i else None) for i in range(70)] + [(100, None), (101, 100), (None, 5)]
    df = spark.createDataFrame(chain, "concept_id long, parent long")
    got = {(r.concept_id, r.ancestor, r.level) for r in checks.ancestors(df).collect()}
    assert got == {(i, j, i - j) for i in range(70) for j in range(i)} | {(101, 100, 1)}
    near = {(r.concept_id, r.ancestor, r.level) for r in checks.ancestors(df, 3).collect()}
    assert near == {x for x in got if x[2] <= 3}
    with pytest.raises(ValueError):
        checks.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "concept_id long, parent long"))
    with pytest.raises(ValueError):
        checks.roots(spark.createDataFrame([(1, 2), (2, 1), (5, 1)], "concept_id long, parent long"))


def test_roots_of_a_long_chain(spark, monkeypatch):
    """A chain of 10,000 takes 14 joins or so."""
    written = []
    real = checks.materialise
    monkeypatch.setattr(checks, "materialise", lambda df: written.append(1) or real(df))
    df = spark.range(10_001).select(F.col("id").alias("concept_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = checks.roots(df)
    assert got.count() == 10_000 and got.where("root <> 0 or depth <> concept_id").isEmpty()
    assert len(written) <= 16


def training(seed, n=400, weeks=4):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, 6)).round(3)
    x[:, 3] = rnd.integers(0, 5, n)
    post = rnd.uniform(0.05, 0.95, n).round(3)
    z = np.log(post / (1 - post)) + x @ np.array([1.0, 0.5, -0.5, 0.2, 0.0, 0.3])
    y = (rnd.uniform(size=n) < 1 / (1 + np.exp(-z))).astype(int)
    return x, post, y, np.arange(n) % weeks


def plain_fit(x, post, y, reg=0.1, rounds=4000):
    """The minimum of the ridge loss by plain gradient steps."""
    x = x.copy()
    x[:, 3] = np.log1p(x[:, 3])
    off, n, one = np.log(post / (1 - post)), len(y), y.sum()
    w = np.where(y == 1, n / (2 * one), n / (2 * (n - one)))
    b = np.zeros(6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(off + x @ b)))
        b += 0.5 * ((w * (y - p)) @ x / n - reg * b)
    return b


def test_folds_are_fitted_at_once(spark):
    x, post, y, week = training(1)
    names = ["syllabus", "daily", "repeat", "weeks_since", "diff_set", "prereq"]
    rows = [(int(w), float(p), int(t), *map(float, r)) for w, p, t, r in zip(week, post, y, x)]
    df = spark.createDataFrame(rows, "week int, posterior double, label int, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    got = model.fit_folds(df, steps=12)
    assert set(got) == {None, 0, 1, 2, 3}
    for fold, (weights, fitted) in got.items():
        keep = np.ones(len(y), bool) if fold is None else week != fold
        want = plain_fit(x[keep], post[keep], y[keep])
        assert fitted and np.allclose([weights[t] for t in model.TERMS], want, atol=1e-5), fold
    alike = model.fit_folds(df.where("week = 1 or label = 1"))
    assert alike[1] == (dict(model.WEIGHTS), False) and alike[0][1]
    assert model.fit_folds(df.limit(0)) == {None: (dict(model.WEIGHTS), False)}


def test_metrics_add_up_over_subjects(spark):
    rnd = random.Random(4)
    rows = [(w, rnd.choice(["a", "b", None]), r, int(rnd.random() < 0.4), rnd.choice([None, 2.0, 3.0]), rnd.random(), rnd.choice([None, True, False])) for w in range(3) for r in range(1, 41)]
    rows += [(0, "a", None, 1, 5.0, None, None), (3, "c", None, 1, None, None, True), (3, "c", 1, 0, None, 0.5, None)]
    df = spark.createDataFrame(rows, "list_id int, subject string, rank int, y int, weight double, p double, correct boolean")
    got = {(r.list_id, r.subject, r.whole): r for r in metrics.metric_rollup(df, k=10).collect()}
    assert len(got) == len({(r[0], r[1]) for r in rows}) + 4
    for (w, s, whole), r in got.items():
        own = [x for x in rows if x[0] == w and (whole or x[1] == s)]
        real = [x for x in own if x[3]]
        hits = [x for x in real if x[2] and x[2] <= 10]
        top = [x for x in own if x[2] and x[2] <= 10]
        assert r.recall == pytest.approx(len(hits) / len(real) if real else 0) and r.precision == pytest.approx(len(hits) / len(top) if top else 0)
        assert r.mrr == pytest.approx(sum(1 / x[2] for x in real if x[2]) / len(real) if real else 0)
        assert r.brier == pytest.approx(sum(((x[5] or 0) - x[3]) ** 2 for x in own) / len(own))
        total = sum(x[4] or 1.0 for x in real)
        assert r.weighted_recall == pytest.approx(sum(x[4] or 1.0 for x in hits) / total if real else 0)
        told = [x[6] for x in own if x[6] is not None]
        assert r.accuracy == (pytest.approx(sum(told) / len(told)) if told else None)


@pytest.mark.parametrize("option,answer,pattern", [
    ("12", "12", "same"), (" Left ", "left", "same"), ("-3.5", "3.5", "negated"), ("4.2", "420", "shifted point"), ("0.5", "500", "shifted point"), ("24", "12", "doubled or halved"),
    ("13", "12", "next to it"), ("21", "120", "other number"), ("201", "120", "same digits"), ("0", "7", "other number"), ("up and left", "left and up", "same words"), ("x", "12", "other text"), ("12", "y", "other text"), ("0", "0.0", "same"),
])
def test_distractor_patterns(spark, option, answer, pattern):
    df = spark.createDataFrame([(option, answer)], "o string, a string")
    assert df.select(checks.distractor_pattern(F.col("o"), F.col("a"))).first()[0] == pattern


def test_stem_lengths_within_the_stated_error(spark):
    rnd = random.Random(8)
    lengths = [rnd.randint(0, 3000) for _ in range(4000)]
    df = spark.createDataFrame([("s", "x" * n, ["a"]) for n in lengths], "subject string, question_text string, options array<string>").repartition(7)
    got = checks.house_style(df, accuracy=100).first()
    lengths.sort()
    for q, x in zip((0.1, 0.5, 0.9), got.stem_length):
        places = [i for i, n in enumerate(lengths) if n == x]
        assert min(abs(i - q * 4000) for i in places) <= 4000 / 100 + 1
    assert got.distractors == []


def test_increments_merge_by_key(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "book string, k long, v string"
    frame = lambda rows: spark.createDataFrame(rows, schema + ", at int, deleted boolean")
    steps = [
        [("a", 1, "x", 1, None), ("a", 2, "y", 1, False), ("b", 1, "z", 1, None), (None, 1, "n", 1, None)],
        [("a", 2, "y2", 2, False), ("a", 2, "y1", 1, False), ("c", 9, "w", 1, None), ("b", 1, None, 2, True), ("a", 3, None, 1, None)],
        [("b", 1, "back", 3, False), ("a", 1, "x", 4, True), (None, 1, "n2", 2, None)],
        [],
    ]
    table = {}
    for step in steps:
        for b, k, v, at, gone in sorted(step, key=lambda r: r[3]):
            table[b, k] = None if gone else (v,)
        for _ in range(2):  # the second time changes nothing
            files.merge_increment(frame(step), path, ["book", "k"], order="at")
            got = {(r.book, r.k): r.v for r in files.read_merged(spark, path, schema).collect()}
            assert got == {key: v[0] for key, v in table.items() if v}


def test_untouched_books_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "book string, k long, v string")
    files.merge_increment(frame([(b, k, "x") for b in "abc" for k in range(5)]), path, ["book", "k"], place=F.lit(0))
    listed = lambda book: sorted(p.name for p in (tmp_path / "t" / f"book={book}").rglob("part-*"))
    before = {b: listed(b) for b in "abc"}
    files.merge_increment(frame([("b", 2, "new")]), path, ["book", "k"], place=F.lit(0))
    assert listed("a") == before["a"] and listed("c") == before["c"] and listed("b") != before["b"]


def test_broken_off_merge_leaves_the_table(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "book string, k long, v string"
    files.merge_increment(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema), path, ["book", "k"])
    broken = spark.createDataFrame([("a", 1, "no"), ("b", 2, "no")], schema).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("broken off"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken off"):
        files.merge_increment(broken, path, ["book", "k"])
    assert {(r.book, r.k, r.v) for r in files.read_merged(spark, path, schema).collect()} == {("a", 1, "x"), ("b", 1, "y")}


def test_append_reads_only_its_books(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "book string, k long")
    files.append_new(rows.limit(1), path, ["book", "k"], by="book")
    files.append_new(rows, path, ["book", "k"], by="book")
    files.append_new(rows, path, ["book", "k"], by="book")
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(path).select("book", "k").collect())) == [("a", 1), ("b", 1), ("b", 2)]


def test_documents_in_row_order(spark, tmp_path):
    rows = spark.createDataFrame([(10, "b"), (2, "é"), (2, "a")], "i long, t string").repartition(3)
    files.write_document(rows, str(tmp_path / "d"), {"n": 3}, indent=2)
    (part,) = (tmp_path / "d").glob("part-*.txt")
    text = part.read_text()
    assert json.loads(text) == {"documents": [{"i": 2, "t": "a"}, {"i": 2, "t": "é"}, {"i": 10, "t": "b"}], "report": {"n": 3}} and text.count("\n") > 8
    files.write_array(rows, str(tmp_path / "a"))
    back = files.read_array(spark, str(tmp_path / "a"), "i long, t string").collect()
    assert Counter(map(tuple, back)) == Counter(map(tuple, rows.collect()))
    files.write_array(rows.limit(0), str(tmp_path / "e"))
    assert files.read_array(spark, str(tmp_path / "e"), "i long, t string").count() == 0


@pytest.mark.parametrize("limit", [1000, 3])
def test_history_sizes(spark, monkeypatch, limit):
    """Few folds and many are counted alike: rows strictly older than the held-out time."""
    from datetime import datetime, timedelta

    monkeypatch.setattr(model, "MAX_FOLDS", limit)
    rnd = random.Random(limit)
    at = lambda n: None if n is None else datetime(2024, 1, 1) + timedelta(hours=n)
    rows = [(at(rnd.choice([None, *range(50)])), rnd.choice([None, *"abcdef"])) for _ in range(120)]
    folds = [(i, at(n)) for i, n in enumerate([0, 5, 5, 17, 30, 49, 90, None, 200])]
    df, held = spark.createDataFrame(rows, "captured_at timestamp, concept_id string"), spark.createDataFrame(folds, "fold int, held_out_at timestamp")
    got = {r.fold: (r.rows_before, r.concepts) for r in model.history_sizes(df, held).collect()}
    want = {}
    for i, t in folds:
        if t and (older := [r for r in rows if r[0] and r[0] < t]):
            want[i] = len(older), len({c for _, c in older} - {None})
    assert got == want
    assert model.history_sizes(df, held.limit(0)).count() == 0
