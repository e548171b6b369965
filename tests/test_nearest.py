"""The inverted file, repeats by time, and vector blocks, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import nearest, retrieve


def groups_of_vectors(n, seed, dim=12, groups=9):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(groups, dim)) * 3
    return [(i, (middle[rnd.integers(groups)] + rnd.normal(size=dim)).tolist(), i % 3) for i in range(n)]


def brute(rows, asked, k):
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    return {q: sorted(((-float(x[q] @ v), i) for i, v in x.items()))[:k] for q in asked}


@pytest.mark.parametrize("block,cells", [(16, None), (4096, 5)])
def test_inverted_file(spark, block, cells):
    rows = groups_of_vectors(600, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int")
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    index = nearest.build(df, metadata=("part",), cells=cells)
    assert index.rows.count() == 600 and index.rows.select("cell").distinct().count() <= len(index.centres)
    want = brute(rows, [i for i, *_ in rows if i % 50 == 0], 5)
    got = {}
    for r in nearest.search(asked, index, 5, probes=1, exact=True, block_rows=block).collect():
        got.setdefault(r.q_id, []).append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    exact = retrieve.top_k(asked, df, 5)
    some = nearest.search(asked, index, 5, probes=3, block_rows=block)
    assert nearest.recall(some, exact).first()["recall"] >= 0.9
    filtered = nearest.search(asked, index, 5, probes=1, exact=True, where=F.col("part") == 1).collect()
    assert {(r.q_id, r.vec_id) for r in filtered} == {(q, i) for q, v in ((q, brute(rows, [q], 600)[q]) for q in want) for _, i in [x for x in v if x[1] % 3 == 1][:5]}


def test_inverted_file_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    empty = nearest.build(spark.createDataFrame([], schema))
    assert nearest.search(spark.createDataFrame([(1, [1.0])], "q_id long, embedding array<double>"), empty).count() == 0
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(50, None), (51, [None, 1.0]), (52, [float("nan"), 1.0]), (53, []), (54, [1.0, 2.0, 3.0])]
    index = nearest.build(spark.createDataFrame(rows, schema))
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, None)], "q_id long, embedding array<double>")
    got = nearest.search(asked, index, 3, exact=True).collect()
    assert sorted((r.q_id, r.vec_id, r.rank) for r in got) == [(7, 0, 1), (7, 1, 2), (7, 2, 3)]


@pytest.mark.parametrize("sent", [0, 1 << 22])
def test_null_elements_lose_no_neighbours(spark, sent):
    """A vector with a null or non-finite element is no neighbour, and hides none."""
    rows = [(0, [1.0, 0.1]), (1, [None, 1.0]), (2, [float("nan"), 0.0]), (3, [0.9, 0.2]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.withColumnRenamed("vec_id", "q_id")
    got = retrieve.top_k(asked, df, 4, sent=sent).collect()
    assert sorted((r.q_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 0), (0, 2, 3), (0, 3, 5), (3, 1, 3), (3, 2, 0), (3, 3, 5), (5, 1, 0), (5, 2, 3), (5, 3, 5)]
    alone = {r.vec_id: r.canonical for r in retrieve.deduplicate(df, 0.9).collect()}
    assert alone == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4, 5: 5}


def test_pairs_of_blocks_meet_once(spark):
    rows = groups_of_vectors(120, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int")
    vectors = retrieve._vectors(df, "vec_id", "embedding")
    cells = retrieve._own_cells(vectors, "dim", 16)
    assert cells.select("p", "q").distinct().where("p > q").isEmpty()
    assert cells.count() <= 120 * 8  # each row once for each block, its own included
    got = retrieve.similar_pairs(df, 0.8, block_rows=16).collect()
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    assert sorted((r.a, r.b) for r in got) == sorted((i, j) for i in x for j in x if i < j and x[i] @ x[j] > 0.8)


@pytest.mark.parametrize("block", [4, 2048])
def test_repeats_look_back_only(spark, block):
    rnd = random.Random(block)
    rows = [(i, f"s{i % 2}", rnd.choice(["a", "b", None]), [rnd.gauss(0, 1), rnd.gauss(0, 1)], rnd.choice(["x 1", "x 2", "y 1", "z"]), rnd.choice([None, 1, 1, 2, 3, 9]), rnd.choice(["bank", "daily", "weekly"])) for i in range(120)]
    df = spark.createDataFrame(rows, "qid long, subject string, concept_id string, embedding array<double>, text string, week int, kind string")
    got = {(r.qid, r.history): r.tier_no for r in retrieve.repeat_history(df, F.col("qid") % 5 == 0, 0.3, 0.6, block_rows=block).collect()}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    nums = lambda t: [w for w in t.split() if w.isdigit()]
    for i, _, concept, v, text, week, _ in rows:
        if i % 5:
            continue
        for history in ("bank", "daily", "weekly"):
            best = 0
            for j, _, c2, v2, t2, w2, kind in rows:
                if j == i or concept is None or c2 != concept or kind != history:
                    continue
                if history != "bank" and (week is None or w2 is None or (w2 != week if history == "daily" else w2 >= week)):
                    continue
                s = cos(v, v2)
                best = max(best, 4 if text == t2 else 3 if s >= 0.6 and nums(text) == nums(t2) else 2 if s >= 0.3 else 1)
            assert got[i, history] == best, (i, history)
