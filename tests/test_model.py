"""Metrics, retrieval, components, model, sources and streams on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import graph, metrics, model, retrieve
from lectern.sources import completions, files, mhtml
from lectern.streaming import pages as stream


def lists(spark, ranked, actual):
    r = spark.createDataFrame([("l", x, i + 1) for i, x in enumerate(ranked)], "list_id string, id string, rank int")
    a = spark.createDataFrame([("l", x) for x in actual], "list_id string, id string")
    return r, a


@pytest.mark.parametrize("ranked,actual,k,want", [
    (["a", "b", "c"], ["a", "c"], 2, (0.5, 0.5, 1 / 2, (1 + 1 / 3) / 2)),
    (["a", "b"], ["a", "b"], 10, (1.0, 0.2, 1.0, 0.75)),
    (["a", "a", "b"], ["b"], 2, (0.0, 0.0, 0.0, 1 / 3)),
    (["a"], ["z"], 1, (0.0, 0.0, 0.0, 0.0)),
    (["a"], [], 1, (0.0, 0.0, 0.0, 0.0)),
    (["a"], ["a"], 0, (0.0, 0.0, 0.0, 1.0)),
])
def test_ranking(spark, ranked, actual, k, want):
    m = metrics.ranking_metrics(*lists(spark, ranked, actual), k).first()
    assert (m.recall, m.precision, m.weighted_recall, m.mrr) == pytest.approx(want)


def test_weights(spark):
    r, a = lists(spark, ["a"], ["a", "b"])
    w = spark.createDataFrame([("l", "a", 3.0)], "list_id string, id string, weight double")
    assert metrics.ranking_metrics(r, a, 1, w).first().weighted_recall == pytest.approx(0.75)


def test_recall_grows(spark):
    r, a = lists(spark, list("abcdefghij"), list("bdfhz"))
    got = [x.recall for x in metrics.recall_curve(r, a, (1, 2, 5, 10)).orderBy("k").collect()]
    assert got == sorted(got) and got[-1] == 0.8


def test_brier(spark):
    p = spark.createDataFrame([("l", "a", 0.2, 1), ("l", "a", 1.0, 2), ("l", "b", 1.0, 3)], "list_id string, id string, p double, pos int")
    a = spark.createDataFrame([("l", "a"), ("l", "c")], "list_id string, id string")
    assert metrics.brier(p, a).first().brier == pytest.approx(2 / 3)


def test_scorecard():
    card = metrics.scorecard(5, {30: 0.71237, 10: 0.5}, 0.6, 0.1, 0.3, {"clean": 1}, ["few"])
    assert card["concept_recall"] == {"@10": 0.5, "@30": 0.7124}
    text = metrics.scorecard_text(card)
    assert "<- HEADLINE" in text and "! few" in text and "STAGE HEALTH" in text


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k_against_numpy(spark, block):
    x = np.random.default_rng(0).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    q = df.where("vec_id < 5").withColumnRenamed("vec_id", "q_id")
    got = {}
    for r in retrieve.top_k(q, df, 4, block_rows=block).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {i: np.argsort(-(u @ u[i]), kind="stable")[:4].tolist() for i in range(5)}


def test_equal_scores_go_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [1.0, 1.0]) for i in range(40)] + [(50, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = retrieve.top_k(df.where("vec_id = 1").withColumnRenamed("vec_id", "q_id"), df, 3, block_rows=6).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 3, 5]
    assert retrieve.top_k(df.limit(0).withColumnRenamed("vec_id", "q_id"), df, 3).count() == 0


def test_similar_pairs_exact_and_by_buckets(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(40, 16))
    x = np.concatenate([base, base + 0.08 * rnd.normal(size=base.shape), base[:5]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if u[i] @ u[j] > 0.92}
    exact = retrieve.similar_pairs(df, 0.92, block_rows=16).collect()
    assert len(exact) == len(want) and {(r.a, r.b) for r in exact} == want
    near = retrieve.similar_pairs(df, 0.92, tables=16, bits=8, block_rows=16).collect()
    assert {(r.a, r.b) for r in near} <= want and len(near) >= 0.9 * len(want)
    found = {r.vec_id: r.canonical for r in retrieve.deduplicate(df, 0.92).collect()}
    assert len(found) == len(x) + 2 and all(found[j] <= i for i, j in want) and found[80] == 0 and found[900] == 900


def test_repeats(spark):
    new = spark.createDataFrame([(1, "c", [1.0, 0.0], "add 2"), (2, "d", [0.0, 1.0], "x")], "qid int, concept_id string, embedding array<double>, text string")
    bank = spark.createDataFrame([(7, "c", [1.0, 0.1], "sum 2"), (8, "c", [0.0, 1.0], "no")], "qid int, concept_id string, embedding array<double>, text string")
    got = {r.qid: r.tier for r in retrieve.repeats(new, bank).collect()}
    assert got == {1: "exact", 2: "none"}


@pytest.mark.parametrize("form", [False, True])
def test_repeats_within_one_large_concept(spark, monkeypatch, form):
    """Against every earlier row, in several blocks and tiles."""
    monkeypatch.setattr(retrieve, "TILE_CELLS", 40)
    rnd = np.random.default_rng(5)
    texts = ["add 2", " add 2 ", "sum 2", "sum 3", "no", None]
    rows = [
        (i, None if i == 7 else "big" if i % 5 else f"c{i % 3}", None if i == 11 else [0.0, 0.0] if i == 13 else rnd.normal(size=2).tolist(), texts[rnd.integers(6)], ["f", "g", None][i % 3])
        for i in range(200)
    ]
    bank = spark.createDataFrame(rows, "qid long, concept_id string, embedding array<double>, text string, form string")
    got = retrieve.repeats(bank.where("qid % 4 = 0 or qid in (7, 11, 13)"), bank, 0.85, 0.92, form, block_rows=16)

    def tier(x, y):
        u, v = x[2], y[2]
        sim = np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) if u and v and any(u) and any(v) else -2
        known = x[3] is not None and y[3] is not None
        same = known and [c for c in x[3] if c.isdigit()] == [c for c in y[3] if c.isdigit()]
        if known and x[3].strip() == y[3].strip():
            return 4
        if sim >= 0.92 and same:
            return 3
        fits = not form or (known and not same and x[4] is not None and x[4] == y[4])
        return 2 if sim >= 0.85 and fits else 1

    want = {x[0]: max([tier(x, y) for y in rows if y[1] == x[1] is not None and y[0] != x[0]], default=0) for x in rows if x[0] % 4 == 0 or x[0] in (7, 11, 13)}
    assert {r.qid: r.tier_no for r in got.collect()} == want


def rows_for_model(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for week in range(4):
        for c in range(40):
            daily = float(rnd.integers(0, 3))
            rows.append((f"c{c}", week, 0.2, 1, daily, 0, 2, int(c % 2), 0, bool(c % 3), int(rnd.random() < 0.1 + 0.3 * daily)))
    return spark.createDataFrame(rows, "concept_id string, week int, posterior double, syllabus int, daily double, repeat int, weeks_since int, diff_set int, prereq int, syllabus_known boolean, label int")


def test_score_terms_sum_to_logit(spark):
    got = model.score(rows_for_model(spark)).select((F.aggregate(F.map_values("contributions"), F.lit(0.0), lambda a, x: a + x) - F.col("logit")).alias("d"), "probability").collect()
    assert all(abs(r.d) < 1e-6 and 0 < r.probability < 1 for r in got)


def test_gate(spark):
    one = rows_for_model(spark).withColumn("syllabus", F.lit(0)).withColumn("syllabus_known", F.lit(True))
    r = model.score(one).first()
    assert r.gate_factor == 0.08 and r.probability == pytest.approx(0.08 * r.p_ungated)


def test_fit_and_backtest(spark):
    data = rows_for_model(spark)
    w = model.fit(data)
    assert w["daily"] > 0.3 and model.fit(data) == w
    folds, weights, warnings = model.backtest(data, data.where("label = 1").select("week", "concept_id"), k=10)
    assert folds.count() == 4 and set(weights) == set(model.TERMS)
    _, fallback, warned = model.backtest(data.where("week = 0"), data.where("label = 1").select("week", "concept_id"))
    assert fallback == model.WEIGHTS and warned


def test_history_never_looks_ahead(spark):
    counts = spark.createDataFrame([("a", 0, 2), ("a", 2, 1), ("b", 1, 1)], "concept_id string, week int, n int")
    h = model.history(model.weekly_grid(counts, counts.select("concept_id"), counts.select("week")))
    got = {(r.concept_id, r.week): (r.n_hits, r.appeared_last, r.weeks_since, r.weekly_history) for r in h.collect()}
    assert got[("a", 0)] == (0, 0, 0, []) and got[("a", 2)] == (1, 0, 2, [1, 0]) and got[("b", 2)] == (1, 1, 1, [0, 1])


def test_completions(spark):
    from lectern.functions.messages import cache_key

    prompts = spark.createDataFrame([("p",), ("p",), ("q",), ("bad",)], "prompt string").withColumn("key", cache_key(prompt=F.col("prompt"), week=F.lit(1)))

    def client(p):
        if p == "bad":
            raise completions.HttpError(503)
        return '```json\n{"p": "%s"}\n```' % p if p == "p" else "none"

    replies, new = completions.complete(prompts, None, client, sleep=lambda s: None)
    assert new.count() == 2
    stats = completions.stats(replies).first()
    assert (stats.calls, stats.failures, stats.unreadable) == (5, 1, 1)
    again, none = completions.complete(prompts.where("prompt <> 'bad'"), new, lambda p: 1 / 0)
    assert none.count() == 0 and again.where("cached").count() == 3
    fixed = completions.repair(replies.where("error is null"), lambda p: "[]")
    assert fixed.where("needs_review").count() == 0


MHTML = (
    b"MIME-Version: 1.0\nContent-Type: multipart/related; boundary=b\n\n--b\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n"
    b'<html><head></head><div class=3D"questionBlock"><span class=3D"questionSerial">3.</span><div class=3D"questionText">caf=C3=A9 <span class=3D"pt-000012">Avb</span></div>'
    b'<div class=3D"optionText">1</div><div class=3D"optionText">2</div></div>=\n</html>\n--b\nContent-Type: text/css\n\nx{}\n--b--\n'
)


def test_mhtml(spark):
    f = spark.createDataFrame([("a.mhtml", bytearray(MHTML)), ("b", bytearray(b"junk"))], "path string, content binary")
    q = mhtml.questions(mhtml.pages(f)).collect()
    assert [(r.q_index, r.question_text, r.options) for r in q] == [(3, "café Avb", ["1", "2"])]
    assert [r.raw_bijoy for r in mhtml.legacy_strings(mhtml.questions(mhtml.pages(f))).collect()] == ["Avb"]
    assert "<style>x{}" in mhtml.pages(f, css=True).where("path = 'a.mhtml'").first().html


def test_files(spark, tmp_path):
    p = str(tmp_path / "p.jsonl")
    with open(p, "w") as f:
        f.write('{"book": "b", "page_num": 1, "text": "x"}\nbroken\n\n{"book": "b", "page_num": 1, "text": "y"}\n{"page_num": 2}\n')
    assert [(r.book, r.done) for r in files.done_pages(files.read_jsonl(spark, p, files.PAGE, tolerant=True)).collect()] == [("b", 1)]
    blocks = spark.createDataFrame([([("a", 0.9), ("b", 0.1), ("ক", 0.80004)],), ([],)], "b array<struct<text: string, confidence: double>>")
    got = [r[0] for r in blocks.select(files.ocr_text(F.col("b"))).collect()]
    assert (got[0].text, got[0].avg_confidence, got[0].has_bengali) == ("a ক", 0.85, True) and got[1].avg_confidence == 0.0
    out = str(tmp_path / "a")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    files.append_new(rows.where("k = 1"), out, ["k"])
    files.append_new(rows, out, ["k"])
    assert spark.read.json(out).count() == 2

    def open_pdf(content):
        if content == b"!":
            raise ValueError("broken")
        return content.decode().split("|")

    pages = files.pdf_pages(spark.createDataFrame([("a", bytearray(b"one|two")), ("b", bytearray(b"!"))], "path string, content binary"), open_pdf=open_pdf)
    assert [(r.path, r.text, r.header) for r in files.document_text(pages).collect()] == [("a", "one\ntwo\n", "one")]


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("b", 1, "x"), ("b", 1, "x"), ("b", 2, "y")], "book string, page_num int, text string")
    rows.write.json(src)
    arriving = stream.first_versions(stream.page_stream(spark, src).withColumn("at", F.lit("2024-01-01").cast("timestamp")), "at")
    q = stream.write_once(arriving, out, str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
