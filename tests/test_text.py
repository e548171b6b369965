"""Scalars, questions, chapters and chunks on small hand-made inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import messages, names
from lectern.functions import text as T
from lectern.operators import chunks, enrich, questions


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize("text,math", [("1 + 2", True), ("x^2", True), ("a_1", True), ("A Theorem", True), ("∑", True), ("x = y", False), ("১ + ২", True), ("", False)])
def test_has_math(spark, text, math):
    assert one(spark, T.has_math("t"), t=text) is math


@pytest.mark.parametrize("text,level", [("short", "easy"), ("w " * 150, "medium"), ("w " * 500, "hard"), ("w " * 500 + "1+1", "medium"), ("w " * 500 + "কেন", "medium")])
def test_difficulty(spark, text, level):
    assert one(spark, T.difficulty("t"), t=text) == level


def test_tokens_and_ids(spark):
    assert [one(spark, T.estimate_tokens("t"), t=x) for x in ("", "abcd", "a" * 9)] == [1, 1, 2]
    assert one(spark, T.chunk_id(F.col("b"), F.col("i")), b="a b/c", i=7) == "a_b_c_chunk_0007"


def test_bengali_digits(spark):
    assert one(spark, T.as_int(F.col("t")), t="১২") == 12
    assert one(spark, T.as_int(F.col("t")), t="x") is None


@pytest.mark.parametrize("name,kind", [
    ("W-01 written.pdf", "weekly_written"), ("C1 written.pdf", "daily_written"), ("Weekly MCQ 3.pdf", "weekly_mcq"), ("C1 MCQ 1.pdf", "daily_mcq"),
    ("M1 diff set.pdf", "daily_mcq"), ("diff 2.pdf", "diff_set"), ("x.pdf", "weekly_mcq"),
])
def test_exam_kind(spark, name, kind):
    assert one(spark, names.exam_kind(F.col("t")), t=name) == kind


def test_names(spark):
    assert one(spark, names.subject(F.col("t")), t="weeklies/Chem/M1.pdf") == "Math"
    assert one(spark, names.labelling_subject(F.col("t")), t="chem and phys") == "Physics"
    assert one(spark, names.week(F.col("t")), t="a/Week12/b") == 12
    assert one(spark, names.set_number(F.col("t")), t="MCQ 4.pdf") == 4
    assert one(spark, names.subject_from_header(F.col("t"), F.lit("x")), t="Higher Mathematics (2)") == "Math"
    assert one(spark, names.output_path(F.col("t"), "out/"), t="a/b.mhtml") == "out/a/b.pdf"
    assert one(spark, names.basename(F.col("t")), t="a\\b/c.json") == "c.json"


EXAM = "head\nQuestion 1\nWhat is x^2?\n\n\n\nPick.\nA\n3\nB\n4\nC\n5\nD\n6\nSolution:\nas x = 2\nE\nstray\nQuestion 2\nNo options here\nQuestion 0\nbad"


def test_questions(spark):
    df = spark.createDataFrame([(1, EXAM), (2, "none"), (3, None)], "doc int, text string")
    got = questions.extract_questions(df).orderBy("doc", "q_index").collect()
    assert [(r.q_index, r.valid) for r in got] == [(0, False), (1, True), (2, True)]
    first = got[1]
    assert first.question_text == "What is x^2?\n\nPick."
    assert [(o.letter, o.text) for o in first.options] == [("A", "3"), ("B", "4"), ("C", "5"), ("D", "6"), ("E", "stray")]
    assert first.math_expressions == ["What is x^2?", "as x = 2"]
    assert got[2].options == []


def test_ingest_skips_reports_and_names(spark):
    files = spark.createDataFrame([("week1/C1 MCQ 1.pdf", EXAM), ("diff.pdf", EXAM), ("r.pdf", "Accuracy: 3\n" + EXAM)], "path string, text string")
    good, bad = questions.ingest(files)
    assert (good.count(), bad.count()) == (2, 1)
    total = questions.ingest_report(good, ["source_path"]).where("source_path is null").first()
    assert (total.total_questions, total.questions_with_options, total.questions_missing_options) == (2, 1, 1)


def page(spark, rows):
    return spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(rows)], "book string, page_num int, text string")


def test_chapters(spark):
    pages = page(spark, ["before", "Chapter 1 Start\n1.1 a\n1.2.3 b", "more", "x\nঅধ্যায় ২ নাম\nChapter 9", "PART IV end", "last"])
    got = chunks.detect_chapters(pages).orderBy("page_start").collect()
    assert [(c.chapter_no, c.page_start, c.page_end) for c in got] == [("1", 2, 3), ("২", 4, 4), ("IV", 5, 6)]
    assert [c.chapter_title for c in got] == ["Chapter 1 Start", "অধ্যায় ২ নাম", "PART IV end"]
    assert [s.section_no for s in got[0].sections] == ["1.1", "1.2.3"]
    whole = chunks.detect_chapters(page(spark, ["a", "b"])).collect()
    assert [(c.chapter_no, c.chapter_title, c.page_start, c.page_end) for c in whole] == [("1", "b", 1, 2)]


def test_chunks_by_chapter_drop_early_pages(spark):
    pages = page(spark, ["early", "Chapter 1\nx", "y"])
    made = chunks.chunk_books(pages, chunks.detect_chapters(pages)).collect()
    assert [(r.chunk_id, r.text, r.anchor_text) for r in made] == [("b_chunk_0000", "Chapter 1\nx\n\ny", "b ")]


def brute(text, limit, overlap):
    """An independent model of the greedy fold, unit by unit."""
    size = lambda s: max(1, len(s) // 4)
    if size(text) <= limit:
        return [text]
    units = []
    for p in (x.strip() for x in re.split(r"\n{2,}", text)):
        if p and size(p) <= limit:
            units.append((p, "\n\n", False))
        elif p:
            units += [(s, " ", i == 0) for i, s in enumerate(re.split(r"(?<=[.!?।\n])\s+", p))]
    out, cur = [], ""
    for piece, glue, breaks in units:
        if not breaks and size(cur) + size(piece) <= limit:
            cur = cur + glue + piece if cur else piece
        else:
            out += [cur] if cur else []
            cur = piece
    out += [cur] if cur else []
    made = out[:1]
    for before, chunk in zip(out, out[1:]):
        tail = before[-4 * overlap :]
        cut = next((tail.find(s) for s in "\n ।" if tail.find(s) > 0), -1)
        made.append(tail[cut + 1 :] + " " + chunk if len(before) > 4 * overlap else chunk)
    return made


@pytest.mark.parametrize("limit", [5, 50, 500])
def test_chunks_match_model(spark, limit):
    rnd = random.Random(limit)
    texts = ["", "   ", "a" * 2003, "a" * 2004]
    for _ in range(25):
        words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "", ".", "!", "।", "\n", "\n\n", ".\n\n\n"]) for _ in range(rnd.randint(1, 900))]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = {i: brute(t, limit, 100) for i, t in enumerate(texts)}
    native = {r.i: r.c for r in df.select("i", chunks.chunk_column(F.col("text"), limit).alias("c")).collect()}
    assert native == want
    streamed = {}
    for r in chunks.chunk_pages(df.withColumn("n", F.lit(1)), ["i"], "n", limit).orderBy("i", "piece").collect():
        streamed.setdefault(r.i, []).append(r.text)
    assert streamed == want


def atoms(text, limit):
    """Units of a text whose examples stay whole: (text, glue, begins a chunk, ends it)."""
    size = lambda s: max(1, len(s) // 4)
    ps = [x.strip() for x in re.split(r"\n{2,}", text) if x.strip()]
    blocks = []
    for p in ps:
        goes_on = re.match(r"(?i)\s*(solution\b|answer\b|=)", p)
        if blocks and blocks[-1][0] and goes_on:
            blocks[-1][1].append(p)
        else:
            blocks.append((bool(re.match(r"(?i)\s*(example|exercises?)\b", p)), [p]))
    out = []
    for example, block in blocks:
        if size("\n\n".join(block)) <= limit:
            out.append(("\n\n".join(block), "\n\n", False, False))
            continue
        cut = [(s, " " if i else "\n\n") for p in block for i, s in enumerate(re.split(r"(?<=[.!?।\n])\s+", p))]
        out += [(s, g, i == 0, example and i == len(cut) - 1) for i, (s, g) in enumerate(cut)]
    return out


def brute_atoms(text, limit):
    size = lambda s: max(1, len(s) // 4)
    if size(text) <= limit:
        return [text]
    out, cur = [], ""
    for piece, glue, breaks, ends in atoms(text, limit):
        if not breaks and cur and size(cur) + size(piece) <= limit:
            cur += glue + piece
        else:
            out += [cur] if cur else []
            cur = piece
        if ends:
            out, cur = [*out, cur], ""
    return out + ([cur] if cur else [])


@pytest.mark.parametrize("limit,range_pages,atomic", [(5, 1, False), (40, 1, False), (40, 3, True), (12, 1, True), (500, 7, False), (40, 1000, True)])
def test_ranges_fold_as_one(spark, limit, range_pages, atomic):
    """Chunks don't depend on how pages are dealt into ranges, and examples stay whole, also over pages."""
    rnd = random.Random(limit + range_pages)
    starts = ["", "", "", "Example 1. ", "Solution: ", "Exercise ", "= ", "ANSWER ", "exam "]
    books = {}
    for b in range(12):
        pages = []
        for _ in range(rnd.choice([0, 1, 2, 9, 40])):
            ps = [rnd.choice(starts) + " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "", ".", "\n"]) for _ in range(rnd.choice([1, 5, 30, 60]))) for _ in range(rnd.choice([0, 1, 2, 5]))]
            pages.append("\n\n".join(ps))
        books[None if b == 3 else f"b{b}"] = pages
    rows = [(b, i + 1, t if t or i % 2 else None) for b, pages in books.items() for i, t in enumerate(pages)]
    df = spark.createDataFrame(rows, "book string, page_num int, text string").repartition(4)
    got = {}
    for r in chunks.chunk_pages(df, ["book"], "page_num", limit, 10, atomic=atomic, range_pages=range_pages).orderBy("piece").collect():
        got.setdefault(r.book, []).append(r.text)
        assert r.piece == len(got[r.book]) - 1
    for b, pages in books.items():
        if not pages:
            continue
        text = "\n\n".join(pages)
        if max(1, len(text) // 4) <= limit and atomic:
            assert re.sub(r"\s+", " ", got[b][0]).strip() == re.sub(r"\s+", " ", text).strip()
            continue
        if not atomic:
            assert got[b] == brute(text, limit, 10), b
            continue
        raw = brute_atoms(text, limit)
        want = raw[:1]
        for before, chunk in zip(raw, raw[1:]):
            tail = before[-40:]
            cut = next((tail.find(s) for s in "\n ।" if tail.find(s) > 0), -1)
            want.append(tail[cut + 1 :] + " " + chunk if len(before) > 40 else chunk)
        assert got[b] == want, b


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Beta alpha beta gamma এবং alpha বাংলা abc"), (2, "")], "k int, text string")
    got = {r.chunk: r.keywords for r in enrich.enrich(df.withColumnRenamed("k", "chunk"), "chunk").collect()}
    assert got == {1: ["beta", "alpha", "gamma", "বাংলা"], 2: []}


@pytest.mark.parametrize("reply,found", [('{"a": 1}', '{"a": 1}'), ('x ```json\n[1]\n``` y', "[1]"), ('so {"a": {"b": 2}} ok', '{"a": {"b": 2}}'), ("s [1, 2] e", "[1, 2]"), ("no", None), ("", None)])
def test_json_reply(spark, reply, found):
    assert one(spark, messages.json_reply("t"), t=reply) == found


def test_prompt(spark):
    df = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, "system", "a"), (1, 2, "tool", "z"), (1, 3, "assistant", "c")], "conv_id int, turn int, role string, text string")
    assert messages.prompts(df).first().prompt == "[System]: a\n\nb\n\n[Assistant]: c"


def test_number_math_and_nfc(spark):
    assert one(spark, T.number_math("t", F.array(F.lit("x^2"), F.lit("y"))), t="a x^2 y") == "a ⟦M1⟧ ⟦M2⟧"
    assert one(spark, T.nfc("t"), t="é") == "é"
