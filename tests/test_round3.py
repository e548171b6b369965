"""What the third round's findings changed: queries at sizes or on inputs that the small tables lack."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunks, enrich, graph, retrieve
from lectern.plans import catalog
from lectern.sources import files, mhtml, ocr

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture(scope="session")
def long_book(spark, tmp_path_factory):
    """A folder whose documents are one book of 10,003 pages, a chunk each."""
    where = str(tmp_path_factory.mktemp("long"))
    made = spark.range(10_003).selectExpr("id as doc_id", "repeat('a', 1700) as text", "'en' as lang", "'b' as source", "1700L as n_chars")
    made.write.parquet(f"{where}/documents.parquet")
    return where


@pytest.mark.parametrize("name", ["atomic_chunks", "chunk_books", "chunk_sessions"])
def test_ids_past_four_digits_are_those_of_sql(spark, long_book, name):
    ids = sorted(r.chunk_id for r in catalog.QUERIES[name](spark, long_book).select("chunk_id").collect())
    assert ids == sorted(f"b_chunk_{str(i)[:4]:0>4}" for i in range(10_003))


def test_upper_case_of_every_code_point_is_that_of_sql(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(map(chr, points[i : i + 64])) for i in range(0, len(points), 64)] + ["", "straße"]
    made = [r.u for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.upper_simple(F.col("t")).alias("u")).collect()]
    assert made == [duckdb.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts]


def test_chunks_are_folded_in_small_batches(spark):
    spark.conf.set(BYTES, "64m")
    pages = spark.createDataFrame([("b", i, "word " * 500) for i in range(300)], "book string, page_num int, text string")
    made = chunks.chunk_books(pages, range_pages=16).orderBy("chunk_id").collect()
    assert spark.conf.get(BYTES) == "4m"
    # Each page is too long for a chunk and has no sentence end, so it is one.
    assert [r.chunk_id for r in made] == [f"b_chunk_{i:04d}" for i in range(300)]


REPEATED = [(1, "alpha beta Alpha", "s"), (1, "beta gamma", "s"), (None, "gamma delta", "t"), (2, None, "t"), (3, "", "s")]


def test_totals_by_source_are_sums_of_weights(spark):
    own = [(i, *r[1:]) for i, r in enumerate(REPEATED)]
    for rows in (own, REPEATED):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        plain = enrich.tf_idf(df, ["doc_id"]).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("words"), F.sum("weight").alias("weight"))
        want, got = ({r.source: (r.words, round(r.weight, 9)) for r in x.collect()} for x in (plain, enrich.tf_idf_totals(df, ["doc_id"], "source")))
        assert got == want


def test_keywords_of_texts_with_own_keys_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "beta alpha Beta gamma alpha delta"), (2, None)], "doc_id long, text string")
    top = enrich.top_keywords(df, ["doc_id"], top_n=3)
    assert "Exchange" not in top._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in top.orderBy("rank").collect()] == [(1, "beta", 2, 0, 1), (1, "alpha", 2, 1, 2), (1, "gamma", 1, 3, 3)]
    twice = enrich.top_keywords(df.unionByName(df), ["doc_id"], top_n=3)
    assert sorted((r.word, r.n) for r in twice.collect()) == [("alpha", 4), ("beta", 4), ("gamma", 2)]


@pytest.mark.parametrize("sent", [0, 1 << 18])
def test_words_of_texts_that_share_a_key_alone_are_shuffled(spark, monkeypatch, sent):
    monkeypatch.setattr(enrich, "SENT_KEYS", sent)
    rows = [*REPEATED, (1, "alpha", "s"), (None, "delta", "t"), (4, "omega omega alpha", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    own, shared = enrich._apart(df, ["doc_id"])
    assert sorted(r.doc_id for r in own.collect()) == [2, 3, 4]  # words of all eight were shuffled before
    assert sorted(r.text for r in shared.collect()) == ["alpha", "alpha beta Alpha", "beta gamma", "delta", "gamma delta"]
    top = enrich.top_keywords(df, ["doc_id"], top_n=2)
    assert "MapInArrow" in top._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.word, r.n, r.rank) for r in top.collect()} == {
        (1, "alpha", 3, 1), (1, "beta", 2, 2), (None, "delta", 2, 1), (None, "gamma", 1, 2), (4, "omega", 2, 1), (4, "alpha", 1, 2),
    }
    assert {r.doc_id: r.keywords for r in enrich.enrich(df.where("doc_id > 1"), "doc_id").collect()} == {2: [], 3: [], 4: ["omega", "alpha"]}
    assert {(r.word, r.n) for r in enrich.word_counts(df, ["doc_id"]).where("doc_id is null").collect()} == {("gamma", 1), ("delta", 2)}


@pytest.mark.parametrize("together", [1, 2, 64])
def test_few_texts_of_a_key_meet_as_texts(spark, monkeypatch, together):
    monkeypatch.setattr(enrich, "TEXTS_TOGETHER", together, raising=False)
    rows = [
        (1, "x", "alpha beta Alpha"), (1, "x", "beta gamma"), (1, "x", "gamma gamma delta"), (1, "y", "omega"), (1, None, "delta beta"), (1, None, "beta delta"),
        (None, "x", None), (None, "x", "alpha"), (2, "x", None), (2, "x", ""), (3, "x", "sigma"),
    ]
    df = spark.createDataFrame(rows, "book int, part string, text string")
    top = enrich.top_keywords(df, ["book", "part"], top_n=2)
    if together == 64:
        assert "Window" not in top._jdf.queryExecution().executedPlan().toString()  # a row for each word was shuffled twice before
    assert sorted(map(tuple, top.collect()), key=str) == sorted(
        [
            (1, "x", "gamma", 3, 0, 1), (1, "x", "alpha", 2, 0, 2), (1, "y", "omega", 1, 0, 1), (1, None, "beta", 2, 0, 1), (1, None, "delta", 2, 0, 2),
            (None, "x", "alpha", 1, 0, 1), (3, "x", "sigma", 1, 0, 1),
        ], key=str,
    )
    counts = {(r.book, r.part, r.word): (r.n, r.first_pos) for r in enrich.word_counts(df, ["book", "part"]).collect()}
    assert len(counts) == 9 and counts[1, "x", "beta"] == (2, 0) and counts[1, "x", "delta"] == (1, 2) and counts[1, None, "delta"] == (2, 0)


def test_enriched_texts_travel_with_their_keywords_only(spark):
    df = spark.createDataFrame([(1, "beta alpha Beta"), (2, None)], "doc_id long, text string")
    made = enrich.enrich(df, "doc_id").select("doc_id", "keywords", "char_count")
    assert "explode" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.keywords for r in made.collect()} == {1: ["beta", "alpha"], 2: []}


def test_enriched_texts_of_one_shared_key_leave_others_in_place(spark):
    df = spark.createDataFrame([(1, "beta alpha Beta"), (2, "gamma"), (2, "delta Gamma"), (3, None), (None, "omega")], "doc_id long, text string")
    made = enrich.enrich(df, "doc_id").select("doc_id", "keywords", "char_count")
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()  # all words were shuffled before
    rows = [(1, ["beta", "alpha"], 15), (2, ["gamma", "delta"], 5), (2, ["gamma", "delta"], 11), (3, [], None), (None, [], 5)]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(rows, key=str)


def test_enriched_texts_with_own_keys_neither_join_nor_travel(spark):
    texts = [None, "", "beta alpha Beta delta", "one two", "বাংলা omega বাংলা omega alpha", " ".join(f"word{c}{d}" for c in "abc" for d in "defghij")]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, page int")
    made = enrich.enrich(df, "doc_id", top_n=4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # keywords were gathered and joined to their texts before
    best = {i: [] for i in range(len(texts))}
    for r in enrich.top_keywords(df, ["doc_id"], top_n=4).orderBy("doc_id", "rank").collect():
        best[r.doc_id].append(r.word)
    assert {r.doc_id: r.keywords for r in made.collect()} == best
    assert best[2] == ["beta", "alpha", "delta"] and best[4] == ["বাংলা", "omega", "alpha"] and len(best[5]) == 4
    null = df.unionByName(spark.createDataFrame([(None, "omega", 9)], df.schema))  # a null key has no keywords, as by a join
    assert {r.doc_id: r.keywords for r in enrich.enrich(null, "doc_id", top_n=4).collect()} == {**best, None: []}


def test_archives_are_read_in_small_batches(spark):
    spark.conf.set(BYTES, "64m")
    raw = b"Content-Type: text/html\r\n\r\n<p>x"
    df = spark.createDataFrame([("a", bytearray(raw)), ("b", None)], "path string, content binary")
    assert {r.path: r.html for r in mhtml.pages(df).collect()} == {"a": "<p>x", "b": None}
    assert spark.conf.get(BYTES) == "2m"


def test_rows_of_many_files_share_batches():
    kinds = pa.schema([("path", pa.string()), ("page_num", pa.int32())])
    sizes = [b.num_rows for b in files.row_batches(((str(i), 1) for i in range(12_000)), kinds)]
    assert sizes == [5000, 5000, 2000]
    assert [b.num_rows for b in files.row_batches((("x" * 60, 1) for _ in range(5)), kinds, size=100)] == [2, 2, 1]


def test_images_of_many_files_and_broken_ones(spark):
    def render(content, dpi):
        if not content:
            raise ValueError("empty")
        return [content, b"two", b"three"]

    df = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray()), ("c", None)], "path string, content binary")
    made = sorted(tuple(r) for r in ocr.page_images(df, render, max_pages=2).select("path", "page_num", F.col("png").cast("string"), F.col("error").isNotNull()).collect())
    assert made == [("a", 1, "one", False), ("a", 2, "two", False), ("b", 0, None, True), ("c", 0, None, True)]


def test_links_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    links = spark.createDataFrame([(3, 1), (5, 6), (6, None)], "a long, b long").mapInArrow(count, "a long, b long")
    known = spark.createDataFrame([(3, 2), (2, 2)], "node long, component long")
    after, _ = graph.merge_components(known, links)
    assert sorted(map(tuple, after.collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    assert made.value == 3


def test_components_of_equal_and_near_vectors_in_many_blocks(spark):
    df = spark.createDataFrame([(i, [1.0, (i % 7) * 10.0]) for i in range(100)], "vec_id long, embedding array<double>")
    rows = retrieve._vectors(df, "vec_id", "embedding")
    assert retrieve._cells(rows, rows, "dim", 2).count() == 2 * 100 * retrieve.BLOCKS  # 50 copies before
    assert {r.vec_id: r.canonical for r in retrieve.deduplicate(df, 0.99999).collect()} == {i: min(i % 7, 5) for i in range(100)}


def test_copies_of_a_row_do_not_grow_with_rows(spark):
    df = spark.range(400).selectExpr("id as vec_id", "array(1.0D, id) as embedding")
    cells = retrieve._own_cells(retrieve._vectors(df, "vec_id", "embedding"), "dim", 4)
    assert cells.count() == 400 * retrieve.BLOCKS  # 100 copies before
    assert retrieve.similar_pairs(df, -2.0, block_rows=4).count() == 400 * 399 // 2


@pytest.mark.parametrize("tables", [0, 4])
def test_links_of_one_large_group_do_not_grow_with_its_pairs(spark, tables):
    df = spark.range(400).selectExpr("id as vec_id", "array(1.0D, id / 1000, if(id % 100 = 0, -1e9D, 0.0D)) as embedding")
    links = retrieve.links(df, 0.9, tables=tables, bits=2, block_rows=4).collect()
    assert len(links) <= 400 * retrieve.BLOCKS * max(1, tables)  # 78,216 pairs before
    assert all(r.a < r.b for r in links)
    names = lambda found: {(r.node, r.component) for r in graph.components(found).collect()}
    pairs = retrieve.similar_pairs(df, 0.9, tables=tables, bits=2, block_rows=4)
    assert names(retrieve.links(df, 0.9, tables=tables, bits=2, block_rows=4)) == names(pairs)
    assert {r.vec_id: r.canonical for r in retrieve.deduplicate(df, 0.9, tables=tables, bits=2).collect()} == {i: 0 if i % 100 == 0 else 1 for i in range(400)}


def test_links_to_known_rows_join_what_pairs_join(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "vec_id long, embedding array<double>")
    new, known = df.where("vec_id % 3 = 0"), df.where("vec_id % 3 <> 0")
    names = lambda found: {(r.node, r.component) for r in graph.components(found).collect()}
    for threshold in (0.9, 0.97):
        assert names(retrieve.links_to(new, known, threshold, block_rows=8)) == names(retrieve.similar_to(new, known, threshold, block_rows=8))
        assert names(retrieve.links(df, threshold, block_rows=8)) == names(retrieve.similar_pairs(df, threshold, block_rows=8))


def test_folders_of_a_merged_table_stay_bounded(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40).selectExpr("'b' as book", "id as k", "'x' as v")
    for change in (rows, rows.where("k = 13").selectExpr("book", "k", "'y' as v")):
        files.merge_increment(change, path, ["book", "k"], place=F.col("k"), places=8)
    assert len(list((tmp_path / "t" / "book=b").glob("_place=*"))) == 8
    assert {r.k: r.v for r in files.read_merged(spark, path, "book string, k long, v string").collect()} == {k: "y" if k == 13 else "x" for k in range(40)}
    with pytest.raises(ValueError, match="more places"):
        files.merge_increment(rows, path, ["book", "k"], place=F.col("k"), places=4)
