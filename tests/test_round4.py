"""What the fourth round's findings changed: chapters of tables that differ from the small ones, and of long books."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.operators import chunks
from lectern.plans import catalog

SCHEMA = "doc_id long, text string, lang string, source string"


def same_as_sql(spark, where, rows, names=("chunk_sessions",)):
    """Both results of each query on documents of these rows, sorted."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{where}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet/*.parquet'")
    for name in names:
        made = catalog.QUERIES[name](spark, str(where))
        want = con.execute(catalog.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, made.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str), name


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdé", k=5)) for _ in range(n)) + "."


def test_sessions_of_repeated_ids(spark, tmp_path):
    """Each document is a page once, though its doc_id stands in other sources and in copies too."""
    rng = random.Random(1)
    rows = [(i, " ".join(sentence(rng, 9) for _ in range(rng.choice((1, 9, 60)))), rng.choice("ef"), s) for s in ("a b", "c/d") for i in range(60)]
    same_as_sql(spark, tmp_path, [*rows, *rows[::3], *rows[::3]], ("chunk_sessions", "chapter_sessions", "interval_join", "chunk_books"))


def test_sessions_that_fit_one_chunk_are_folded_as_in_sql(spark, tmp_path):
    """Blank pages, white space around pages and a page of one character after 500 tokens."""
    kinds = {
        "e": ["  x y\n", "", " \n\t", "z"], "f": ["a" * 1000, "b" * 998, "c"], "g": ["", " "], "h": ["k" * 2000, "", "m"], "i": ["", "n" * 2000, "p"],
    }
    pages = [(t, lang) for lang in "efghigfhe" for t in kinds[lang]]
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate(pages)] + [(i, t, "e", "short") for i, t in enumerate([" a", "", "b "])] + [(0, " ", "e", "blank")]
    same_as_sql(spark, tmp_path, rows, ("chunk_sessions", "chunk_books"))


def test_sessions_of_missing_values(spark, tmp_path):
    """Null langs begin, end and fill books; null texts, ids and sources."""
    langs = {"a": [None, None, "e", "e"], "b": [None, "e", "f", None, "f", "e"], "c": [None, None], "d": ["e", None, "f"], "e": ["e", None, "e", None], "f": ["e", "f", "f", None]}
    rows = [(i, f"{s} {i}. " * 300, lang, s) for s, all_ in langs.items() for i, lang in enumerate(all_)]
    same_as_sql(spark, tmp_path, [*rows, (None, "last", "g", "f"), (9, None, "h", "f"), (3, "nowhere", "e", None)])


def test_sessions_longer_than_a_range(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.choice((1, 20, 700))), "e" if i % 400 < 300 else "f" if i % 2 else "g", "s") for i in range(1200)]
    same_as_sql(spark, tmp_path, rows)


def test_groups_in_one_range_are_folded_at_once(spark):
    """The same chunks with and without the note that a group lies in one range."""
    rng = random.Random(3)
    rows = [(g, p, " ".join(sentence(rng, rng.randint(1, 30)) for _ in range(rng.choice((0, 1, 40))))) for g in range(30) for p in range(8 * g, 8 * g + rng.randint(1, 8))]
    pages = spark.createDataFrame(rows, "g int, page_num int, text string")
    for kept in (True, False):
        apart, at_once = (chunks.chunk_pages(pages, ["g"], max_tokens=60, overlap_tokens=10, range_pages=8, short_whole=kept, in_one=x).collect() for x in (None, F.lit(True)))
        assert sorted(map(tuple, apart)) == sorted(map(tuple, at_once))


def ranges_and_pages(spark):
    rng = random.Random(4)
    starts = [rng.randint(-500, 30_000) for _ in range(300)]
    ranges = [(b, s, s + int(10 ** rng.uniform(0, 4.5)) if s % 9 else None, i) for i, s in enumerate(starts) for b in "ab"]
    ranges += [("a", -(10**12), 10**12, 1000), ("a", 5, 4, 1001), ("b", None, 7, 1002), (None, 1, 9, 1003), ("c", 0, 2**50, 1004)]
    pages = [(b, p) for b in "abd" for p in range(-600, 40_000, 7)] + [("a", 10**12), ("a", None), (None, 3), ("c", 2**50), ("c", 2**50 + 1)]
    return spark.createDataFrame(ranges, "book string, page_start long, page_end long, idx int"), spark.createDataFrame(pages, "book string, page_num long")


def test_pages_meet_all_ranges_that_hold_them(spark):
    ranges, pages = ranges_and_pages(spark)
    want = pages.join(
        ranges.withColumnRenamed("book", "b"), F.col("book").eqNullSafe(F.col("b")) & F.col("book").isNotNull() & F.col("page_num").between(F.col("page_start"), F.coalesce("page_end", "page_start"))
    )
    made = chunks.pages_in_ranges(pages, ranges)
    assert made.columns == ["book", "page_num", "page_start", "page_end", "idx"]
    assert sorted(map(tuple, made.select("book", "page_num", "idx").collect())) == sorted(map(tuple, want.select("book", "page_num", "idx").collect()))


def test_no_ranges_hold_no_pages(spark):
    ranges, pages = ranges_and_pages(spark)
    assert chunks.pages_in_ranges(pages, ranges.where("idx < 0")).count() == 0


@pytest.mark.parametrize("n", [2_000, 8_000])
def test_pages_are_compared_with_ranges_near_them_only(spark, n):
    """A range a page: those that share the keys of the join with a page are bounded, however long the book."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        book = spark.range(n).select(F.lit("b").alias("book"), F.col("id").alias("page_num"))
        ranges = book.select("book", F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"))
        plan = chunks.pages_in_ranges(book, ranges)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    keys = next(x for x in plan.splitlines() if "Join" in x)
    assert "_bin" in keys and "_level" in keys
