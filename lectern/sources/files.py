"""Readers and writers of page, chunk and question tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.session import bounded_batches, discard, file_system, materialise

PAGE = "book string, page_num int, text string, char_count int, avg_confidence double, has_bengali boolean, block_count int"
SECTION = "section_no string, section_title string, page_start int, page_end int"
CHAPTER = f"chapter_no string, chapter_title string, page_start int, page_end int, sections array<struct<{SECTION.replace(' string', ': string').replace(' int', ': int')}>>"
CHUNK = "chunk_id string, book string, section_no string, section_title string, page_start int, page_end int, chunk_type string, token_count int, text string, anchor_text string"
QUESTION = (
    "doc_id string, source_path string, exam_kind string, subject_hint string, week_index int, unique_set int, q_index int, question_text string, "
    "options array<struct<letter: string, text: string>>, math_expressions array<string>, correct_letter string"
)


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """path, modificationTime and length of files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path", "modificationTime", "length")


def read_binary(spark: SparkSession, folder: str, suffix: str, where: Column | None = None) -> DataFrame:
    """path and content; ``where`` picks paths before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return (files.where(where) if where is not None else files).select("path", "content")


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """One record a line. Strict by default; tolerant skips lines that aren't records."""
    reader = spark.read.schema(schema)
    return reader.option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document that is an array of records."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def done_pages(pages: DataFrame) -> DataFrame:
    """Finished pages of each book, counted once each."""
    return pages.where("book is not null").groupBy("book").agg(F.count_distinct("page_num").alias("done"))


def pending_pages(inventory: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of the inventory (book, page_num) that are not done yet."""
    return inventory.join(done.select("book", "page_num").distinct(), ["book", "page_num"], "left_anti")


def needs_conversion(sources: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """Sources (path, mtime) without an output (path, out_mtime) newer than they are."""
    return sources.join(outputs, "path", "left").where(F.lit(force) | F.col("out_mtime").isNull() | (F.col("out_mtime") <= F.col("mtime")))


def pdf_pages(files: DataFrame, max_pages: int | None = None, open_pdf: Callable | None = None) -> DataFrame:
    """path, page_num (from 1), page_count and text of PDF contents.

    ``open_pdf`` takes bytes and gives the texts of pages; by default an installed PDF
    library is used. Unreadable files give one row with error and no text.
    """
    def default(content: bytes) -> list[str]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            return [p.get_text() for p in doc]

    opener = open_pdf or default

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                try:
                    texts = list(opener(bytes(content.as_py())))
                    made = [(path.as_py(), i + 1, len(texts), t, None) for i, t in enumerate(texts[: max_pages or None])]
                except Exception as e:  # a broken file is a result here, not a failure
                    made = [(path.as_py(), 0, 0, None, str(e)[:500])]
                yield from made

    kinds = pa.schema([("path", pa.string()), ("page_num", pa.int32()), ("page_count", pa.int32()), ("text", pa.string()), ("error", pa.string())])
    bounded_batches(files.sparkSession, size="4m")
    return files.select("path", "content").mapInArrow(lambda batches: row_batches(rows(batches), kinds), "path string, page_num int, page_count int, text string, error string")


def row_batches(rows: Iterator[tuple], kinds: pa.Schema, most: int = 5000, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of up to ``most`` rows, each ended by the row with which its texts and contents reach ``size``."""
    made, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=kinds.names)

    for row in rows:
        made.append(row)
        held += sum(len(v) for v in row if isinstance(v, str | bytes))
        if len(made) >= most or held >= size:
            yield batch()
            made, held = [], 0
    if made:
        yield batch()


def document_text(pages: DataFrame) -> DataFrame:
    """path, text (each page and a line feed) and header (500 code points of the first page with text)."""
    order = F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text"))))
    joined = pages.where("error is null").groupBy("path").agg(order.alias("p"))
    first = F.get(F.filter("p", lambda x: F.trim(x["text"]) != ""), 0)["text"]
    return joined.select(
        "path", F.concat(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), F.lit("\n")).alias("text"),
        F.coalesce(F.substring(first, 1, 500), F.lit("")).alias("header"),
    )


def ocr_text(blocks: Column, min_confidence: float = 0.3) -> Column:
    """struct of text, avg_confidence, block_count and has_bengali from recognised blocks (text, confidence)."""
    kept = F.transform(F.filter(blocks, lambda b: b["confidence"] >= min_confidence), lambda b: F.struct(b["text"].alias("text"), F.round(b["confidence"], 4).alias("c")))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    mean = F.when(F.size(kept) > 0, F.round(F.aggregate(kept, F.lit(0.0), lambda s, b: s + b["c"]) / F.size(kept), 4)).otherwise(F.lit(0.0))
    return F.struct(text.alias("text"), mean.alias("avg_confidence"), F.size(kept).alias("block_count"), F.rlike(text, F.lit("[\\u0980-\\u09FF]")).alias("has_bengali"))


def low_confidence(pages: DataFrame, confidence: float = 0.6, chars: int = 20) -> DataFrame:
    """Pages to look at: short texts or a low mean confidence."""
    return pages.where((F.length("text") < chars) | (F.col("avg_confidence") < confidence))


def with_overrides(pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """Page texts replaced by the hand-made ones of ``overrides`` (book, page_num, override)."""
    return pages.join(overrides, ["book", "page_num"], "left").withColumn("text", F.coalesce("override", "text")).drop("override")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: str | None = None) -> None:
    """Parquet, by folders of ``by`` if given."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def low_confidence_counts(pages: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Per book: pages, and those whose mean confidence is below ``confidence``."""
    return pages.groupBy("book").agg(F.count("*").alias("pages"), F.count_if(F.col("avg_confidence") < confidence).alias("low"))


def write_document(df: DataFrame, path: str, report: dict | None = None, indent: int | None = None) -> None:
    """One JSON document: {"documents": [rows in order of all columns], "report": ...}, with ``indent`` over several lines.

    For results that people open as one file; the rows pass one task, so tables of any size
    belong into write_jsonl() or write_table().
    """
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if indent else {})
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns]))), lambda r: F.to_json(r, options))
    text = F.concat(F.lit('{"documents":['), F.array_join(rows, ",\n" if indent else ","), F.lit('],"report":' + json.dumps(report or {}, indent=indent, ensure_ascii=False) + "}"))
    df.agg(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever store."""
    files, where = file_system(spark, path)
    return bool(files.exists(where))


def write_array(df: DataFrame, path: str) -> None:
    """JSON arrays of the rows, one file a task, which read_array() reads: rows keep their place in a partition, and none pass one task."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})

    def wrap(batches):
        first = True
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([("[" if first and i == 0 else ",") + v for i, v in enumerate(values)], pa.string())], names=["value"])
            first = first and not values
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], names=["value"])

    df.select(row.alias("value")).mapInArrow(wrap, "value string").write.mode("overwrite").text(path)


def append_new(df: DataFrame, path: str, key: list[str], by: str | None = None) -> None:
    """Append the rows whose key the JSON-lines table at ``path`` lacks; of rows with one key one goes in.

    With ``by``, a column of the key, the log is kept by its values, and only the folders of those that ``df`` has are read.
    """
    spark = df.sparkSession
    df = df.dropDuplicates(key)
    if exists(spark, path):
        known = spark.read.schema(df.schema).json(path).select(*key)
        if by:
            known = known.join(F.broadcast(df.select(by).distinct()), by, "left_semi")
        df = df.join(known, key, "left_anti")
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).json(path)


def merge_increment(changes: DataFrame, path: str, key: list[str], book: str = "book", order: str | None = None, place: Column | None = None, places: int = 64) -> None:
    """Work ``changes`` into the Parquet table at ``path``: rows replace those of their key, new keys are added.

    The table is kept in folders by ``book`` (a column of the key) and ``place``, a whole number made of the key that
    deals a book into ranges (by default one of ``places`` by hash); ranges whose numbers are equal modulo ``places`` share a
    folder, so that folders, which a commit moves one by one, stay bounded in number. Only folders that the changes touch
    are read, and Spark's dynamic overwrite replaces these as a whole when the job ends, so a
    run that breaks off before leaves the table as it was, and a repeated one changes nothing.
    A change whose ``deleted`` is true takes its key out; it stays as a mark, which read_merged() leaves out. Of changes of one key
    the one of greatest ``order`` holds, and of those that tie the greatest row.
    """
    spark = changes.sparkSession
    place = F.pmod(F.xxhash64(*key) if place is None else place, F.lit(places))
    rows = changes if "deleted" in changes.columns else changes.withColumn("deleted", F.lit(False))
    rows = rows.withColumn("deleted", F.coalesce("deleted", F.lit(False))).withColumn("_place", place.cast("int"))
    whole = F.struct(*[F.col(c) for c in ([order] if order else []) + [c for c in rows.columns if c not in key]])
    last = rows.groupBy(*key).agg(F.max(F.struct(whole.alias("_w"), F.struct(*rows.columns).alias("_row"))).alias("_m")).select("_m._row.*")
    last = materialise(last)
    out = last
    if exists(spark, path):
        touched = last.select(book, "_place").distinct()
        held = spark.read.schema(last.schema).parquet(path)
        if not held.where(~F.col("_place").between(0, places - 1)).isEmpty():
            raise ValueError(f"the table at {path} was written with more places than {places}")
        match = (held[book].eqNullSafe(touched[book])) & (held["_place"] == touched["_place"])
        same = F.lit(True)
        for c in key:
            same = same & held[c].eqNullSafe(last[c])
        out = held.join(F.broadcast(touched), match, "left_semi").join(last, same, "left_anti").unionByName(last)
    dealt = out.repartition(book, "_place").sortWithinPartitions(book, "_place", *key)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(book, "_place").parquet(path)
    discard(last)


def read_merged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table that merge_increment() keeps, without deleted ones."""
    columns = [f.name for f in StructType.fromDDL(schema)]
    return spark.read.schema(f"{schema}, deleted boolean").parquet(path).where("not deleted").select(*columns)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def labelling_queue(questions: DataFrame) -> DataFrame:
    """A blank label row for each question, difficulty 3."""
    blank = F.lit("")
    return questions.select(
        F.format_string("sha1:%s:q%d", "source_file", "q_index").alias("qid"), "source_file", "q_index", blank.alias("subject"), blank.alias("concept_id"),
        F.lit(3).alias("difficulty_1_5"), F.col("question_text").alias("question_text_bn"), blank.alias("labelled_by"), blank.alias("labelled_at"),
    )


def exam_html(questions: DataFrame) -> DataFrame:
    """source_file and html: a page per exam with its questions in order and each option once."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    items = F.array_join(F.transform("options", lambda o: F.concat(F.lit("<li>"), o["letter"], F.lit(". "), esc(o["text"]), F.lit("</li>"))), "")
    block = F.concat(F.lit('<div class="question"><h3>Question '), F.col("q_index").cast("string"), F.lit("</h3><p>"), esc(F.col("question_text")), F.lit("</p><ol>"), items, F.lit("</ol></div>"))
    made = questions.select("source_file", "q_index", block.alias("block"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q_index", "block"))), lambda b: b["block"]), "\n")
    return made.groupBy("source_file").agg(F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>'), body, F.lit("</body></html>")).alias("html"))


def standalone_html(c: Column) -> Column:
    """The html as it is if it is a whole page, else wrapped into one."""
    whole = F.rlike(c, F.lit(r"(?i)<!doctype|<html"))
    return F.when(whole, c).otherwise(F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"></head><body>\n'), c, F.lit("\n</body></html>")))
