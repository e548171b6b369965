"""Questions from exam texts: split, options, stem, math; and the ingest report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import names, text

# Fixed values.
MARKER = r"(?U)^Question\s+(\d+)\s*"
LETTERS = "ABCDE"
_SPLIT = r"(?mUd)(?=^Question\s+\d+\s*$)"
_OPTION = r"(?mUd)(?=^[A-E]\s*$)"
_SOLUTION = r"(?md)^Solution:"


def question_slices(c: Column | str) -> Column:
    """Array of (number, raw) from each marker line to the next; text before the first is dropped."""
    slices = F.filter(F.split(c, _SPLIT), lambda x: F.rlike(x, F.lit(r"(?mUd)\AQuestion\s+\d+\s*$")))
    return F.transform(slices, lambda x: F.struct(text.as_int(F.regexp_extract(x, MARKER, 1)).alias("index"), x.alias("raw")))


def options(raw: Column) -> Column:
    """Array of (letter, text): from each single-letter line to the next, cut at a solution, blank ones dropped."""
    pieces = F.filter(F.split(raw, _OPTION), lambda x: F.rlike(x, F.lit(r"(?mUd)\A[A-E]\s*$")))
    body = lambda x: text.strip(F.element_at(F.split(F.substring(x, 2, 1 << 30), _SOLUTION, 2), 1))
    made = F.transform(pieces, lambda x: F.struct(F.substring(x, 1, 1).alias("letter"), body(x).alias("text")))
    return F.filter(made, lambda o: o["text"] != "")


def stem(raw: Column) -> Column:
    """Text after the marker up to the first option or solution, trimmed."""
    rest = F.regexp_replace(raw, r"(?mUd)\A" + MARKER[5:].replace("(", "(?:", 1) + "$", "")
    head = F.element_at(F.split(rest, r"(?mUd)^[A-E]\s*$|^Solution:", 2), 1)
    return text.collapse(text.strip(head))


def extract_questions(docs: DataFrame, body: str = "text") -> DataFrame:
    """One row per question of ``docs`` with q_index, question_text, options, math_expressions and valid.

    Question numbers below 1 and empty stems break the record's constraints: valid is false.
    """
    one = docs.withColumn("_q", F.explode(question_slices(body)))
    raw = F.col("_q.raw")
    return (
        one.select(
            *[c for c in docs.columns if c != body],
            F.col("_q.index").alias("q_index"), stem(raw).alias("question_text"), options(raw).alias("options"),
            text.math_lines(raw).alias("math_expressions"),
        )
        .withColumn("valid", F.coalesce((F.col("q_index") >= 1) & (F.col("question_text") != ""), F.lit(False)))
    )


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions, and rows that break a constraint, of ``files`` (path, text).

    Left-out names and performance reports don't count as seen.
    """
    name = names.basename(F.col("path"))
    seen = files.where(names.is_ingested(name) & ~names.is_report(F.col("text")))
    documents = seen.select(
        names.doc_id(F.col("path")).alias("doc_id"), F.col("path").alias("source_path"), names.exam_kind(name).alias("exam_kind"),
        names.subject_from_header(F.substring("text", 1, 500), F.col("path")).alias("subject_hint"),
        names.week(F.col("path")).alias("week_index"), names.set_number(name).alias("unique_set"), "text",
    )
    found = extract_questions(documents)
    return found.where("valid").drop("valid"), found.where("not valid").drop("valid")


def file_report(files: DataFrame, found: DataFrame, enough: int = 4) -> DataFrame:
    """path, status (skipped, failed or ok), questions and with_options of each of ``files`` (path, text; null text: unreadable).

    ``found`` are the questions of ingest(). Left-out names and performance reports are skipped.
    """
    name = names.basename(F.col("path"))
    skipped = ~names.is_ingested(name) | F.coalesce(names.is_report(F.col("text")), F.lit(False))
    status = F.when(skipped, "skipped").when(F.col("text").isNull(), "failed").otherwise("ok")
    per = found.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("questions"), F.count_if(F.size("options") >= enough).alias("with_options"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.select("path", status.alias("status")).join(per, "path", "left").select("path", "status", zero("questions"), zero("with_options"))


def ingest_totals(report: DataFrame) -> DataFrame:
    """One row: files_seen (without skipped ones), files_ok, files_failed and the sums over questions of file_report()."""
    n = lambda s: F.count_if(F.col("status") == s)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return report.agg(
        F.count_if(F.col("status") != "skipped").alias("files_seen"), n("ok").alias("files_ok"), n("failed").alias("files_failed"),
        total("questions").alias("total_questions"), total("with_options").alias("questions_with_options"),
        (total("questions") - total("with_options")).alias("questions_missing_options"),
    )


def ingest_report(questions: DataFrame, by: list[str], enough: int = 4) -> DataFrame:
    """Questions with and without enough options, for each prefix of ``by`` and in total (nulls)."""
    full = F.size("options") >= enough
    return questions.rollup(*by).agg(
        F.count("*").alias("total_questions"), F.count_if(full).alias("questions_with_options"),
        F.count_if(~full).alias("questions_missing_options"),
    )
