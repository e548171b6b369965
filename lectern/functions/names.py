"""Facts that file names and paths tell, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _has(c: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(F.lower(c), F.lit(p))
    return out


def exam_kind(name: Column) -> Column:
    """Kind of exam by the first rule that holds; weekly_mcq by default."""
    weekly = _has(name, "weekly", "w-")
    return (
        F.when(_has(name, "written"), F.when(weekly, "weekly_written").otherwise("daily_written"))
        .when(_has(name, "mcq", "set"), F.when(weekly, "weekly_mcq").otherwise("daily_mcq"))
        .when(_has(name, "diff"), "diff_set")
        .otherwise("weekly_mcq")
    )


def subject(path: Column) -> Column:
    """Math before Chemistry before Physics; the empty string if none shows."""
    return (
        F.when(_has(path, "math", "m1", "m2"), "Math")
        .when(_has(path, "chem", "c1", "c2"), "Chemistry")
        .when(_has(path, "phys", "p1", "p2"), "Physics")
        .otherwise("")
    )


def subject_from_header(text: Column, path: Column) -> Column:
    """The subject a header names, else that of the path."""
    name = F.lower(F.regexp_extract(text, r"(?iU)(Higher Mathematics|Physics|Chemistry)\s*\((\d+)\)", 1))
    found = F.when(name == "higher mathematics", "Math").when(name == "physics", "Physics").when(name == "chemistry", "Chemistry")
    return F.coalesce(found, subject(path))


def week(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?i)week(\d+)", 1), F.lit("")).try_cast("int")


def set_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?i)(?:MCQ|WRITTEN|set)\s*(\d+)", 1), F.lit("")).try_cast("int")


def labelling_kind(name: Column) -> Column:
    """The labelling tool's own rule: weekly, then daily kinds, then unknown."""
    return (
        F.when(_has(name, "weekly"), "weekly")
        .when(_has(name, "mcq"), "daily_mcq")
        .when(_has(name, "written"), "daily_written")
        .otherwise("unknown")
    )


def labelling_subject(name: Column) -> Column:
    """The labelling tool's own rule, which tests Physics first."""
    return (
        F.when(_has(name, "phys", "p1", "p2"), "Physics")
        .when(_has(name, "chem", "c1", "c2"), "Chemistry")
        .when(_has(name, "math", "m1", "m2"), "Math")
        .otherwise("Unknown")
    )


def is_ingested(name: Column) -> Column:
    """Difference sets and written papers are left out."""
    return ~_has(name, "diff", "written")


def is_report(text: Column) -> Column:
    """Performance reports, told by the first 500 code points."""
    return F.rlike(F.substring(text, 1, 500), F.lit(r"(?iU)Obtained Marks|Accuracy:|MCQ Obtained|Correct:\s*\d+,\s*Incorrect"))


def doc_id(relative_path: Column) -> Column:
    """sha1: and twelve hex digits of the path with forward slashes."""
    return F.concat(F.lit("sha1:"), F.left(F.sha1(F.translate(relative_path, "\\", "/")), F.lit(12)))


def question_id(doc: Column, index: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.left(F.sha1(F.concat(doc, index.cast("string"))), F.lit(12)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def output_path(path: Column, out: str, suffix: str = ".pdf") -> Column:
    """The mirrored path below ``out`` with another suffix."""
    return F.concat(F.lit(out.rstrip("/") + "/"), F.regexp_replace(path, r"\.[^./]*$", suffix))
