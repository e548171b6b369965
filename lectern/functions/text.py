"""Text functions as columns: token estimates, math and question signals, splitting, keywords.

Patterns run in Java's dialect with Unicode classes ((?U)), and only a line feed ends a
line ((?d)). Null texts give null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and word lists that results depend on.
CHUNK_MATH = (
    r"(?iU)\d+\s*[+\-×÷=]\s*\d+|\^[{(\[]?\d+[})\]]?|_[{(\[]?\d+[})\]]?|[∑∫∂∇√∞±]|equation|formula|theorem|lemma"
)
INLINE_MATH = (
    r"(?U)\^[({\[]?\d+[)}\]]?|_[({\[]?\d+[)}\]]?"
    r"|\\(?:frac|sqrt|sum|int|prod|lim|log|ln|sin|cos|tan|sec|csc|cot)(?:\s*\{[^}]*\})*"
    r"|[∑∫∂∇√∞±×÷≠≤≥≈∝∈∉⊂⊃∪∩∧∨¬]"
)
ANY_DIGIT = r"(?U)[\d²³¹⁰-⁹₀-₉]"
QUESTION_WORDS = "কত কোন কি কেন কী গণনা বর্ণনা তুলনা নির্ণযং প্রমাণ".split()
STOPWORDS = (
    "এবং অথবা কিন্তু তবে যে যা যার এটি এটা ও এ ঐ বা মধ্যে থেকে পর্যন্ত সম্পর্কে হয় করা হতে থাকে করে দিয়ে নিয়ে"
).split()
CHEMICAL = r"[A-Z][a-z]?\d*(?:[A-Z][a-z]?\d*)*"
HEADER_EXAM = r"(?i)EAP\s+(Daily|Weekly)\s+(MCQ|WRITTEN)\s+Exam\s+W?-?(\d+)"
HEADER_SET = r"MCQ Master Set:\s*(\d+)"
BENGALI_SECTION = r"(?:^|\n)\s*(?:নির্বাচন|বিশেষ)\s*[:.]\s*(.+)"
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"

# Letters with a capital of one code point for which Java writes several, or titles them, and their capitals.
_ONE_CAPITAL = "ß" + "".join(map(chr, [*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3]))
_CAPITALS = "ẞ" + "".join(map(chr, [*range(0x1F88, 0x1F90), *range(0x1F98, 0x1FA0), *range(0x1FA8, 0x1FB0), 0x1FBC, 0x1FCC, 0x1FFC]))
# Letters that got capitals in Unicode 16, which databases lack.
_NEW_CAPITALS = r"[\x{19B}\x{264}\x{1C8A}\x{A7CD}\x{A7DB}\x{10D70}-\x{10D85}]"

CHARS_PER_TOKEN = 4


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def upper_simple(c: Column) -> Column:
    """Upper case code point by code point, as SQL databases do: ß becomes ẞ, ligatures stay. For short texts."""
    def one(x: Column) -> Column:
        return F.when((F.length(F.upper(x)) > 1) | F.rlike(x, F.lit(_NEW_CAPITALS)), F.translate(x, _ONE_CAPITAL, _CAPITALS)).otherwise(F.upper(x))

    return F.array_join(F.transform(F.split(c, ""), one), "")


def collapse(c: Column | str) -> Column:
    """Runs of three and more line feeds become two."""
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def estimate_tokens(c: Column | str) -> Column:
    """A quarter of the code points, 1 at least."""
    c = F.col(c) if isinstance(c, str) else c
    return F.greatest(F.lit(1), F.floor(F.length(c) / CHARS_PER_TOKEN)).cast("int")


def chunk_id(book: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%04d", F.translate(book, "/ ", "__"), index.cast("int"))


def has_math(c: Column | str) -> Column:
    return F.rlike(c, F.lit(CHUNK_MATH))


def has_questions(c: Column | str) -> Column:
    return F.rlike(c, F.lit("|".join(QUESTION_WORDS)))


def has_bengali(c: Column | str) -> Column:
    return F.rlike(c, F.lit("[\\u0980-\\u09FF]"))


def difficulty(c: Column | str, signals: Column | None = None) -> Column:
    """easy below 200 code points; medium with math or a question word; hard above 800.

    ``signals`` may tell that there is math or a question word, where that is known already.
    """
    return (
        F.when(F.length(c) < 200, "easy")
        .when(has_math(c) | has_questions(c) if signals is None else signals, "medium")
        .when(F.length(c) > 800, "hard")
        .otherwise("medium")
    )


def paragraphs(c: Column | str) -> Column:
    """Non-blank pieces between empty lines, trimmed."""
    return F.filter(F.transform(F.split(c, r"\n{2,}"), strip), lambda p: p != "")


def sentences(c: Column | str) -> Column:
    """Pieces after a full stop, question or exclamation mark, danda or line feed and white space."""
    return F.split(c, r"(?U)(?<=[.!?।\n])\s+")


def lines(c: Column | str) -> Column:
    return F.transform(F.split(c, "\n"), strip)


def math_lines(c: Column | str) -> Column:
    """Trimmed lines of three code points or more with math signs, or an equals sign and a digit."""
    return F.filter(
        lines(c),
        lambda x: (F.length(x) >= 3) & (F.rlike(x, F.lit(INLINE_MATH)) | (F.contains(x, F.lit("=")) & F.rlike(x, F.lit(ANY_DIGIT)))),
    )


def words(c: Column | str) -> Column:
    """Keyword candidates in order: three Bengali or four ASCII letters at least, lower-cased, without stopwords."""
    found = F.regexp_extract_all(c, F.lit("[\\u0980-\\u09FF]{3,}|[a-zA-Z]{4,}"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.transform(found, F.lower), lambda w: ~F.array_contains(stop, w))


def number_list(c: Column | str) -> Column:
    """The numbers in a text, sorted."""
    return F.sort_array(F.regexp_extract_all(c, F.lit(r"(?U)\d+(?:\.\d+)?"), F.lit(0)))


def as_int(c: Column) -> Column:
    """An integer from ASCII or Bengali digits, null for anything else."""
    return F.expr("try_cast(null as int)") if c is None else F.translate(c, BENGALI_DIGITS, "0123456789").try_cast("int")


def extract(c: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of one of the optional patterns (chemical formulas, headers, sections)."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def cer(hypothesis: Column, reference: Column) -> Column:
    """Character error rate; null where the reference is empty."""
    return F.levenshtein(hypothesis, reference) / F.nullif(F.length(reference), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norms, F.lit(0.0))


def eta(seconds: Column) -> Column:
    """42s, 3m 20s or 2h 05m style remaining time."""
    s = F.floor(seconds).cast("int")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60).cast("int"), s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int")))
    )


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def number_math(c: Column | str, marks: Column) -> Column:
    """The text with each string of ``marks`` replaced, in order, by a numbered token."""
    return F.aggregate(
        F.transform(marks, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), c if isinstance(c, Column) else F.col(c),
        lambda t, x: F.when(
            F.instr(t, x["m"]) > 0,
            F.overlay(t, F.concat(F.lit("⟦M"), (x["i"] + 1).cast("string"), F.lit("⟧")), F.instr(t, x["m"]), F.length(x["m"])),
        ).otherwise(t),
    )
