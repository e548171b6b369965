"""Line deduplication over a corpus by deletion neighbourhoods.

A line (trimmed of ASCII white space) goes when the corpus has an earlier line, by doc_id
and line number, that is equal or, for lines of ``min_chars`` code points or more, at most
one edit away (a code point changed, added or dropped). The earliest line always stays: of
lines that tie, that of the smallest doc_id and line number.

Lines are known by 64-bit hashes. Two lines one edit apart agree outside one quarter, so
lines first meet under the hash of all but a quarter. Those that meet another line there
emit their variants with one code point less inside that quarter. A changed code point
shows as equal variants of equal place, a missing one as a variant equal to a whole line;
so the earliest neighbour is a minimum within equal keys, and no pairs are listed. The edit
distance of each line and that neighbour is then verified on the texts.

Blank lines are never compared and stay where they are. Null texts have no lines. Rows with
a null doc_id are not compared and stay whole. Repeated rows have the same line numbers, so
they are changed alike; where texts differ under one doc_id, each row loses what makes sense
by its own lines. Documents that lose every non-blank line can be told by n_left = 0.
An empty table gives no rows. Other columns stay as they are, whatever their names, but for
columns named like the three counts, which deduplicate() replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.bitmap import bitmap_of, bits_for, holds
from lectern.llm.rows import numbered
from lectern.llm.words import text_column
from lectern.session import bounded_batches, discard, free_names, materialise

#: Shorter lines must be equal, as one edit makes another word of them; 1 compares lines of any length.
MIN_CHARS = 16
QUARTERS = 4
_STRIP = " \t\n\x0b\f\r"


def _hash(text: str, mark: int) -> int:
    """The mark is hashed as text: seeds of the hash function don't keep short texts apart."""
    return xxhash.xxh3_64_intdigest(b"%d\n" % mark + text.encode()) - (1 << 63)


def line_key(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def _meeting_key(line: str, j: int, short: int) -> int:
    """The mark tells quarter and length, so it also tells where the two parts meet."""
    a, b = j * short // QUARTERS, (j + 1) * short // QUARTERS
    return _hash(line[:a] + line[len(line) - (short - b) :], short * QUARTERS + j)


def meeting_keys(line: str, min_chars: int = MIN_CHARS) -> list[int]:
    """Hashes of all but one quarter, as the longer or the shorter of a pair."""
    n = len(line)
    return [_meeting_key(line, j, short) for short in (n, n - 1) if short >= max(1, min_chars) for j in range(QUARTERS)]


#: Mark of whole lines, apart from those of masked places.
_WHOLE = 1 << 40


def variant_keys(line: str, met: set[int], min_chars: int = MIN_CHARS) -> list[tuple[int, int]]:
    """(key, role) of the line's variants in quarters where it met others.

    Role 0: a place is masked; equal keys are one change apart. Role 1: the whole line;
    role 2: the line with one code point less; equal keys of roles 1 and 2 are one addition apart.
    """
    n, out = len(line), set()
    for short in (n, n - 1):
        if short < max(1, min_chars):
            continue
        for j in range(QUARTERS):
            if _meeting_key(line, j, short) not in met:
                continue
            begin, end = j * short // QUARTERS, n - (short - (j + 1) * short // QUARTERS)
            if short == n:
                out.update((_hash(line[:i] + line[i + 1 :], i), 0) for i in range(begin, end))
                out.add((_hash(line, _WHOLE), 1))
            else:
                out.update((_hash(line[:i] + line[i + 1 :], _WHOLE), 2) for i in range(begin, end))
    return list(out)


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS, row: str | None = None) -> DataFrame:
    """key, doc_id, line and the meeting keys of every non-blank line, and the row from the column ``row`` if given."""

    def split(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = text_column(batch).to_pylist()
            numbers = [(n,) for n in batch.column(2).to_pylist()] if row else [()] * len(ids)
            rows = []
            for doc_id, text, own in zip(ids, texts, numbers, strict=True):
                for i, raw in enumerate(text.split("\n")):
                    line = raw.strip(_STRIP)
                    if line:
                        rows.append((line_key(line), doc_id, i, meeting_keys(line, min_chars), *own))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())] + [pa.int64()] * bool(row)
        names = ["key", "doc_id", "line", "meets"] + ["row"] * bool(row)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text", *([F.col(row)] if row else []))
    return named.mapInArrow(split, "key long, doc_id long, line int, meets array<bigint>" + ", row long" * bool(row))


def _near_lines(docs: DataFrame, firsts: DataFrame, min_chars: int) -> DataFrame:
    """key, near: the earliest place of a line one edit away, for lines that have one.

    ``firsts`` has key, first (doc_id, line) and meets of each distinct line.
    """
    spark = docs.sparkSession
    meets = firsts.select("key", F.explode("meets").alias("meet"))
    full = meets.groupBy("meet").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("meet")
    met = materialise(meets.join(full, "meet").groupBy("key").agg(F.collect_set("meet").alias("met")))
    bits = bits_for(met.count())
    wanted = spark.sparkContext.broadcast(bitmap_of(met.select("key"), bits))

    def texts(batches):
        for batch in batches:
            keys, lines = [], []
            for text in text_column(batch).to_pylist():
                for raw in text.split("\n"):
                    line = raw.strip(_STRIP)
                    if len(line) >= min_chars:
                        keys.append(line_key(line))
                        lines.append(line)
            keep = holds(wanted.value, np.array(keys, dtype=np.int64), bits) if keys else np.zeros(0, dtype=bool)
            chosen = dict.fromkeys((k, x) for k, x, ok in zip(keys, lines, keep, strict=True) if ok)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chosen], pa.int64()), pa.array([x for _, x in chosen], pa.string())], names=["key", "text"])

    line_texts = docs.where("doc_id is not null").select("text").mapInArrow(texts, "key long, text string")
    line_texts = line_texts.groupBy("key").agg(F.min("text").alias("text"))
    held = materialise(met.join(line_texts, "key").join(firsts.select("key", "first"), "key"))

    def variants(batches):
        for batch in batches:
            rows = []
            for key, met_, text, first in zip(*(batch.column(c).to_pylist() for c in ("key", "met", "text", "first")), strict=True):
                rows += [(v, r, key, first["doc_id"], first["line"]) for v, r in variant_keys(text, set(met_), min_chars)]
                if len(rows) > 50_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    def out(rows):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["variant", "role", "key", "doc_id", "line"])

    found = held.mapInArrow(variants, "variant long, role int, key long, doc_id long, line int")
    me = F.struct("doc_id", "line", "key")
    group = W.partitionBy("variant")
    least = lambda role: F.min(F.when(F.col("role") == role, me)).over(group)
    near = F.when(F.col("role") == 0, least(0)).when(F.col("role") == 1, least(2)).otherwise(least(1))
    pairs = (
        found.withColumn("near", near).where("near is not null and near.key <> key and (near.doc_id, near.line) < (doc_id, line)")
        .groupBy("key").agg(F.min("near").alias("near"))
    )
    text_of = held.select("key", "text")
    checked = (
        pairs.join(text_of, "key")
        .join(text_of.select(F.col("key").alias("other"), F.col("text").alias("other_text")), F.col("near.key") == F.col("other"))
        .where(F.levenshtein("text", "other_text", 1) >= 0)
    )
    return checked.select("key", F.struct("near.doc_id", "near.line").alias("near"))


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, row: str | None = None) -> DataFrame:
    """doc_id (or row, from the column ``row``) and line of every line that an earlier one makes redundant."""
    bounded_batches(docs.sparkSession, 1000)
    lines = materialise(lines_of(docs, min_chars, row))
    place = F.struct("doc_id", "line")
    firsts = materialise(
        lines.groupBy("key").agg(F.min(F.struct("doc_id", "line", "meets")).alias("one"), F.count("*").alias("n"))
        .select("key", F.struct("one.doc_id", "one.line").alias("first"), "n", "one.meets")
    )
    near = materialise(_near_lines(docs, firsts, min_chars))
    stays = (
        firsts.select("key", "first", "n").join(near, "key", "left").where("n > 1 or near is not null")
        .select("key", F.least("first", F.coalesce("near", "first")).alias("earliest"))
    )
    own = "row" if row else "doc_id"
    gone = materialise(lines.drop("meets").join(stays, "key").where(F.col("earliest") < place).select(own, "line"))
    discard(lines, firsts, near)
    return gone


def _without(docs: DataFrame, min_chars: int, counts: list[str]) -> DataFrame:
    """``docs`` without redundant lines, and the columns ``counts``: non-blank lines, removed ones, those left."""
    repeated = numbered(docs, differing=True)
    rows, own = repeated or (docs, "doc_id")
    gone, key, old = free_names([*rows.columns, *counts], "_gone", "_id", "_old")
    found = removed_lines(rows, min_chars, own) if repeated else removed_lines(rows, min_chars)
    places = found.groupBy(F.col("row" if repeated else "doc_id").alias(key)).agg(F.collect_set("line").alias(gone))
    # The places that are left, by set difference, so work is linear in the lines; F.transform names the lines once.
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone))
    kept = F.transform(F.array(F.split(old, "\n")), lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x, i)), "\n"))[0]
    solid = F.regexp_count(F.coalesce(old, F.lit("")), F.lit(r"(?md)^[ \t\x0B\f\r]*[^ \t\n\x0B\f\r]")).cast("long")
    removed = F.coalesce(F.size(gone), F.lit(0)).cast("long")
    joined = rows.withColumnRenamed("text", old).join(places, F.col(own) == F.col(key), "left")
    text = F.when(F.col(gone).isNull(), F.col(old)).otherwise(kept).alias("text")
    columns = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    n_lines, n_removed, n_left = counts
    return joined.select(*columns, solid.alias(n_lines), removed.alias(n_removed)).withColumn(n_left, F.col(n_lines) - F.col(n_removed))


COUNTS = ["n_lines", "n_removed", "n_left"]


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with redundant lines taken out of text, and n_lines, n_removed and n_left (non-blank lines)."""
    others = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in COUNTS])
    return _without(others, min_chars, COUNTS)


def drop_repeated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs``, with the columns they came with, without redundant lines and without documents that these leave empty.

    A document that had no lines stays. A column n_chars follows the text where it changes.
    """
    n_lines, n_removed, n_left = free_names(docs.columns, *COUNTS)
    done = _without(docs, min_chars, [n_lines, n_removed, n_left]).where((F.col(n_removed) == 0) | (F.col(n_left) > 0))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*[f"`{c}`" for c in docs.columns])
