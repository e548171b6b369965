"""Chapters of books and token-bounded, overlapping chunks of their texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lectern.functions import text as T
from lectern.session import bounded_batches, discard, materialise

MAX_TOKENS = 500
OVERLAP_TOKENS = 100

# Chapter and section markers, at the start of a page or after a line feed.
CHAPTER_BN = r"(?iUd)(?:^|\n)\s*(?:অধ্যায়|ধাপ|পর্ব|ভাগ)\s*(\d+)"
CHAPTER_EN = r"(?iUd)(?:^|\n)\s*(?:(?:Chapter|Unit)\s+(\d+)|PART\s+([IVXLC]+))"
SECTION = r"(?iUd)(?:^|\n)\s*(\d+\.\d+(?:\.\d+)?)"


def with_markers(pages: DataFrame) -> DataFrame:
    """``pages`` with the number and the line of a chapter marker, null without one; Bengali goes first."""
    found = F.when(F.rlike("text", F.lit(CHAPTER_BN)), F.struct(
        F.regexp_extract("text", CHAPTER_BN, 1).alias("no"), F.regexp_extract("text", CHAPTER_BN, 0).alias("hit"), F.regexp_instr("text", F.lit(CHAPTER_BN)).alias("at"),
    )).when(F.rlike("text", F.lit(CHAPTER_EN)), F.struct(
        F.coalesce(F.nullif(F.regexp_extract("text", CHAPTER_EN, 1), F.lit("")), F.regexp_extract("text", CHAPTER_EN, 2)).alias("no"),
        F.regexp_extract("text", CHAPTER_EN, 0).alias("hit"), F.regexp_instr("text", F.lit(CHAPTER_EN)).alias("at"),
    ))
    lead = F.length(F.regexp_extract(F.col("_m.hit"), r"(?U)^\s*", 0))
    line = F.expr("substring(text, _m.at + _lead)")
    return (
        pages.withColumn("_m", found).withColumn("_lead", lead)
        .withColumn("chapter_no", F.col("_m.no"))
        .withColumn("chapter_title", F.when(F.col("_m").isNotNull(), T.strip(F.substring_index(line, "\n", 1))))
        .drop("_m", "_lead")
    )


def detect_chapters(pages: DataFrame, is_marker: Column | None = None) -> DataFrame:
    """book, chapter_no, chapter_title, page_start, page_end and sections of each chapter.

    A marker opens a chapter that ends before the next marker's page; pages before a book's
    first marker belong to none; a book without markers is one chapter "1" of its name.
    """
    marked = with_markers(pages)
    if is_marker is not None:
        marked = marked.withColumn("chapter_title", F.when(is_marker, F.coalesce("chapter_title", F.lit("")))).withColumn(
            "chapter_no", F.when(is_marker, F.coalesce("chapter_no", F.lit("")))
        )
    opens = F.col("chapter_title").isNotNull() if is_marker is None else F.coalesce(is_marker, F.lit(False))
    order = W.partitionBy("book").orderBy("page_num").rowsBetween(W.unboundedPreceding, 0)
    numbered = marked.withColumn("chapter_idx", F.count_if(opens).over(order))
    numbered = numbered.withColumn("sections", F.transform(
        F.filter(F.regexp_extract_all("text", F.lit(SECTION), F.lit(1)), lambda s: F.length(s) < 100),
        lambda s: F.struct(s.alias("section_no"), s.alias("section_title"), F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end")),
    ))
    first = lambda c: F.min_by(c, "page_num")
    spans = numbered.groupBy("book", "chapter_idx").agg(
        first(F.col("chapter_no")).alias("chapter_no"), first(F.col("chapter_title")).alias("chapter_title"),
        F.min("page_num").alias("page_start"), F.max("page_num").alias("last"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "sections"))), lambda p: p["sections"])).alias("sections"),
    )
    following = F.lead("page_start").over(W.partitionBy("book").orderBy("chapter_idx"))
    whole = (F.col("chapter_idx") == 0) & (F.count("*").over(W.partitionBy("book")) == 1)
    return (
        spans.withColumn("page_end", F.coalesce(following - 1, F.col("last"))).withColumn("whole", whole)
        .where("chapter_idx > 0 or whole")
        .select(
            "book", F.greatest("chapter_idx", F.lit(1)).cast("int").alias("chapter_idx"),
            F.when(F.col("whole"), "1").otherwise(F.col("chapter_no")).alias("chapter_no"),
            F.when(F.col("whole"), F.col("book")).otherwise(F.col("chapter_title")).alias("chapter_title"),
            "page_start", "page_end", F.when(F.col("whole"), F.slice("sections", 1, 0)).otherwise(F.col("sections")).alias("sections"), "whole",
        )
    )


def uniform_chapters(pages: DataFrame, n: int) -> DataFrame:
    """``n`` chapters of equal page counts per book, for books without headings."""
    tile = F.ntile(n).over(W.partitionBy("book").orderBy("page_num"))
    return pages.withColumn("chapter_idx", tile).groupBy("book", "chapter_idx").agg(F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"))


def check_sections(sections: DataFrame, max_chars: int = 20_000, least: int = 10, most: int = 80) -> DataFrame:
    """Per book: gaps, overlaps, oversize sections and whether their number is plausible.

    ``sections`` has book, page_start, page_end and char_count.
    """
    after = F.lead("page_start").over(W.partitionBy("book").orderBy("page_start", "page_end"))
    return (
        sections.withColumn("after", after).groupBy("book").agg(
            F.count("*").alias("sections"), F.count_if(F.col("after") > F.col("page_end") + 1).alias("gaps"),
            F.count_if(F.col("after") <= F.col("page_end")).alias("overlaps"), F.count_if(F.col("char_count") > max_chars).alias("oversize"),
        )
        .withColumn("ok", (F.col("gaps") == 0) & (F.col("overlaps") == 0) & (F.col("oversize") == 0) & F.col("sections").between(least, most))
    )


def pages_in_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Interval join within a book, bounds included; pages outside all ranges drop out, overlaps repeat.

    Pages and ranges meet in bins of BIN_PAGES page numbers, so a page is compared with the ranges of its bin, not
    with all of its book. Ranges longer than BINS bins go to bins BINS times as wide, and so on; pages
    are repeated only for the widths that some range has.
    """
    r = ranges.withColumnRenamed("book", "_book").withColumn("page_end", F.coalesce("page_end", "page_start")).where("page_end >= page_start")
    wide = [BIN_PAGES * BINS**k for k in range(9)]
    longer = [(F.col("page_end") - F.col("page_start") >= F.lit(BINS * w)).cast("int") for w in wide[:-1]]
    r = materialise(r.withColumn("_level", sum(longer, F.lit(0))))
    levels = [x[0] for x in r.select("_level").distinct().collect()] or [0]  # nine at most
    width = F.element_at(F.array(*map(F.lit, wide)), F.col("_level") + 1)
    spread = r.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("page_start") / width), F.floor(F.col("page_end") / width))))
    bins = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col("page_num") / wide[k]).alias("bin")) for k in levels])
    met = pages.withColumn("_at", F.explode(bins)).join(
        spread, (F.col("book") == F.col("_book")) & (F.col("_at.k") == F.col("_level")) & (F.col("_at.bin") == F.col("_bin")) & F.col("page_num").between(F.col("page_start"), F.col("page_end"))
    )
    return met.drop("_book", "_at", "_level", "_bin")


def chunk_column(c: Column, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """Chunks of a text column, JVM-side. Its cost grows with the square of the number of chunks
    of one text, so it is for rows of bounded size; chunk_pages() takes books of any size."""
    size = T.estimate_tokens
    flush = lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"])
    state = lambda out, cur: F.struct(out.alias("out"), cur.alias("cur"))

    def add(a: Column, piece: Column, glue: str) -> Column:
        fits = size(a["cur"]) + size(piece) <= max_tokens
        joined = F.when(a["cur"] == "", piece).otherwise(F.concat(a["cur"], F.lit(glue), piece))
        return F.when(fits, state(a["out"], joined)).otherwise(state(flush(a), piece))

    def paragraph(a: Column, p: Column) -> Column:
        long = F.aggregate(T.sentences(p), state(flush(a), F.lit("")), lambda b, s: add(b, s, " "))
        return F.when(size(p) > max_tokens, long).otherwise(add(a, p, "\n\n"))

    empty = state(F.array().cast("array<string>"), F.lit(""))
    folded = F.aggregate(T.paragraphs(c), empty, paragraph, flush)
    whole = F.when(c.isNull(), F.lit(None)).when(size(c) <= max_tokens, F.array(c)).otherwise(folded)
    return F.transform(whole, lambda x, i: F.when(i > 0, F.concat(_tail(F.get(whole, i - 1), overlap_tokens), x)).otherwise(x)) if overlap_tokens else whole


def _tail(previous: Column, overlap_tokens: int) -> Column:
    """What a chunk repeats of the one before, with the space after it."""
    n = overlap_tokens * T.CHARS_PER_TOKEN
    last = F.right(previous, F.lit(n))
    at = lambda s: F.instr(last, s)
    cut = F.when(at("\n") > 1, at("\n")).when(at(" ") > 1, at(" ")).when(at("।") > 1, at("।")).otherwise(0)
    return F.when(F.length(previous) > n, F.concat(F.substring(last, cut + 1, F.lit(n)), F.lit(" "))).otherwise("")


_PARAGRAPH = regex.compile(r"\n{2,}")
_SENTENCE = regex.compile(r"(?<=[.!?।\n])\s+")
#: How a worked example or an exercise begins, and how paragraphs begin that still belong to it.
EXAMPLE = r"(?i)^\s*(?:(?:worked\s+)?example\b|exercises?\b|উদাহরণ|অনুশীলনী)"
CONTINUES = r"(?i)^\s*(?:(?:solution|answer|hence|therefore|thus)\b|সমাধান|উত্তর|[=∴∵⇒→])"
_EXAMPLE, _CONTINUES = regex.compile(EXAMPLE), regex.compile(CONTINUES)
#: Pages of a group that are folded together.
RANGE_PAGES = 128
#: Page numbers of the narrowest bins in which pages meet ranges, and bins that a range takes, but for one, at most.
BIN_PAGES, BINS = 128, 64


def _tokens(s: str) -> int:
    return max(1, len(s) // T.CHARS_PER_TOKEN)


class _Piece(NamedTuple):
    """What the fold adds at once: ``hard`` begins a new chunk, ``close`` ends it."""

    text: str
    glue: str = "\n\n"
    hard: bool = False
    close: bool = False


def _pieces(page: str, limit: int, atomic: bool) -> Iterator[_Piece]:
    """Paragraphs, or the sentences of too long ones; if ``atomic`` an example and what belongs to it is one piece, or on its own if too long."""
    paragraphs = [p for p in map(str.strip, _PARAGRAPH.split(page)) if p]
    at = 0
    while at < len(paragraphs):
        block, at = [paragraphs[at]], at + 1
        whole = atomic and _EXAMPLE.match(block[0])
        while whole and at < len(paragraphs) and _CONTINUES.match(paragraphs[at]):
            block.append(paragraphs[at])
            at += 1
        if _tokens(text := "\n\n".join(block)) <= limit:
            yield _Piece(text)
            continue
        cut = [(s, " " if i else "\n\n") for p in block for i, s in enumerate(_SENTENCE.split(p))]
        for i, (s, glue) in enumerate(cut):
            yield _Piece(s, glue, i == 0, bool(whole) and i == len(cut) - 1)


def _exits(pages: list[str], limit: int, atomic: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each length with which a chunk can be open on entry: the length on exit, and the chunks ended on the way.

    A chunk of the limit takes nothing more, so longer ones count as that. Where all entries
    come to the same, which a new chunk at a hard break or soon by itself brings about, one value stands for all.
    """
    most = limit * T.CHARS_PER_TOKEN
    size, ended = np.arange(most + 1), np.zeros(most + 1, dtype=np.int64)
    for page in pages:
        for text, glue, hard, close in _pieces(page, limit, atomic):
            fits = (np.maximum(1, size // T.CHARS_PER_TOKEN) + _tokens(text) <= limit) & (not hard)
            ended = ended + (~fits & (size > 0)) + close
            size = np.minimum(np.where(fits & (size > 0), size + len(glue), 0) * fits + len(text), most) * (not close)
            if len(size) > 1 and (size == size[0]).all():
                size = size[:1]
    return size, ended if len(size) > 1 or (ended != ended[0]).any() else ended[:1]


def _folded(pages: list[str], limit: int, atomic: bool, entry: int, number: int) -> Iterator[tuple[int, bool, str, bool]]:
    """(number, whether it began before, text, whether it ends here) of each chunk that has text in ``pages``."""
    size, foreign, parts = entry, entry > 0, []
    for page in pages:
        for text, glue, hard, close in _pieces(page, limit, atomic):
            fits = not hard and max(1, size // T.CHARS_PER_TOKEN) + _tokens(text) <= limit
            if not fits and size:
                yield number, foreign, "".join(parts), True
                number, size, foreign, parts = number + 1, 0, False, []
            parts += [glue, text] if size else [text]
            size += len(text) + (len(glue) if size else 0)
            if close:
                yield number, foreign, "".join(parts), True
                number, size, foreign, parts = number + 1, 0, False, []
    if parts:
        yield number, foreign, "".join(parts), False


def _starts(maps: DataFrame) -> DataFrame:
    """_g, _r, entry and number of each range: the maps of a group's ranges, a row each, are walked in order."""

    def walk(batches):
        at, entry, number = None, 0, 0
        for batch in batches:
            entries, numbers = [], []
            for i in range(batch.num_rows):  # a map at a time, as arrays
                key, x, n = batch.column(0)[i].as_py(), batch.column(2)[i].values, batch.column(3)[i].values
                if key != at:
                    at, entry, number = key, 0, 0
                entries.append(entry)
                numbers.append(number)
                number += n[entry if len(n) > 1 else 0].as_py()
                entry = x[entry if len(x) > 1 else 0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.int32()), pa.array(numbers, pa.int64())], names=["_g", "_r", "entry", "number"])

    schema = StructType([*maps.select("_g", "_r").schema, StructField("entry", IntegerType()), StructField("number", LongType())])
    return maps.repartition("_g").sortWithinPartitions("_g", "_r").mapInArrow(walk, schema)


def _with_moved_examples(rows: DataFrame, order: str) -> DataFrame:
    """Leading paragraphs that may belong to an example move to the end of the page before, in the same group; the order of paragraphs stays."""
    parts = T.paragraphs("text")
    goes_on = F.transform(parts, lambda p: F.rlike(p, F.lit(CONTINUES)))
    lead = F.coalesce(F.nullif(F.array_position(goes_on, False), F.lit(0)) - 1, F.size(parts)).cast("int")
    counted = rows.withColumn("_lead", F.when(T.strip("text") == "", 0).otherwise(lead)).withColumn("_all", F.col("_lead") == F.size(parts))
    past = W.partitionBy("_g").orderBy(order).rowsBetween(W.unboundedPreceding, -1)  # rows without texts
    home = F.last(F.when(~F.col("_all"), F.col(order)), ignorenulls=True).over(past)
    homes = counted.select("_g", order, "_lead", "_all").withColumn("_home", home).where("_lead > 0 and _home is not null").select("_g", order, "_home")
    moving = counted.join(homes, ["_g", order])
    taken = moving.groupBy("_g", F.col("_home").alias(order)).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.slice(parts, 1, F.col("_lead")).alias("ps")))).alias("more"))
    text = lambda ps: F.array_join(ps, "\n\n")
    kept = counted.join(homes, ["_g", order], "left").withColumn("text", F.when(F.col("_home").isNull(), F.col("text")).otherwise(text(F.slice(parts, F.col("_lead") + 1, F.greatest(F.size(parts), F.lit(1))))))
    joined = kept.join(taken, ["_g", order], "left")
    return joined.select("_g", "_one", order, F.when(F.col("more").isNull(), F.col("text")).otherwise(F.concat(F.col("text"), F.lit("\n\n"), text(F.flatten(F.col("more.ps"))))).alias("text"))


def chunk_pages(
    pages: DataFrame, group: list[str], order: str = "page_num", max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, skip_blank: bool = False,
    atomic: bool = False, range_pages: int = RANGE_PAGES, short_whole: bool = True, in_one: Column | None = None,
) -> DataFrame:
    """Group columns, piece (0-based) and text of the chunks of each group's pages. Null texts count as empty.

    A group that fits one chunk is one as it is, unless ``short_whole`` is off: then it is folded as well. Others are cut into ranges of ``range_pages``
    pages, which are folded apart: first as a map from the length with which a chunk may be open on entry to
    that on exit, then, when a walk over these maps has told each range's true entry, into
    chunks. Only chunks that cross ranges, and those next to them, are put together by a shuffle.
    No task holds a group. Pages of one number stay together. ``in_one`` is true for all pages of a group,
    or for none: such a group has to lie in one range, which is then folded at once.

    If ``atomic``, worked examples and exercises with their solutions (EXAMPLE, CONTINUES) are
    not cut unless they are longer than a chunk, and then they share no chunk with other text.
    """
    bounded_batches(pages.sparkSession, size="4m")
    one = F.lit(False) if in_one is None else F.coalesce(in_one, F.lit(False))
    rows = pages.select(F.struct(*group).alias("_g"), one.alias("_one"), order, F.coalesce("text", F.lit("")).alias("text"))
    if atomic:
        rows = _with_moved_examples(rows, order)
    ranged = materialise(rows.groupBy("_g", F.floor(F.col(order) / range_pages).alias("_r"), "_one").agg(
        F.array_sort(F.collect_list(F.struct(order, "text"))).alias("pages"), F.sum(F.length("text") + 2).alias("chars"),
    ).select("_g", "_r", F.col("pages.text").alias("texts"), "chars", "_one"))
    alone, long = ranged.where("_one"), ranged.where("not _one")
    wholes = []
    if short_whole:
        total = lambda chars: F.greatest(F.lit(1), F.floor((chars - 2) / T.CHARS_PER_TOKEN))
        fits = total(F.col("chars")) <= max_tokens
        short = long.groupBy("_g").agg((total(F.sum("chars")) <= max_tokens).alias("short")).where("short").drop("short")
        whole = long.join(short, "_g").groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_r", "texts"))).alias("rs")).select("_g", F.flatten(F.col("rs.texts")).alias("texts"))
        wholes = [x.select("_g", F.lit(0).cast("long").alias("piece"), F.array_join("texts", "\n\n").alias("text")) for x in (whole, alone.where(fits))]
        alone, long = alone.where(~fits), long.join(short, "_g", "left_anti")

    def exits(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a range at a time, so that a task holds few texts twice
                made = _exits(batch.column(2)[i].as_py(), max_tokens, atomic)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(m)], pa.int32()), pa.array(m, pa.int32())) for m in made]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *lists], names=["_g", "_r", "exits", "ended"])

    head = [*ranged.select("_g", "_r").schema]
    ints = ArrayType(IntegerType())
    maps = long.select("_g", "_r", "texts").mapInArrow(exits, StructType([*head, StructField("exits", ints), StructField("ended", ints)]))
    keep = overlap_tokens * T.CHARS_PER_TOKEN + 1

    def fold(batches):
        for batch in batches:
            rows, at, held = [], [], 0
            for i in range(batch.num_rows):
                texts, entry, number, one = (batch.column(c)[i].as_py() for c in (2, 3, 4, 5))
                out, before = [], None
                for n, foreign, text, ends in _folded(texts, max_tokens, atomic, entry, number):
                    if foreign or not (ends or one):
                        out.append((n, "part", text, None))
                        if before is not None:
                            out.append((n - 1, "tail", before[-keep:], None))
                    else:
                        out.append((n, "chunk", text, None if before is None else before[-keep:]))
                    before = None if foreign else text
                if before is not None and ends and not one:
                    out.append((n, "tail", before[-keep:], None))
                rows, at, held = rows + out, at + [i] * len(out), held + sum(len(o[2]) for o in out)
                if held >= 2**20 or i == batch.num_rows - 1:  # short ranges share a batch
                    columns = [pa.array([o[c] for o in rows], k) for c, k in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))]
                    heads = [batch.column(c).take(pa.array(at, pa.int32())) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*heads, *columns], names=["_g", "_r", "piece", "kind", "text", "before"])
                    rows, at, held = [], [], 0

    types = StructType([*head, StructField("piece", LongType()), *[StructField(c, StringType()) for c in ("kind", "text", "before")]])
    first = alone.withColumn("entry", F.lit(0)).withColumn("number", F.lit(0).cast("long"))
    known_start = long.join(_starts(maps), ["_g", "_r"]).unionByName(first)
    made = materialise(known_start.select("_g", "_r", "texts", "entry", "number", "_one").mapInArrow(fold, types))
    if not wholes:
        discard(ranged)
    # A chunk is known with its predecessor, or is put together, or follows one that another range knows.
    known = made.where("kind = 'chunk' and (before is not null or piece = 0)").select("_g", "piece", "text", "before")
    edges = made.where("kind <> 'chunk' or (before is null and piece > 0)").groupBy("_g", "piece").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "part", F.struct("_r", "text")))).alias("parts"),
        F.max(F.when(F.col("kind") == "chunk", F.col("text"))).alias("one"), F.max(F.when(F.col("kind") == "tail", F.col("text"))).alias("tail"),
    )
    text = F.coalesce("one", F.when(F.size("parts") > 0, F.array_join(F.col("parts.text"), "")))
    edges = edges.select("_g", "piece", text.alias("text"), F.coalesce("tail", text).alias("tail"))
    before = edges.select("_g", (F.col("piece") + 1).alias("piece"), F.col("tail").alias("before"))
    stitched = edges.where("text is not null").drop("tail").join(before, ["_g", "piece"], "left")
    overlapped = F.concat(F.when(F.col("before").isNull(), "").otherwise(_tail(F.col("before"), overlap_tokens)), F.col("text")) if overlap_tokens else F.col("text")
    out = known.unionByName(stitched).select("_g", "piece", overlapped.alias("text"))
    for whole in wholes:
        out = out.unionByName(whole.where(T.strip("text") != "") if skip_blank else whole)
    return out.select(*[F.col("_g")[c].alias(c) for c in group], F.col("piece").cast("int").alias("piece"), "text")


def book_ranges(pages: DataFrame, chapters: DataFrame, titles: bool = True) -> DataFrame:
    """book, page_start, page_end, chapter_idx and title of the chapters of ``pages``, or of a whole book, as chapter 0, that has none."""
    bounds = pages.groupBy("book").agg(F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"))
    whole = bounds.withColumn("chapter_idx", F.lit(0)).withColumn("title", F.lit(None).cast("string"))
    title = F.col("chapter_title") if titles else F.lit(None).cast("string")
    found = materialise(chapters.where("not whole").select("book", "page_start", "page_end", "chapter_idx", title.alias("title")))
    return materialise(found.unionByName(whole.join(found.select("book").distinct(), "book", "left_anti")))


def chunk_books(
    pages: DataFrame, chapters: DataFrame | None = None, max_tokens: int = MAX_TOKENS, title_from_chapter: bool = False, typed: bool = False, atomic: bool = False, range_pages: int = RANGE_PAGES,
    short_whole: bool = True,
) -> DataFrame:
    """Numbered chunks of books, by chapter where ``chapters`` has some and else over the whole book.

    All chunks are theory, unless ``typed``: then chunk_type() tells. ``atomic`` keeps examples
    whole, and ``short_whole`` is as in chunk_pages(). A chapter's chunks are numbered on from the counts of those before it.
    """
    if chapters is not None:
        ranges = book_ranges(pages, chapters, title_from_chapter)
        placed = pages_in_ranges(pages.select("book", "page_num", "text"), ranges.select("book", "chapter_idx", "page_start", "page_end"))
    else:
        ranges = pages.groupBy("book").agg(F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"))
        ranges = ranges.withColumn("chapter_idx", F.lit(0)).withColumn("title", F.lit(None).cast("string"))
        placed = pages.select("book", "page_num", "text").where("book is not null and page_num is not null").withColumn("chapter_idx", F.lit(0))
    return chunk_placed(placed, ranges, max_tokens, title_from_chapter, typed, atomic, range_pages, short_whole)


def chunk_placed(
    placed: DataFrame, ranges: DataFrame, max_tokens: int = MAX_TOKENS, title_from_chapter: bool = False, typed: bool = False, atomic: bool = False, range_pages: int = RANGE_PAGES,
    short_whole: bool = True,
) -> DataFrame:
    """chunk_books() of pages that pages_in_ranges() has placed in the ranges of book_ranges()."""
    of_range = lambda c: F.floor(F.col(c) / range_pages)
    in_one = of_range("page_start") == of_range("page_end") if "page_start" in placed.columns else None
    made = chunk_pages(placed, ["book", "chapter_idx"], "page_num", max_tokens, atomic=atomic, range_pages=range_pages, short_whole=short_whole, in_one=in_one)
    made = made.where((F.col("chapter_idx") == 0) | (F.col("piece") > 0) | (T.strip("text") != ""))
    upto = W.partitionBy("book").orderBy("chapter_idx").rowsBetween(W.unboundedPreceding, -1)  # a row a chapter
    counts = made.groupBy("book", "chapter_idx").agg(F.count("*").alias("_n"))
    ranges = ranges.join(counts.withColumn("_from", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n"), ["book", "chapter_idx"])
    section = F.col("title") if title_from_chapter else F.lit("")
    anchor = F.when(F.col("chapter_idx") == 0, F.col("book")).otherwise(F.concat_ws(" ", "book", F.coalesce(section, F.lit(""))))
    return made.join(ranges, ["book", "chapter_idx"]).select(
        T.chunk_id(F.col("book"), F.col("_from") + F.col("piece")).alias("chunk_id"), "book", F.lit("").alias("section_no"),
        F.coalesce(section, F.lit("")).alias("section_title"), "page_start", "page_end", (chunk_type(F.col("text")) if typed else F.lit("theory")).alias("chunk_type"),
        T.estimate_tokens("text").alias("token_count"), "text", anchor.alias("anchor_text"),
    )


def chunk_type(c: Column) -> Column:
    """theory, example or exercise by the words a chunk begins with."""
    return (
        F.when(F.rlike(c, F.lit(r"(?iU)^\s*(?:worked\s+)?example\b|^\s*উদাহরণ")), "example")
        .when(F.rlike(c, F.lit(r"(?iU)^\s*exercises?\b|^\s*অনুশীলনী")), "exercise")
        .otherwise("theory")
    )


def example_counts(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Worked examples and exercises named in the chunks of each group."""
    return chunks.groupBy(*by).agg(
        F.sum(F.regexp_count("text", F.lit(r"(?iU)\bexample\s+\d+|উদাহরণ"))).alias("worked_examples"),
        F.sum(F.regexp_count("text", F.lit(r"(?iU)\bexercise\s+\d+|অনুশীলনী"))).alias("exercises"),
    )
