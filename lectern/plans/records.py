"""Queries over files, pages of books, recognised blocks, archives and replies, with their SQL.

The tables hold none of these, so each query writes its records out of whole documents,
pages, benchmark items or conversations, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import legacy, messages, names
from lectern.functions import text as T
from lectern.operators import checks, chunks, enrich, questions
from lectern.session import fresh_path, table, until_exit
from lectern.sources import completions, files, mhtml, ocr

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _pick(index, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
_HEADS = """(['Physics (12) set', 'HIGHER MATHEMATICS  (3)', 'about chemistry (7)', 'Biology (1)', 'Obtained Marks: 3', 'Correct: 4, Incorrect 1'])[CAST(doc_id % 6 AS INTEGER) + 1] || chr(10) || text"""


def _headed(spark, sf):
    heads = ("Physics (12) set", "HIGHER MATHEMATICS  (3)", "about chemistry (7)", "Biology (1)", "Obtained Marks: 3", "Correct: 4, Incorrect 1")
    docs = table(spark, sf, "documents")
    path = F.concat_ws("/", F.lit("root"), "source", F.concat(_pick(F.col("doc_id") % 4, "Math ", "P2 ", "x ", "Weekly chem "), F.col("doc_id").cast("string"), F.lit(".pdf")))
    return docs.select("doc_id", F.concat(_pick(F.col("doc_id") % 6, *heads), F.lit("\n"), "text").alias("text"), path.alias("path"))


_PATH = "'root/' || source || '/' || (['Math ', 'P2 ', 'x ', 'Weekly chem '])[CAST(doc_id % 4 AS INTEGER) + 1] || doc_id || '.pdf'"
_SUBJECT_OF = """CASE WHEN contains(p, 'math') OR contains(p, 'm1') OR contains(p, 'm2') THEN 'Math' WHEN contains(p, 'chem') OR contains(p, 'c1') OR contains(p, 'c2') THEN 'Chemistry'
 WHEN contains(p, 'phys') OR contains(p, 'p1') OR contains(p, 'p2') THEN 'Physics' ELSE '' END"""


@query(f"""SELECT doc_id, CASE lower(regexp_extract(text, '(?i)(Higher Mathematics|Physics|Chemistry)\\s*\\(([0-9]+)\\)', 1)) WHEN 'higher mathematics' THEN 'Math' WHEN 'physics' THEN 'Physics' WHEN 'chemistry' THEN 'Chemistry'
 ELSE {_SUBJECT_OF} END AS subject FROM (SELECT doc_id, {_HEADS} AS text, lower({_PATH}) AS p FROM documents)""")
def header_subject(spark, sf):
    """The subject that a header names, else that of the path."""
    return _headed(spark, sf).select("doc_id", names.subject_from_header(F.col("text"), F.col("path")).alias("subject"))


@query(f"""SELECT doc_id FROM (SELECT doc_id, {_HEADS} AS text FROM documents) WHERE NOT regexp_matches(left(text, 500), '(?i)Obtained Marks|Accuracy:|MCQ Obtained|Correct:\\s*[0-9]+,\\s*Incorrect')""")
def report_filter(spark, sf):
    """Texts that are no performance reports."""
    return _headed(spark, sf).where(~names.is_report(F.col("text"))).select("doc_id")


@query(f"""SELECT doc_id, CASE WHEN contains(n, 'weekly') THEN 'weekly' WHEN contains(n, 'mcq') THEN 'daily_mcq' WHEN contains(n, 'written') THEN 'daily_written' ELSE 'unknown' END AS kind,
 CASE WHEN contains(n, 'phys') OR contains(n, 'p1') OR contains(n, 'p2') THEN 'Physics' WHEN contains(n, 'chem') OR contains(n, 'c1') OR contains(n, 'c2') THEN 'Chemistry'
 WHEN contains(n, 'math') OR contains(n, 'm1') OR contains(n, 'm2') THEN 'Math' ELSE 'Unknown' END AS subject, 'out/' || replace({_PATH}, '.pdf', '.html') AS target,
 'sha1:' || left(sha1(doc_id || '7'), 12) AS qid FROM (SELECT *, lower({_PATH}) AS n FROM documents)""")
def labelling_names(spark, sf):
    """The labelling tool's kinds and subjects, output paths, and question ids."""
    path = F.col("path")
    return _headed(spark, sf).select(
        "doc_id", names.labelling_kind(path).alias("kind"), names.labelling_subject(path).alias("subject"), names.output_path(path, "out/", ".html").alias("target"),
        names.question_id(F.col("doc_id").cast("string"), F.lit(7)).alias("qid"),
    )


@query("""SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id * 11 % 100 <= doc_id * 7 % 100""")
def incremental_conversion(spark, sf):
    """Sources without an output newer than they are."""
    docs = table(spark, sf, "documents")
    sources = docs.select(F.col("doc_id").alias("path"), (F.col("doc_id") * 7 % 100).alias("mtime"))
    outputs = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("path"), (F.col("doc_id") * 11 % 100).alias("out_mtime"))
    return files.needs_conversion(sources, outputs).select(F.col("path").alias("doc_id"))


_BLOCKS = """b AS (SELECT source AS book, doc_id AS page_num, lines, list_transform(lines, lambda x, i: ((i * 37 + doc_id) % 100) / 100.0) AS c FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents)),
 k AS (SELECT book, page_num, list_filter(lines, lambda x, i: c[i] >= 0.3) AS kept, list_filter(c, lambda x: x >= 0.3) AS kc FROM b),
 o AS (SELECT book, page_num, array_to_string(kept, ' ') AS text, CASE WHEN len(kc) > 0 THEN round(list_sum(kc) / len(kc), 4) ELSE 0.0 END AS avg_confidence, len(kept) AS block_count FROM k)"""


def _recognised(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    confidence = lambda i: ((i + 1) * 37 + F.col("doc_id")) % 100 / 100.0
    blocks = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("text"), confidence(i).alias("confidence")))
    return docs.select(F.col("source").alias("book"), F.col("doc_id").alias("page_num"), blocks.alias("blocks")).withColumn("o", files.ocr_text(F.col("blocks"))).select("book", "page_num", "o.*")


@query(f"WITH {_BLOCKS} SELECT page_num, md5(text) AS text_md5, round(avg_confidence, 3) AS avg_confidence, CAST(block_count AS INTEGER) AS block_count, regexp_matches(text, '[\\x{{0980}}-\\x{{09FF}}]') AS has_bengali FROM o")
def ocr_filter(spark, sf):
    """Recognised blocks of enough confidence, joined, with their mean confidence."""
    return _recognised(spark, sf).select("page_num", F.md5("text").alias("text_md5"), F.round("avg_confidence", 3).alias("avg_confidence"), "block_count", "has_bengali")


@query(f"WITH {_BLOCKS} SELECT book, page_num FROM o WHERE length(text) < 20 OR avg_confidence < 0.6")
def flagged_pages(spark, sf):
    """Pages that are short or of low confidence."""
    return files.low_confidence(_recognised(spark, sf)).select("book", "page_num")


@query(f"WITH {_BLOCKS} SELECT book, count(*) AS pages, CAST(count_if(avg_confidence < 0.5) AS BIGINT) AS low FROM o GROUP BY book")
def low_confidence_counts(spark, sf):
    """Pages of low confidence of each book."""
    return files.low_confidence_counts(_recognised(spark, sf))


@query(f"""WITH {_BLOCKS} SELECT book, count(*) AS pages, round(avg(avg_confidence), 5) AS avg_confidence, CAST(count_if(avg_confidence < 0.6) AS BIGINT) AS low_confidence, CAST(count_if(length(text) < 20) AS BIGINT) AS near_blank FROM o GROUP BY book""")
def ocr_report(spark, sf):
    """Quality of recognition per book."""
    return enrich.ocr_report(_recognised(spark, sf))[0].withColumn("avg_confidence", F.round("avg_confidence", 5))


@query("""SELECT source AS book, lang AS section_title, count(*) AS chunks, CAST(sum(t) AS BIGINT) AS tokens, CAST(min(t) AS INTEGER) AS least, CAST(max(t) AS INTEGER) AS most, round(avg(t), 5) AS mean
 FROM (SELECT *, greatest(1, length(text) // 4) AS t FROM documents) GROUP BY ALL""")
def section_tokens(spark, sf):
    """Chunks and tokens of each section."""
    made = table(spark, sf, "documents").select(F.col("source").alias("book"), F.col("lang").alias("section_title"), T.estimate_tokens("text").alias("token_count"))
    none = made.limit(0).select("book", F.lit(0.0).alias("avg_confidence"), F.lit("").alias("text"))
    return enrich.ocr_report(none, made)[1].withColumn("mean", F.round("mean", 5))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN upper(left(text, 5)) ELSE text END AS text FROM documents")
def page_overrides(spark, sf):
    """Page texts with those that people corrected."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page_num"), "text")
    by_hand = docs.where("page_num % 10 = 3").select("book", "page_num", T.upper_simple(F.left("text", F.lit(5))).alias("override"))
    return files.with_overrides(docs, by_hand).select(F.col("page_num").alias("doc_id"), "text")


@query("SELECT source AS book, count(DISTINCT doc_id // 2) AS done FROM documents GROUP BY 1")
def completed_pages(spark, sf):
    """Finished pages of each book, repeated ones once."""
    return files.done_pages(table(spark, sf, "documents").select(F.col("source").alias("book"), F.floor(F.col("doc_id") / 2).alias("page_num")))


_PAGES_OF = "string_split(coalesce(text, ''), chr(10))"


def _files(spark, sf):
    """Documents as files whose pages are their lines."""
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def _lines_of(content: bytes) -> list[str]:
    return content.decode().split("\n")


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS page_num, CAST(len(ps) AS INTEGER) AS page_count, ps[i] AS text FROM (SELECT doc_id, ps, unnest(range(1, least(3, len(ps)) + 1)) AS i FROM (SELECT doc_id, {_PAGES_OF} AS ps FROM documents))""")
def document_pages(spark, sf):
    """The first three pages of every file with their number in all."""
    return files.pdf_pages(_files(spark, sf), 3, _lines_of).select(F.col("path").cast("long").alias("doc_id"), "page_num", "page_count", "text")


@query(f"""SELECT doc_id, md5(array_to_string(ps, chr(10)) || chr(10)) AS text_md5, coalesce(left(list_filter(ps, lambda x: trim(x, ' ') <> '')[1], 500), '') AS header FROM (SELECT doc_id, {_PAGES_OF} AS ps FROM documents)""")
def document_text(spark, sf):
    """All pages of a file joined, and its header; a page limit of 0 means all."""
    got = files.document_text(files.pdf_pages(_files(spark, sf), 0, _lines_of))
    return got.select(F.col("path").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), "header")


@query("""SELECT doc_id, CAST(i AS INTEGER) AS page_num, CASE WHEN doc_id % 9 = 0 THEN 'broken' END AS error, CASE WHEN doc_id % 9 <> 0 THEN text END AS text FROM (
 SELECT doc_id, ps[i] AS text, i FROM (SELECT doc_id, ps, unnest(range(1, least(2, len(ps)) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ps FROM documents)) WHERE doc_id % 9 <> 0
 UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE doc_id % 9 = 0)""")
def page_images(spark, sf):
    """Two page images of every file; broken files are told."""
    def render(content: bytes, dpi: int) -> list[bytes]:
        if content == b"broken":
            raise ValueError("broken")
        return [x.encode() for x in content.decode().split("\n")]

    given = _files(spark, sf).withColumn("content", F.when(F.col("path").cast("long") % 9 == 0, F.lit("broken").cast("binary")).otherwise(F.col("content")))
    return ocr.page_images(given, render, max_pages=2).select(F.col("path").cast("long").alias("doc_id"), "page_num", "error", F.col("png").cast("string").alias("text"))


@query("""SELECT item_id, CASE WHEN length(text) % 10 >= 3 THEN text || ' ' ELSE '' END || replace(text, ' ', '_') AS text, CAST(CASE WHEN length(text) % 10 >= 3 THEN 2 ELSE 1 END AS INTEGER) AS block_count FROM benchmark""")
def recognition(spark, sf):
    """Texts that an engine reads from images, without blocks of low confidence."""
    images = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.lit(1).alias("page_num"), F.col("text").cast("binary").alias("png"))

    def engine():
        return lambda png: [(png.decode(), len(png.decode()) % 10 / 10), (png.decode().replace(" ", "_"), 0.9)]

    return ocr.recognise(images, engine, "underscores").select(F.col("path").cast("long").alias("item_id"), "text", "block_count")


@query("""WITH s AS (SELECT doc_id, lang, trim(text, ' ') AS t FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text FROM documents))
 SELECT doc_id, count(*) AS spans, CAST(count_if(lang IN ('de', 'fr')) AS BIGINT) AS legacy, sum(length(t)) < 20 AS needs_image FROM s GROUP BY doc_id""")
def font_spans(spark, sf):
    """Encodings of font spans, and pages with too little text."""
    font = F.when(F.col("lang").isin("de", "fr"), "SutonnyMJ").otherwise("Arial")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("page_num"), font.alias("font"), F.explode(F.split("text", "\n")).alias("text"))
    found = ocr.spans(rows)
    return found.groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("spans"), F.count_if(F.col("encoding") == "bijoy").alias("legacy"), F.max("needs_image").alias("needs_image"))


@query("""SELECT round(avg(CAST(sum < 20 AS INTEGER)), 6) AS image_fraction FROM (SELECT sum(length(trim(text, ' '))) AS sum FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY doc_id)""")
def image_fraction(spark, sf):
    """Share of pages that need recognition."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("page_num"), F.lit("x").alias("font"), F.explode(F.split("text", "\n")).alias("text"))
    pages = ocr.spans(rows).groupBy("path", "page_num").agg(F.max("needs_image").alias("needs_image"))
    return ocr.image_fraction(pages).select(F.round("image_fraction", 6).alias("image_fraction"))


_ARCHIVE = ("MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=\"b\"\r\n\r\n--b\r\nContent-Type: text/css\r\n\r\np {}\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n")


@query("SELECT page_id, md5(html) AS html_md5 FROM pages")
def archive_pages(spark, sf):
    """The html part of saved pages."""
    raw = F.concat(F.lit(_ARCHIVE), F.base64(F.col("html").cast("binary")), F.lit("\r\n--b--\r\n")).cast("binary")
    given = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), raw.alias("content"))
    return mhtml.pages(given).select(F.col("path").cast("long").alias("page_id"), F.md5("html").alias("html_md5"))


@query("SELECT page_id, md5(html) AS html_md5 FROM pages")
def quoted_archives(spark, sf):
    """The html part of saved pages in quoted-printable: every byte escaped, lines broken softly."""
    escaped = F.regexp_replace(F.regexp_replace(F.hex(F.col("html").cast("binary")), "(..)", "=$1"), "((?:=..){24})", "$1=\r\n")
    raw = F.concat(F.lit(_ARCHIVE.replace("base64", "quoted-printable")), escaped, F.lit("\r\n--b--\r\n")).cast("binary")
    given = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), raw.alias("content"))
    return mhtml.pages(given).select(F.col("path").cast("long").alias("page_id"), F.md5(F.regexp_replace("html", "\n$", "")).alias("html_md5"))


@query("""SELECT page_id, md5(replace(html, '</head>', '<style>p {}</style></head>')) AS html_md5 FROM pages""")
def archive_styles(spark, sf):
    """Saved pages with their style sheets put inside."""
    raw = F.concat(F.lit(_ARCHIVE), F.base64(F.col("html").cast("binary")), F.lit("\r\n--b--\r\n")).cast("binary")
    given = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), raw.alias("content"))
    return mhtml.pages(given, css=True).select(F.col("path").cast("long").alias("page_id"), F.md5("html").alias("html_md5"))


def _exam_pages(spark, sf):
    part = lambda cls, body, tag="div": F.concat(F.lit(f"<{tag} class='{cls}'>"), body, F.lit(f"</{tag}>"))
    safe = F.regexp_replace("text", "[<>&]", "")
    legacy_span = part("pt-0000-1", F.lit("Avwg fvj"), "span")
    options = F.concat(*[part("questionOption", part("optionText", F.concat(F.lit(f"{x} "), F.col("item_id").cast("string")))) for x in "abcd"])
    one = lambda n: part("questionBlock", F.concat(part("questionSerial", F.lit(f"Q {n}.")), part("questionText", F.concat(safe, legacy_span)), options))
    page = F.concat(F.lit("<html><body>"), one(3), one(5), F.lit("</body></html>"))
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("path"), page.alias("html"))


_ITEM_TEXT = f"trim(regexp_replace(text, '[<>&]', '', 'g'), {_BLANKS})"


@query(f"""SELECT item_id, q_index, {_ITEM_TEXT} || 'Avwg fvj' AS question_text, 'a ' || item_id || '|b ' || item_id || '|c ' || item_id || '|d ' || item_id AS options FROM benchmark, (SELECT unnest([3, 5]) AS q_index)""")
def archive_questions(spark, sf):
    """Question blocks of saved exams: number, stem, options."""
    found = mhtml.questions(_exam_pages(spark, sf))
    return found.select(F.col("path").cast("long").alias("item_id"), "q_index", "question_text", F.array_join("options", "|").alias("options"))


@query(f"""SELECT item_id, q_index, 'Avwg fvj' AS raw_bijoy, left({_ITEM_TEXT} || 'Avwg fvj', 100) AS context FROM benchmark, (SELECT unnest([3, 5]) AS q_index)""")
def legacy_spans(spark, sf):
    """Spans in the legacy encoding, with their context."""
    found = mhtml.legacy_strings(mhtml.questions(_exam_pages(spark, sf)))
    return found.select(F.col("path").cast("long").alias("item_id"), "q_index", "raw_bijoy", "context")


@query("""SELECT item_id, CAST(block AS INTEGER) AS block, part, option, kind, value FROM benchmark, (VALUES (0), (1)) b(block), LATERAL (SELECT * FROM (VALUES
 ('stem', CAST(NULL AS INTEGER), 'text', 'find '), ('stem', NULL, 'math', '<math><mi>x</mi><mo>&lt;</mo><mn>' || item_id || '</mn></math>'), ('stem', NULL, 'text', ' & say'),
 ('letter', 0, 'text', 'A'), ('option', 0, 'text', 'one'), ('option', 1, 'text', 'two')) v(part, option, kind, value))""")
def archive_nodes(spark, sf):
    """Text and formula nodes of questions in document order; visual formulas are skipped."""
    number = F.col("item_id").cast("string")
    stem = F.concat(
        F.lit("<div class='questionText'>find <span class='math-tex'><mjx-math>x &lt; n</mjx-math><mjx-assistive-mml><math><mi>x</mi><mo>&lt;</mo><mn>"), number,
        F.lit("</mn></math></mjx-assistive-mml></span> &amp; say</div>".replace(" &amp; say", "<b> &amp; say</b>")),
    )
    options = F.lit("<div class='questionOption'><span class='input-group-text'>A</span><p>one</p></div><div class='questionOption'><p>two</p></div>")
    block = F.concat(F.lit("<div class='questionBlock'>"), stem, options, F.lit("</div>"))
    given = table(spark, sf, "benchmark").select(number.alias("path"), F.concat(F.lit("<html>"), block, block, F.lit("</html>")).alias("html"))
    nodes = mhtml.raw_nodes(given)
    # Neighbouring text nodes (a reference ends one) are joined.
    order = W.partitionBy("path").orderBy("place")
    new = (F.coalesce(F.lag("part").over(order), F.lit("")) != F.col("part")) | (F.lag("kind").over(order) != F.col("kind")) | ~F.lag("option").over(order).eqNullSafe(F.col("option"))
    joined = nodes.withColumn("run", F.sum(new.cast("int")).over(order)).groupBy("path", "run", "block", "part", "option", "kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "").alias("value")
    )
    return joined.select(F.col("path").cast("long").alias("item_id"), "block", "part", "option", "kind", "value")


def _written(spark, df, how):
    path = fresh_path(spark, "records")
    how(df, path)
    until_exit(spark, path)
    return path


@query("SELECT doc_id, text, lang FROM documents")
def jsonl_strict(spark, sf):
    """Documents written as JSON lines and read back, every line a record."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return files.read_jsonl(spark, _written(spark, docs, files.write_jsonl), "doc_id long, text string, lang string")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 4 <> 0")
def jsonl_tolerant(spark, sf):
    """JSON lines of which some were cut off."""
    line = F.to_json(F.struct("doc_id", "lang"))
    cut = F.when(F.col("doc_id") % 4 == 0, F.left(line, F.length(line) - 3)).otherwise(line)
    docs = table(spark, sf, "documents").select(cut.alias("value"))
    return files.read_jsonl(spark, _written(spark, docs, lambda d, p: d.write.text(p)), "doc_id long, lang string", tolerant=True)


@query("SELECT item_id, text FROM benchmark")
def json_document(spark, sf):
    """One JSON document of all items, written and read back."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    path = _written(spark, items, lambda d, p: files.write_document(d, p, {"files_ok": 1}))
    found = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "documents array<struct<item_id: long, text: string>>, report struct<files_ok: int>").alias("d"))
    return found.where("d.report.files_ok = 1").select(F.inline("d.documents"))


@query("SELECT item_id, text FROM benchmark")
def json_array(spark, sf):
    """Items from a JSON array."""
    return files.read_array(spark, _written(spark, table(spark, sf, "benchmark").repartition(3), files.write_array), "item_id long, text string")


@query("SELECT lang, doc_id FROM documents")
def append_by_book(spark, sf):
    """A log kept by book and appended to twice, once with rows it has."""
    docs = table(spark, sf, "documents").select("lang", "doc_id")
    path = _written(spark, docs.where("doc_id % 2 = 0"), lambda d, p: files.append_new(d, p, ["doc_id", "lang"], by="lang"))
    files.append_new(docs.where("doc_id % 3 <> 0").unionByName(docs), path, ["doc_id", "lang"], by="lang")
    return spark.read.schema(docs.schema).json(path)


@query("""SELECT source AS book, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE 'a' END AS state, md5(text) AS text_md5 FROM documents WHERE CASE WHEN doc_id % 2 = 0 THEN doc_id % 10 <> 0 ELSE doc_id % 3 <> 0 END""")
def merge_increments(spark, sf):
    """A table by book after two increments with changes and deletions, the second worked in twice."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("book"), "doc_id", F.md5("text").alias("text_md5"))
    part = F.floor(F.col("doc_id") / 1000)
    first = docs.where("doc_id % 3 <> 0").withColumn("state", F.lit("a"))
    second = docs.where("doc_id % 2 = 0").withColumns({"state": F.lit("b"), "deleted": F.col("doc_id") % 10 == 0})
    merge = lambda d, p: files.merge_increment(d, p, ["book", "doc_id"], place=part)
    path = _written(spark, first, merge)
    merge(second, path)
    merge(second, path)
    return files.read_merged(spark, path, "book string, doc_id long, text_md5 string, state string").select("book", "doc_id", "state", "text_md5")


@query("SELECT lang, doc_id FROM documents")
def append_resumed(spark, sf):
    """A log that is appended to twice holds each row once."""
    docs = table(spark, sf, "documents").select("lang", "doc_id")
    path = _written(spark, docs.where("doc_id % 2 = 0"), lambda d, p: files.append_new(d, p, ["doc_id"]))
    files.append_new(docs.unionByName(docs), path, ["doc_id"])
    return spark.read.schema(docs.schema).json(path)


@query("SELECT doc_id, lang, source FROM documents")
def tsv_sink(spark, sf):
    """Tab-separated values with a header."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return spark.read.schema(docs.schema).option("sep", "\t").option("header", "true").csv(_written(spark, docs, files.write_tsv))


@query("SELECT lang AS name, true AS filled FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def file_listing(spark, sf):
    """Files below a folder, by their suffix."""
    docs = table(spark, sf, "documents").where("lang is not null").select("lang", "doc_id")
    path = _written(spark, docs, lambda d, p: files.write_table(d, p, by="lang"))
    listed = files.list_files(spark, path, ".parquet").where("length > 0")
    return listed.select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("name"), F.lit(True).alias("filled")).distinct()


_QUEUE = "(SELECT 'exam' || item_id % 5 AS source_file, item_id AS q_index, text FROM benchmark)"


def _exam_questions(spark, sf):
    letters = F.array(*[F.struct(F.lit(x).alias("letter"), F.concat(F.lit(f"<{x}> & "), F.col("item_id").cast("string")).alias("text")) for x in "AB"])
    return table(spark, sf, "benchmark").select(F.concat(F.lit("exam"), (F.col("item_id") % 5).cast("string")).alias("source_file"), F.col("item_id").alias("q_index"), F.col("text").alias("question_text"), letters.alias("options"))


@query(f"""SELECT 'sha1:' || source_file || ':q' || q_index AS qid, source_file, q_index, '' AS subject, '' AS concept_id, 3 AS difficulty_1_5, text AS question_text_bn, '' AS labelled_by, '' AS labelled_at FROM {_QUEUE}""")
def labelling_queue(spark, sf):
    """Blank labels for people to fill."""
    return files.labelling_queue(_exam_questions(spark, sf))


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT source_file, md5('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>' || string_agg('<div class="question"><h3>Question ' || q_index || '</h3><p>' || {_ESC.format("text")} || '</p><ol><li>A. &lt;A&gt; &amp; ' || q_index
 || '</li><li>B. &lt;B&gt; &amp; ' || q_index || '</li></ol></div>', chr(10) ORDER BY q_index) || '</body></html>') AS html_md5 FROM {_QUEUE} GROUP BY 1""")
def exam_html(spark, sf):
    """A page per exam for people who label."""
    return files.exam_html(_exam_questions(spark, sf)).select("source_file", F.md5("html").alias("html_md5"))


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN '<HTML>' || text ELSE '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"></head><body>' || chr(10) || text || chr(10) || '</body></html>' END) AS html_md5 FROM documents""")
def standalone_html(spark, sf):
    """Fragments made whole pages."""
    c = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<HTML>"), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(files.standalone_html(c)).alias("html_md5"))


@query("""WITH q AS (SELECT 'week1/C1 MCQ ' || item_id || CASE item_id % 5 WHEN 0 THEN ' diff' WHEN 1 THEN ' written' ELSE '' END || '.pdf' AS path, item_id, CASE item_id % 5 WHEN 2 THEN 'skipped' WHEN 3 THEN 'failed' WHEN 4 THEN 'ok' ELSE 'skipped' END AS status FROM benchmark)
 SELECT path, status, CAST(CASE WHEN status = 'ok' THEN 1 + item_id % 2 ELSE 0 END AS BIGINT) AS questions, CAST(CASE WHEN status = 'ok' THEN item_id % 2 ELSE 0 END AS BIGINT) AS with_options FROM q""")
def file_report(spark, sf):
    """Status, questions and questions with options of every file."""
    return questions.file_report(*_ingested(spark, sf))


@query("""SELECT count(*) AS files_seen, CAST(count_if(m = 4) AS BIGINT) AS files_ok, CAST(count_if(m = 3) AS BIGINT) AS files_failed, CAST(coalesce(sum(CASE WHEN m = 4 THEN 1 + b END), 0) AS BIGINT) AS total_questions,
 CAST(coalesce(sum(CASE WHEN m = 4 THEN b END), 0) AS BIGINT) AS questions_with_options, count_if(m = 4) AS questions_missing_options FROM (SELECT item_id % 5 AS m, item_id % 2 AS b FROM benchmark WHERE item_id % 5 IN (3, 4))""")
def ingest_totals(spark, sf):
    """Files seen, read and failed, and their questions."""
    return questions.ingest_totals(questions.file_report(*_ingested(spark, sf)))


def _ingested(spark, sf):
    five = F.col("item_id") % 5
    path = F.concat(F.lit("week1/C1 MCQ "), F.col("item_id").cast("string"), F.when(five == 0, " diff").when(five == 1, " written").otherwise(""), F.lit(".pdf"))
    # One question without options, and for odd items one with four.
    body = F.concat(F.lit("head\nQuestion 1\n"), F.regexp_replace("text", "\\s+", " "), F.lit("\n"), F.when(F.col("item_id") % 2 == 1, "Question 2\nstem\nA\n1\nB\n2\nC\n3\nD\n4\nSolution: A\n").otherwise(""))
    text = F.when(five == 2, F.concat(F.lit("Accuracy: 3\n"), body)).when(five == 3, F.lit(None)).otherwise(body)
    given = table(spark, sf, "benchmark").select(path.alias("path"), text.alias("text"))
    return given, questions.ingest(given.where("text is not null"))[0]


_TEXTS = "regexp_replace(text, '\\s+', ' ', 'g')"
_MARKED = """m AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_num, CASE doc_id % 7 WHEN 0 THEN 'Chapter ' || doc_id || ' Title ' || lang WHEN 3 THEN 'অধ্যায় ৩' || doc_id % 10 || ' ' || lang WHEN 5 THEN 'no marker' ELSE lang END AS head,
  doc_id % 7 IN (0, 3) AS opens, doc_id % 7 = 0 AS en, doc_id FROM documents)"""


def _marked_pages(spark, sf):
    seven, number = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    head = (
        F.when(seven == 0, F.concat_ws(" ", F.lit("Chapter"), number, F.lit("Title"), "lang"))
        .when(seven == 3, F.concat(F.lit("অধ্যায় ৩"), (F.col("doc_id") % 10).cast("string"), F.lit(" "), "lang")).when(seven == 5, "no marker").otherwise(F.col("lang"))
    )
    body = F.concat(head, F.lit("\n"), F.concat((F.col("doc_id") % 9).cast("string"), F.lit(".1 begins\nthe end")))
    order = W.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").select(F.col("source").alias("book"), F.row_number().over(order).alias("page_num"), body.alias("text"), "doc_id")


_CHAPTER_SPANS = f"""{_MARKED}, n AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY book ORDER BY page_num) AS idx FROM m),
 s AS (SELECT book, idx, min(page_num) AS page_start, max(page_num) AS last, arg_min(head, page_num) AS title, arg_min(en, page_num) AS en, arg_min(doc_id, page_num) AS doc_id, string_agg(doc_id % 9 || '.1', ',' ORDER BY page_num) AS sections FROM n GROUP BY 1, 2),
 c AS (SELECT *, count(*) OVER (PARTITION BY book) = 1 AND idx = 0 AS whole, coalesce(lead(page_start) OVER (PARTITION BY book ORDER BY idx) - 1, last) AS page_end FROM s)"""


@query(f"""WITH {_CHAPTER_SPANS} SELECT book, CAST(greatest(idx, 1) AS INTEGER) AS chapter_idx, CASE WHEN whole THEN '1' WHEN en THEN CAST(doc_id AS VARCHAR) ELSE '৩' || doc_id % 10 END AS chapter_no, CASE WHEN whole THEN book ELSE title END AS chapter_title,
 CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end, CASE WHEN whole THEN '' ELSE sections END AS sections FROM c WHERE idx > 0 OR whole""")
def chapter_markers(spark, sf):
    """Chapters by their headings in two languages, with the sections inside."""
    found = chunks.detect_chapters(_marked_pages(spark, sf))
    numbers = F.array_join(F.transform("sections", lambda s: s["section_no"]), ",")
    return found.select("book", "chapter_idx", "chapter_no", "chapter_title", "page_start", "page_end", numbers.alias("sections"))


@query(f"""WITH {_CHAPTER_SPANS}, r AS (SELECT book, idx, page_start, page_end, title, en, doc_id FROM c WHERE idx > 0),
 g AS (SELECT r.book, r.idx, string_agg(m.head || chr(10) || m.doc_id % 9 || '.1 begins' || chr(10) || 'the end', chr(10) || chr(10) ORDER BY m.page_num) AS text, any_value(r.page_start) AS page_start, any_value(r.page_end) AS page_end, any_value(r.title) AS title
  FROM r JOIN m ON m.book = r.book AND m.page_num BETWEEN r.page_start AND r.page_end GROUP BY 1, 2)
 SELECT book, title AS section_title, CAST(page_start AS INTEGER) AS page_start, CAST(page_end AS INTEGER) AS page_end, count(*) AS chunks, md5(any_value(text)) AS text_md5, book || ' ' || title AS anchor_text FROM g WHERE length(text) // 4 <= 500 GROUP BY ALL""")
def chunk_chapters(spark, sf):
    """Chunks by chapter, for chapters that fit one chunk."""
    pages = _marked_pages(spark, sf)
    found = chunks.detect_chapters(pages)
    made = chunks.chunk_books(pages, found, title_from_chapter=True, typed=True).where("section_title <> ''")
    per = made.groupBy("book", "section_title", "page_start", "page_end").agg(F.count("*").alias("chunks"), F.first(F.md5("text")).alias("text_md5"), F.first("anchor_text").alias("anchor_text"))
    return per.where("chunks = 1").select("book", "section_title", "page_start", "page_end", "chunks", "text_md5", "anchor_text")


@query("""WITH p AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_num FROM documents), t AS (SELECT *, ntile(4) OVER (PARTITION BY book ORDER BY page_num) AS chapter_idx FROM p)
 SELECT book, CAST(chapter_idx AS INTEGER) AS chapter_idx, CAST(min(page_num) AS INTEGER) AS page_start, CAST(max(page_num) AS INTEGER) AS page_end FROM t GROUP BY 1, 2""")
def uniform_chapters(spark, sf):
    """Four chapters of equal length for every book."""
    return chunks.uniform_chapters(_marked_pages(spark, sf), 4).select("book", "chapter_idx", "page_start", "page_end")


_TYPED = "(['Worked example 3: ', 'Exercises 1', 'উদাহরণ ', 'An exercise 4 and example 5 ', ''])[CAST(doc_id % 5 AS INTEGER) + 1] || text"


def _typed(spark, sf):
    lead = _pick(F.col("doc_id") % 5, "Worked example 3: ", "Exercises 1", "উদাহরণ ", "An exercise 4 and example 5 ", "")
    return table(spark, sf, "documents").select("doc_id", "source", F.concat(lead, "text").alias("text"))


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)^\\s*(?:worked\\s+)?example\\b|^\\s*উদাহরণ') THEN 'example' WHEN regexp_matches(t, '(?i)^\\s*exercises?\\b|^\\s*অনুশীলনী') THEN 'exercise' ELSE 'theory' END AS chunk_type FROM (SELECT doc_id, {_TYPED} AS t FROM documents)""")
def chunk_types(spark, sf):
    """Theory, examples and exercises."""
    return _typed(spark, sf).select("doc_id", chunks.chunk_type(F.col("text")).alias("chunk_type"))


@query(f"""SELECT source, CAST(sum(len(regexp_extract_all(t, '(?i)\\bexample\\s+[0-9]+|উদাহরণ'))) AS BIGINT) AS worked_examples, CAST(sum(len(regexp_extract_all(t, '(?i)\\bexercise\\s+[0-9]+|অনুশীলনী'))) AS BIGINT) AS exercises FROM (SELECT source, {_TYPED} AS t FROM documents) GROUP BY 1""")
def example_counts(spark, sf):
    """Worked examples and exercises of each book."""
    return chunks.example_counts(_typed(spark, sf), ["source"])


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Daily' ELSE 'WEEKLY' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'written' ELSE 'MCQ' END AS form, doc_id AS week, doc_id % 7 AS set_no, trim(split_part(text, chr(10), 1)) AS section
 FROM documents WHERE trim(split_part(text, chr(10), 1)) <> ''""")
def header_fields(spark, sf):
    """Exam, set and section named in headers put before whole texts."""
    docs = table(spark, sf, "documents").where(F.trim(F.substring_index("text", "\n", 1)) != "")
    kind, form = F.when(F.col("doc_id") % 2 == 0, "Daily").otherwise("WEEKLY"), F.when(F.col("doc_id") % 3 == 0, "written").otherwise("MCQ")
    head = F.concat(F.lit("EAP "), kind, F.lit(" "), form, F.lit(" Exam W-"), F.col("doc_id").cast("string"), F.lit("\nMCQ Master Set: "), (F.col("doc_id") % 7).cast("string"), F.lit("\n বিশেষ : "))
    texts = docs.select("doc_id", F.concat(head, "text").alias("text"))
    one = lambda pattern, group: F.get(T.extract("text", pattern, group), F.lit(0))
    return texts.select(
        "doc_id", one(T.HEADER_EXAM, 1).alias("kind"), one(T.HEADER_EXAM, 2).alias("form"), one(T.HEADER_EXAM, 3).cast("long").alias("week"),
        one(T.HEADER_SET, 1).cast("long").alias("set_no"), F.trim(one(T.BENGALI_SECTION, 1)).alias("section"),
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE '{"id":' || doc_id || '}' END AS json, doc_id % 3 = 2 AS needs_review FROM documents""")
def repaired_replies(spark, sf):
    """Replies that are no JSON are asked for once more; what still is none needs review."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("doc_id").cast("string").alias("prompt"))
    body = F.concat(F.lit('{"id":'), "key", F.lit("}"))
    reply = F.when(F.col("key").cast("long") % 3 == 0, body).otherwise(F.lit("no"))
    given = docs.withColumn("reply", reply).withColumn("json", messages.json_reply("reply"))
    again = completions.repair(given, lambda prompt: '{"id":%s}' % prompt if int(prompt) % 3 == 1 else "still no")
    return again.select(F.col("key").cast("long").alias("doc_id"), "json", "needs_review")


@query("""WITH o AS (SELECT event_type AS subject, event_type || '.' || user_id AS concept_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 604800) AS INTEGER) AS week, count(*) AS n FROM events GROUP BY ALL),
 r AS (SELECT week, concept_id, row_number() OVER (PARTITION BY week ORDER BY hash_, concept_id) AS rank, n FROM (SELECT *, md5(concept_id || week) AS hash_ FROM o))
 SELECT week, round(count_if(rank <= 30) / count(*), 6) AS recall, round(sum(CASE WHEN rank <= 30 THEN n END) / sum(n), 6) AS weighted_recall FROM r GROUP BY 1""")
def outcome_log(spark, sf):
    """Stored rankings scored against outcomes that are logged week by week, some of them twice."""
    week = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 604800).cast("int")
    events = table(spark, sf, "events").select(F.concat_ws(".", "event_type", F.col("user_id").cast("string")).alias("concept_id"), F.col("event_type").alias("subject"), week.alias("week"))
    outcomes = events.groupBy("week", "concept_id", "subject").agg(F.count("*").cast("int").alias("n_questions")).select("week", "concept_id", "n_questions", "subject")
    path = _written(spark, outcomes.where("week < 2"), checks.log_outcomes)
    checks.log_outcomes(outcomes, path)
    log = spark.read.schema(outcomes.schema).json(path)
    order = W.partitionBy("week").orderBy(F.md5(F.concat("concept_id", F.col("week").cast("string"))), "concept_id")
    scored = checks.rescore(log, outcomes.select("week", "concept_id", F.row_number().over(order).alias("rank")))
    return scored.select(F.col("list_id").alias("week"), F.round("recall", 6).alias("recall"), F.round("weighted_recall", 6).alias("weighted_recall"))


@query("""SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS lines FROM documents WHERE text IS NOT NULL""")
def line_slice(spark, sf):
    """The second and third line of every text."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 2, 2), "\n").alias("lines"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""WITH w AS (SELECT doc_id, lower(unnest(ws)) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\\x{{0980}}-\\x{{09FF}}]{{3,}}|[a-zA-Z]{{4,}}') AS ws FROM documents)),
 c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM w WHERE word NOT IN ({_STOP}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM c),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY rank) AS keywords FROM r WHERE rank <= 10 GROUP BY 1)
 SELECT doc_id, coalesce(keywords, '') AS keywords, CAST(length(text) AS INTEGER) AS char_count FROM documents LEFT JOIN k USING (doc_id)""")
def enriched_chunks(spark, sf):
    """Chunks with their keywords and counts."""
    made = enrich.enrich(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return made.select("doc_id", F.array_join("keywords", " ").alias("keywords"), "char_count")


@query("""SELECT conv_id, turn, text || ' [' || turn || ']' AS joined FROM conversations""")
def message_blocks(spark, sf):
    """Text blocks of messages, joined; other blocks are left out."""
    block = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    blocks = F.array(block("text", F.col("text")), block("image", F.lit("never")), block("text", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]"))))
    return table(spark, sf, "conversations").select("conv_id", "turn", messages.block_text(blocks, " ").alias("joined"))


@query("""SELECT item_id, '\\frac{' || item_id || '}{x^{2}}+\\sqrt{y}(a,b;c)' AS latex FROM benchmark""")
def formulas(spark, sf):
    """MathML as LaTeX."""
    head = "<math><mfrac><mn>"
    tail = "</mn><msup><mi>x</mi><mn>2</mn></msup></mfrac><mo>+</mo><msqrt><mi>y</mi></msqrt><mfenced separators=\",;\"><mi>a</mi><mi>b</mi><mi>c</mi></mfenced></math>"
    return table(spark, sf, "benchmark").select("item_id", legacy.latex(F.concat(F.lit(head), F.col("item_id").cast("string"), F.lit(tail))).alias("latex"))


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'কলম' ELSE 'মাটা' END || ' ' || repeat('ক', CAST(1 + item_id % 3 AS INTEGER)) AS text, CAST(CASE WHEN item_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS unmapped FROM benchmark""")
def legacy_text(spark, sf):
    """Text of the legacy encoding, and glyphs without a mapping."""
    raw = F.concat(F.when(F.col("item_id") % 2 == 0, "Kjg").otherwise("gvUv"), F.lit(" "), F.expr("repeat('K', int(1 + item_id % 3))"), F.when(F.col("item_id") % 5 == 0, "¶").otherwise(""))
    found = table(spark, sf, "benchmark").select("item_id", legacy.decode_legacy(raw).alias("d"))
    return found.select("item_id", F.replace("d.text", F.lit("¶"), F.lit("")).alias("text"), F.size("d.unmapped").cast("long").alias("unmapped"))


@query("""SELECT '¶' AS glyph, count(*) AS n FROM benchmark WHERE item_id % 5 = 0 HAVING count(*) > 0 UNION ALL SELECT 'þ', 2 * count(*) FROM benchmark WHERE item_id % 3 = 0 HAVING count(*) > 0""")
def unmapped_glyphs(spark, sf):
    """How often glyphs without a mapping come."""
    return checks.unmapped_glyphs(_decoded(spark, sf))


@query("""SELECT count(*) AS questions, CAST(count_if(item_id % 5 <> 0 AND item_id % 3 <> 0) AS BIGINT) AS clean, round(avg(CAST(item_id % 5 <> 0 AND item_id % 3 <> 0 AS INTEGER)), 6) AS clean_rate FROM benchmark""")
def decode_report(spark, sf):
    """Questions that were decoded without leftovers."""
    return checks.decode_report(_decoded(spark, sf)).withColumn("clean_rate", F.round("clean_rate", 6))


def _decoded(spark, sf):
    raw = F.concat(F.lit("Kjg"), F.when(F.col("item_id") % 5 == 0, "¶").otherwise(""), F.when(F.col("item_id") % 3 == 0, "þþ").otherwise(""))
    return table(spark, sf, "benchmark").select("item_id", legacy.decode_legacy(raw).alias("decoded"))


@query("""SELECT item_id, replace(text, 'e', '') || ' ⟦M1⟧ and ⟦M2⟧' AS text FROM benchmark""")
def formula_tokens(spark, sf):
    """Formulas replaced by numbered tokens."""
    body = F.concat(F.replace("text", F.lit("e"), F.lit("")), F.lit(" #e1# and #e2#"))
    return table(spark, sf, "benchmark").select("item_id", T.number_math(body, F.array(F.lit("#e1#"), F.lit("#e2#"))).alias("text"))


@query("""SELECT item_id, nfc_normalize('e' || chr(769) || ' ' || text || ' o' || chr(776)) AS text FROM benchmark""")
def composed_letters(spark, sf):
    """Canonical composition."""
    return table(spark, sf, "benchmark").select("item_id", T.nfc(F.concat(F.lit("é "), "text", F.lit(" ö"))).alias("text"))


@query("""SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Z][a-z]?[0-9]*(?:[A-Z][a-z]?[0-9]*)*'), '|') AS formulas FROM documents WHERE text IS NOT NULL""")
def chemical_formulas(spark, sf):
    """Words that may be chemical formulas."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.array_join(T.extract("text", T.CHEMICAL), "|").alias("formulas"))


@query("""WITH RECURSIVE up AS (SELECT doc_id AS concept_id, doc_id // 2 AS ancestor, 1 AS level FROM documents WHERE doc_id >= 2 UNION ALL SELECT concept_id, ancestor // 2, level + 1 FROM up WHERE ancestor >= 2)
 SELECT concept_id, ancestor, level FROM up""")
def concept_tree(spark, sf):
    """All ancestors of every concept of a binary tree."""
    tree = table(spark, sf, "documents").select(F.col("doc_id").alias("concept_id"), F.when(F.col("doc_id") >= 2, F.expr("doc_id div 2")).alias("parent"))
    return checks.ancestors(tree).select("concept_id", "ancestor", "level")


@query("""SELECT file, CAST(q_index AS INTEGER) AS q_index, text FROM (SELECT 'f' || item_id % 3 || '.pdf' AS file, item_id AS q_index, left(text, 200) AS text, item_id % 4 = 0 AND trim(text, ' ') <> '' AS hit FROM benchmark) WHERE hit""")
def unknown_topics(spark, sf):
    """Questions whose topic nobody knows."""
    q = F.struct(F.when(F.col("item_id") % 4 == 0, "Unknown").otherwise("x").alias("topic"), "text", F.col("item_id").cast("int").alias("q_index"))
    given = table(spark, sf, "benchmark").groupBy(F.concat(F.lit("a/f"), (F.col("item_id") % 3).cast("string"), F.lit(".pdf")).alias("path")).agg(F.collect_list(q).alias("questions"))
    return checks.unknown_topics(given)


@query("""WITH g AS (SELECT unnest(['e', 'q']) AS glyph), r AS (SELECT glyph, item_id AS qid, row_number() OVER (PARTITION BY glyph ORDER BY item_id) AS place FROM g JOIN benchmark ON contains(text, glyph) OR (glyph = 'q' AND item_id % 6 = 0))
 SELECT glyph, CASE glyph WHEN 'e' THEN 'U+0065' ELSE 'U+0071' END AS code_point, qid, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def glyph_search(spark, sf):
    """The first questions that hold some glyphs."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("raw"), F.array(F.when(F.col("item_id") % 6 == 0, "x q").otherwise("")).alias("option_math"))
    return checks.glyph_search(q, ["e", "q"])


@query("""WITH RECURSIVE up AS (SELECT doc_id AS concept_id, doc_id // 2 AS root, 1 AS depth FROM documents WHERE doc_id >= 2 UNION ALL SELECT concept_id, root // 2, depth + 1 FROM up WHERE root >= 2)
 SELECT concept_id, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY 1""")
def concept_roots(spark, sf):
    """The root and the depth of every concept of a binary tree."""
    tree = table(spark, sf, "documents").select(F.col("doc_id").alias("concept_id"), F.when(F.col("doc_id") >= 2, F.expr("doc_id div 2")).alias("parent"))
    return checks.roots(tree)


_STYLE = """q AS (SELECT doc_id, lang AS subject, regexp_replace(text, '[0-9]', '', 'g') || ' ' || doc_id || ' and ' || doc_id || '.5' AS stem FROM documents),
 o AS (SELECT subject, unnest(CASE doc_id % 3 WHEN 0 THEN ['negated', 'shifted point', 'other number'] WHEN 1 THEN ['doubled or halved', 'next to it', 'other text'] ELSE ['negated', 'same digits', 'other number'] END) AS pattern FROM q),
 c AS (SELECT subject, pattern, count(*) AS n, row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, pattern) AS place FROM o GROUP BY 1, 2)"""


@query(f"""WITH {_STYLE}, s AS (SELECT subject, array_to_string(list_transform(quantile_disc(length(stem), [0.1, 0.5, 0.9]), lambda x: CAST(x AS VARCHAR)), ',') AS stems, CAST(min(doc_id) AS DOUBLE) AS least, max(doc_id) + 0.5 AS most, 4 AS options FROM q GROUP BY 1)
 SELECT subject, stems, least, CAST(most AS DOUBLE) AS most, CAST(options AS INTEGER) AS options, distractors FROM s JOIN (SELECT subject, string_agg(pattern, ', ' ORDER BY place) AS distractors FROM c WHERE place <= 3 GROUP BY 1) USING (subject)""")
def house_style(spark, sf):
    """Stem lengths, numeric ranges, numbers of options and usual distractors of each subject's questions."""
    made = checks.house_style(_styled(spark, sf), accuracy=1_000_000)
    return made.select("subject", F.array_join(F.transform("stem_length", lambda x: x.cast("string")), ",").alias("stems"), "least", "most", "options", F.array_join("distractors", ", ").alias("distractors"))


@query(f"WITH {_STYLE} SELECT subject, pattern, n, round(n / sum(n) OVER (PARTITION BY subject), 6) AS share FROM c")
def distractor_patterns(spark, sf):
    """How wrong options are made of right ones, by subject."""
    return checks.distractor_patterns(_styled(spark, sf), top=len(checks.DISTRACTORS)).select("subject", "pattern", "n", F.round("share", 6).alias("share"))


def _styled(spark, sf):
    """Documents as stems with a number, and options of known making: answer 420 or 210."""
    docs = table(spark, sf, "documents")
    stem = F.concat(F.regexp_replace("text", "[0-9]", ""), F.lit(" "), F.col("doc_id").cast("string"), F.lit(" and "), F.col("doc_id").cast("string"), F.lit(".5"))
    sets = [("420", "-420", "4.2", "77"), ("210", "105", "211", "none"), ("420", "-420", "204", "99")]
    one = lambda texts: F.array(*[F.struct(F.lit(x).alias("letter"), F.lit(t).alias("text")) for x, t in zip("ABCD", texts, strict=True)])
    options = F.when(F.col("doc_id") % 3 == 0, one(sets[0])).when(F.col("doc_id") % 3 == 1, one(sets[1])).otherwise(one(sets[2]))
    return docs.select(F.col("lang").alias("subject"), stem.alias("question_text"), options.alias("options"), F.lit("A").alias("correct_letter"))


def _sections(spark, sf):
    """Replies of a made-up model that finds a first and an invented phrase in every item."""
    quote, found = F.left("text", F.lit(12)), F.col("item_id").cast("string")
    one = lambda label, q: F.struct(label.alias("label_en"), F.array(F.lit("x")).alias("aliases_bn"), F.array(F.lit("matching")).alias("typical_forms"), F.lit(3).alias("difficulty_1_5"), q.alias("grounding_quote_bn"))
    reply = F.to_json(F.struct(F.array(one(F.concat(F.lit("concept "), found), quote), one(F.lit("made up"), F.lit("@@ nowhere @@"))).alias("concepts")))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("section_id"), F.col("text").alias("section_text"), messages.json_reply(F.concat(F.lit("Here:\n"), reply)).alias("json"))


@query("""SELECT item_id AS section_id, 'concept ' || item_id AS label_en, left(text, 12) AS quote FROM benchmark""")
def extracted_concepts(spark, sf):
    """Concepts that models find in sections, if their quotes stand there."""
    return completions.concepts(_sections(spark, sf))[0].select("section_id", "label_en", F.col("grounding_quote_bn").alias("quote"))


@query("""SELECT item_id AS section_id, 'made up' AS label_en FROM benchmark""")
def dropped_concepts(spark, sf):
    """The log of concepts without grounds."""
    return completions.concepts(_sections(spark, sf))[1].select("section_id", "label_en")


def _generated(spark, sf):
    q = lambda stem, n, answer: F.struct(stem.alias("question_bn"), F.array(*[F.lit(x) for x in "pqrs"[:n]]).alias("options_bn"), answer.alias("answer"), F.lit("s").alias("worked_solution_bn"), F.lit("recall").alias("question_form"))
    letter = _pick(F.col("item_id") % 5, *"ABCDE")
    reply = F.to_json(F.struct(F.array(q(F.col("text"), 4, letter), q(F.col("text"), 3, F.lit("A"))).alias("questions")))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("concept_id"), reply.alias("json"))


@query("""SELECT item_id AS concept_id, text AS question_bn, (['A', 'B', 'C', 'D'])[CAST(item_id % 5 AS INTEGER) + 1] AS answer FROM benchmark WHERE item_id % 5 < 4 AND trim(text, ' ') <> ''""")
def generated_questions(spark, sf):
    """Well-formed questions of replies."""
    return completions.generated_questions(_generated(spark, sf))[0].select("concept_id", "question_bn", "answer")


@query("""SELECT item_id AS concept_id, count(*) AS malformed FROM (SELECT item_id FROM benchmark UNION ALL SELECT item_id FROM benchmark WHERE item_id % 5 = 4 OR trim(text, ' ') = '') GROUP BY 1""")
def malformed_questions(spark, sf):
    """Questions of replies that break the rules."""
    return completions.generated_questions(_generated(spark, sf))[1].groupBy("concept_id").agg(F.count("*").alias("malformed"))


@query("""SELECT item_id, 'CONCEPT: ' || text || chr(10) || 'FORM: recall {x}' AS prompt FROM benchmark""")
def filled_prompts(spark, sf):
    """Prompts from a template."""
    prompt = completions.fill("CONCEPT: {concept}\nFORM: {form}", concept=F.col("text"), form=F.lit("recall {x}"))
    return table(spark, sf, "benchmark").select("item_id", prompt.alias("prompt"))


def _replies(spark, sf):
    """A made-up client that fails on some prompts, asked with a cache of a third of them."""
    prompts = table(spark, sf, "conversations").where("turn = 0").select((F.col("conv_id") % 40).cast("string").alias("key")).withColumn("prompt", F.concat(F.lit("p"), "key"))

    def client(prompt: str) -> str:
        if int(prompt[1:]) % 7 == 0:
            raise completions.HttpError(503)
        return f'{{"a": "{prompt}"}}' if int(prompt[1:]) % 5 else "no json"

    cache = prompts.where("int(key) % 3 = 0").select("key", F.concat(F.lit('["'), "key", F.lit('"]')).alias("reply")).distinct()
    path = _written(spark, cache, lambda d, p: completions.store_cache(d, p))
    completions.store_cache(cache, path)
    return completions.complete(prompts, completions.read_cache(spark, path), client, sleep=lambda s: None)[0]


_ASKED = "p AS (SELECT conv_id % 40 AS k FROM conversations WHERE turn = 0)"


@query(f"""WITH {_ASKED} SELECT CAST(k AS VARCHAR) AS key, CASE WHEN k % 3 = 0 THEN '["' || k || '"]' WHEN k % 7 = 0 OR k % 5 = 0 THEN NULL ELSE '{{"a": "p' || k || '"}}' END AS json, k % 3 = 0 AS cached, CAST(CASE WHEN k % 3 = 0 THEN 0 WHEN k % 7 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempts FROM p""")
def model_replies(spark, sf):
    """Replies to prompts: cached, asked once each, retried on failure."""
    return _replies(spark, sf).select("key", "json", "cached", F.col("attempts").cast("int").alias("attempts"))


@query(f"""WITH {_ASKED}, d AS (SELECT DISTINCT k FROM p) SELECT CAST(sum(CASE WHEN k % 3 = 0 THEN 0 WHEN k % 7 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS calls, CAST(count_if(k % 3 = 0) AS BIGINT) AS cache_hits, CAST(count_if(k % 3 <> 0 AND k % 7 = 0) AS BIGINT) AS failures,
 CAST(count_if(k % 3 <> 0 AND k % 7 <> 0 AND k % 5 = 0) AS BIGINT) AS unreadable FROM d""")
def client_counters(spark, sf):
    """Calls, cache hits, failures and unreadable replies."""
    return completions.stats(_replies(spark, sf))


@query("""SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS batch FROM documents""")
def call_batches(spark, sf):
    """Batches of five chunks of a book."""
    rows = table(spark, sf, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("chunk_id"))
    return completions.batches(rows).select(F.col("chunk_id").alias("doc_id"), "batch")


@query("""SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL""")
def grounded_quotes(spark, sf):
    """Quotes that stand in their sources."""
    quote = F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(20))).otherwise(F.lit("@@ nowhere @@"))
    return completions.grounded(table(spark, sf, "documents").select("doc_id", F.col("text").alias("source"), quote.alias("quote"))).select("doc_id")
