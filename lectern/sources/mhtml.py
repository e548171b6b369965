"""Saved web archives: parts, the page worth reading, and question blocks in it."""

from __future__ import annotations

import email
import email.policy
import html.parser
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import bounded_batches

# Classes of the archived exam pages.
BLOCK, SERIAL, STEM, OPTION = "questionBlock", "questionSerial", "questionText", "optionText"
OPTION_BLOCK, LETTER, MATH = "questionOption", "input-group-text", "math-tex"
LEGACY_SPAN = "pt-0000"


def _parts(raw: bytes) -> list[tuple[str, str]]:
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    out = []
    for part in message.walk():
        if part.get_content_maintype() == "text":
            body = part.get_payload(decode=True) or b""
            out.append((part.get_content_type(), body.decode("utf-8", "replace").replace("\r\n", "\n")))
    return out


def _page(parts: list[tuple[str, str]], css: bool) -> str:
    pages = [b for t, b in parts if t == "text/html"]
    if not pages:
        return ""
    page = next((p for p in pages if BLOCK in p or (css and STEM in p)), pages[-1])
    if css:
        sheets = "".join(f"<style>{b}</style>" for t, b in parts if t == "text/css")
        page = page.replace("</head>", sheets + "</head>", 1)
    return page


def pages(files: DataFrame, css: bool = False) -> DataFrame:
    """path and html: the part with questions, else the last one; with ``css`` its style sheets inlined."""
    bounded_batches(files.sparkSession, 500, "2m")  # a batch is held as archives, parts and pages at once

    @F.pandas_udf("string")
    def page(content: pd.Series) -> pd.Series:
        return content.map(lambda raw: _page(_parts(bytes(raw)), css) if raw is not None else None)

    out = files.select("path", page("content").alias("html"))
    if css:
        cid = F.regexp_replace("html", r"""<link[^>]+href=["']cid:[^>]*>""", "")
        out = out.withColumn("html", F.regexp_replace(cid, r"""src=["']cid:[^"']*["']""", 'src=""'))
    return out


class _Blocks(html.parser.HTMLParser):
    """Texts of elements with some classes, by question block."""

    VOID = frozenset(["br", "img", "input", "hr", "meta", "link", "wbr", "source", "col"])

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str | None] = []
        self.found: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        cls = (dict(attrs).get("class") or "").split()
        kind = next((k for k in (BLOCK, SERIAL, STEM, OPTION) if k in cls), LEGACY_SPAN if any(LEGACY_SPAN in c for c in cls) else None)
        self.stack.append(f"{tag}|{kind or ''}")
        if kind == BLOCK:
            self.found.append({"serial": "", "stem": "", "options": [], "legacy": []})
        elif kind == OPTION and self.found:
            self.found[-1]["options"].append("")
        elif kind == LEGACY_SPAN and self.found:
            self.found[-1]["legacy"].append("")

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].split("|")[0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        kinds = {x.split("|")[1] for x in self.stack}
        if BLOCK not in kinds or not self.found:
            return
        last = self.found[-1]
        if SERIAL in kinds:
            last["serial"] += data
        elif OPTION in kinds and last["options"]:
            last["options"][-1] += data
        elif STEM in kinds:
            last["stem"] += data
        if LEGACY_SPAN in kinds and last["legacy"]:
            last["legacy"][-1] += data


def _questions(page: str) -> list[dict]:
    p = _Blocks()
    p.feed(page or "")
    p.close()
    return [
        {"serial": b["serial"].strip(), "stem": b["stem"].strip(), "options": [x for x in map(str.strip, b["options"]) if x], "legacy": [x for x in b["legacy"] if x.strip()]}
        for b in p.found
    ]


def questions(archives: DataFrame) -> DataFrame:
    """path, q_index, question_text, options and legacy spans of each question block of ``archives`` (path, html)."""
    kind = "array<struct<serial: string, stem: string, options: array<string>, legacy: array<string>>>"

    @F.pandas_udf(kind)
    def blocks(page: pd.Series) -> pd.Series:
        return page.map(_questions)

    rows = archives.select("path", F.posexplode(blocks("html")).alias("i", "q"))
    number = F.coalesce(F.nullif(F.regexp_extract("q.serial", r"\d+", 0), F.lit("")).try_cast("int"), F.col("i") + 1)
    return rows.select("path", number.alias("q_index"), F.col("q.stem").alias("question_text"), "q.options", "q.legacy")


class _Nodes(html.parser.HTMLParser):
    """Text and formula nodes of question stems and options, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack: list[tuple[str, str]] = []
        self.rows: list[dict] = []
        self.block, self.math, self.option = -1, None, -1

    def _classes(self) -> list[str]:
        return [c for _, cls in self.stack for c in cls.split()]

    def handle_starttag(self, tag, attrs):
        cls = dict(attrs).get("class") or ""
        if self.math is not None:
            self.math += self.get_starttag_text()
        elif tag == "math" and MATH in self._classes():
            self.math = self.get_starttag_text()
        if tag in _Blocks.VOID:
            return
        self.stack.append((tag, cls))
        if BLOCK in cls.split():
            self.block, self.option = self.block + 1, -1
        if OPTION_BLOCK in cls.split():
            self.option += 1

    def handle_endtag(self, tag):
        if self.math is not None:
            self.math += f"</{tag}>"
            if tag == "math":
                self._put("math", self.math)
                self.math = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def _put(self, kind, value):
        where = self._classes()
        part = "option" if OPTION_BLOCK in where else "stem" if STEM in where else None
        if self.block >= 0 and part:
            cls = next((c for _, c in reversed(self.stack) if c), "")
            letter = LETTER in where
            self.rows.append({"block": self.block, "part": "letter" if letter else part, "option": self.option if part == "option" else None, "kind": kind, "value": value, "cls": cls})

    def _text(self, raw):
        if self.math is not None:
            self.math += raw
        elif not any(t in ("mjx-math", "script", "style") for t, _ in self.stack) and MATH not in self._classes():
            self._put("text", raw)

    handle_data = _text

    def handle_entityref(self, name):
        self._text(f"&{name};" if self.math is not None else unescape(f"&{name};"))

    def handle_charref(self, name):
        self._text(f"&#{name};" if self.math is not None else unescape(f"&#{name};"))


def raw_nodes(archives: DataFrame) -> DataFrame:
    """path, block, part (stem, letter or option), option, place, kind (text or math), value and cls of every node, in document order.

    Formulas are the assistive MathML inside; their visual rendering is skipped.
    """
    kind = "array<struct<block: int, part: string, option: int, kind: string, value: string, cls: string>>"

    @F.pandas_udf(kind)
    def walk(page: pd.Series) -> pd.Series:
        def one(x):
            p = _Nodes()
            p.feed(x or "")
            p.close()
            return p.rows

        return page.map(one)

    return archives.select("path", F.posexplode(walk("html")).alias("place", "n")).select("path", "n.block", "n.part", "n.option", "place", "n.kind", "n.value", "n.cls")


def legacy_strings(found: DataFrame) -> DataFrame:
    """Distinct places of spans in the legacy encoding: text in ASCII only, with 100 code points of context."""
    rows = found.select("path", "q_index", F.substring("question_text", 1, 100).alias("context"), F.explode("legacy").alias("raw_bijoy"))
    return rows.where(F.rlike("raw_bijoy", F.lit(r"^[\x00-\x7F]+$")) & (F.trim("raw_bijoy") != ""))
