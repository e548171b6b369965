"""Legacy Bengali font text and MathML as Unicode and LaTeX: Python functions, as Spark has none."""

from __future__ import annotations

import re
import unicodedata
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Glyphs confirmed so far; a fuller table is a parameter.
GLYPHS = {
    "†": "ে", "‡": "ে", "©": "র্", "¨": "্য", "Ý": "ন্স", "¼": "ঙ্ক", "K¡": "ক্ষ", "r": "্",
    "K": "ক", "g": "ম", "v": "া", "U": "ট", "_": "থ", "m": "স", "e": "ব", "j": "ল", "Š": "ৗ",
}
PRE_VOWELS = "†‡"
REPH = "©"
_VIRAMA, _E, _AA, _AU_MARK = "্", "ে", "া", "ৗ"
_BENGALI = re.compile("[ঀ-৿]")
_CONSONANT = re.compile("[ক-হড়ঢ়য়ৎ]")

DECODED = StructType([
    StructField("text", StringType()),
    StructField("unmapped", ArrayType(StructType([StructField("glyph", StringType()), StructField("count", IntegerType())]))),
])


class LegacyDecoder:
    """Visual-order font text to logical-order Unicode.

    Glyphs match longest first. A vowel sign written before its consonants moves behind
    the cluster, a reph before it; two-part vowels are composed and the result is NFC.
    """

    def __init__(self, glyphs: dict[str, str] | None = None):
        self.glyphs = glyphs or GLYPHS
        self.match = re.compile("|".join(re.escape(g) for g in sorted(self.glyphs, key=len, reverse=True)) + "|.", re.S)

    def decode(self, text: str | None) -> dict | None:
        if text is None:
            return None
        if _BENGALI.search(text):
            return {"text": unicodedata.normalize("NFC", text), "unmapped": []}
        units: list[str] = []  # clusters and single signs, in logical order
        unmapped: dict[str, int] = {}
        waiting = ""
        for glyph in self.match.findall(text):
            if glyph in PRE_VOWELS:
                waiting = self.glyphs[glyph]
                continue
            sign = self.glyphs.get(glyph)
            if sign is None:
                sign = glyph
                if ord(glyph) > 127:
                    unmapped[glyph] = unmapped.get(glyph, 0) + 1
                    sign = ""
            if glyph == REPH and units:
                units[-1] = sign + units[-1]
            elif units and (sign.startswith(_VIRAMA) or (units[-1].endswith(_VIRAMA) and _CONSONANT.match(sign))):
                units[-1] = self._join(units[-1], sign)
            elif waiting and _CONSONANT.match(sign):
                units.append(sign + waiting)
                waiting = ""
            elif sign:
                units.append(sign)
        out = "".join(units) + waiting
        out = out.replace(_E + _AA, "ো").replace(_E + _AU_MARK, "ৌ")
        counts = [{"glyph": g, "count": n} for g, n in sorted(unmapped.items(), key=lambda x: (-x[1], x[0]))]
        return {"text": unicodedata.normalize("NFC", out), "unmapped": counts}

    @staticmethod
    def _join(cluster: str, sign: str) -> str:
        """``sign`` put at the end of the cluster's consonants, before a moved vowel."""
        return cluster[:-1] + sign + _E if cluster.endswith(_E) else cluster + sign


def decode_legacy(c: Column | str, glyphs: dict[str, str] | None = None) -> Column:
    """struct of text and unmapped glyphs with their counts."""
    decoder = LegacyDecoder(glyphs)

    @F.pandas_udf(DECODED)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [decoder.decode(t) or {"text": None, "unmapped": []} for t in texts]
        return pd.DataFrame(rows, columns=["text", "unmapped"])

    return run(c)


def is_clean(decoded: Column) -> Column:
    """Nothing unmapped and no leftover of the legacy encoding."""
    return (F.size(decoded["unmapped"]) == 0) & ~F.rlike(decoded["text"], F.lit("[\\u0080-\\u00FF†‡]"))


def _group(x: str) -> str:
    return "{" + x + "}"


def _row(e) -> str:
    return "".join(_latex(c) for c in e)


def _latex(e) -> str:
    tag = e.tag.rsplit("}", 1)[-1]
    kids = list(e)
    part = [_latex(c) for c in kids] if tag in _SHAPES else []
    if tag in _SHAPES:
        shape, n = _SHAPES[tag]
        return shape.format(*[_group(p) for p in part]) if len(part) == n else "".join(part)
    if tag == "mtable":
        return r"\begin{matrix}" + r" \\ ".join(" & ".join(_row(d) for d in r) for r in kids) + r"\end{matrix}"
    if tag == "msqrt":
        return r"\sqrt" + _group(_row(e))
    if tag == "mfenced":
        marks = "".join(e.get("separators", ",").split())
        glue = [marks[min(i, len(marks) - 1)] if marks else "" for i in range(len(kids) - 1)] + [""]
        return e.get("open", "(") + "".join(_latex(c) + g for c, g in zip(kids, glue, strict=False)) + e.get("close", ")")
    if tag == "mtext":
        return r"\text" + _group(e.text or "")
    if tag == "mspace":
        return r"\ "
    return (e.text or "").strip() + _row(e) if not kids else _row(e)


# Elements with a set number of parts.
_SHAPES = {
    "msup": ("{0}^{1}", 2), "msub": ("{0}_{1}", 2), "msubsup": ("{0}_{1}^{2}", 3), "mfrac": (r"\frac{0}{1}", 2), "mroot": (r"\sqrt[{1}]{0}", 2),
    "mover": (r"\overset{1}{0}", 2), "munder": (r"\underset{1}{0}", 2), "munderover": ("{0}_{1}^{2}", 3),
}
_LONE = re.compile(r"\{([A-Za-z0-9]+)\}(?=[_^])")


def mathml_to_latex(source: str | None) -> str | None:
    """LaTeX of one MathML element; null if it can't be parsed."""
    if source is None:
        return None
    try:
        return _LONE.sub(r"\1", _latex(ElementTree.fromstring(source)))
    except ElementTree.ParseError:
        return None


@F.pandas_udf(StringType())
def latex(sources: pd.Series) -> pd.Series:
    return sources.map(mathml_to_latex)
