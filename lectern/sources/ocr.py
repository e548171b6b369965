"""Recognition of page images: an injected engine, one instance per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import bounded_batches
from lectern.sources.files import ocr_text, row_batches

_engines: dict[str, object] = {}


def pick_device(available: list[str], wanted: bool = True) -> str:
    """cuda before xpu before cpu."""
    return next((d for d in ("cuda", "xpu") if wanted and d in available), "cpu")


def page_images(files: DataFrame, open_pdf: Callable[[bytes, int], list[bytes]], dpi: int = 200, max_pages: int | None = None) -> DataFrame:
    """path, page_num (from 1), png and error of PDF contents; a broken file gives one row with error and no image."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                try:
                    yield from [(path.as_py(), i + 1, png, None) for i, png in enumerate(open_pdf(bytes(content.as_py()), dpi)[: max_pages or None])]
                except Exception as e:  # a broken file is a result here, not a failure
                    yield path.as_py(), 0, None, str(e)[:500]

    kinds = pa.schema([("path", pa.string()), ("page_num", pa.int32()), ("png", pa.binary()), ("error", pa.string())])
    bounded_batches(files.sparkSession, size="4m")
    return files.select("path", "content").mapInArrow(lambda batches: row_batches(rows(batches), kinds), "path string, page_num int, png binary, error string")


def recognise(images: DataFrame, make_engine: Callable[[], Callable[[bytes], list[tuple[str, float]]]], name: str = "ocr", min_confidence: float = 0.3) -> DataFrame:
    """Pages (path, page_num, text, avg_confidence, has_bengali, block_count, char_count) from images.

    The engine is made once per worker; filtering, joining and averaging stay in the JVM.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = _engines.get(name) or _engines.setdefault(name, make_engine())
        for b in batches:
            blocks = [[{"text": t, "confidence": float(c)} for t, c in engine(bytes(png))] for png in b["png"]]
            yield pd.DataFrame({"path": b["path"], "page_num": b["page_num"], "blocks": blocks})

    found = images.where("png is not null").select("path", "page_num", "png").mapInPandas(run, "path string, page_num int, blocks array<struct<text: string, confidence: double>>")
    return found.withColumn("o", ocr_text(F.col("blocks"), min_confidence)).select("path", "page_num", "o.*", F.length("o.text").alias("char_count"))


def spans(rows: DataFrame, legacy_fonts: str = "(?i)sutonny|bijoy") -> DataFrame:
    """Font spans (path, page_num, font, text) with their encoding, and whether their page needs an image."""
    from pyspark.sql import Window as W

    page = F.sum(F.length(F.trim("text"))).over(W.partitionBy("path", "page_num"))
    return rows.withColumn("encoding", F.when(F.rlike("font", F.lit(legacy_fonts)), "bijoy").otherwise("unicode")).withColumn("needs_image", page < 20)


def image_fraction(pages: DataFrame) -> DataFrame:
    """Share of pages that go to recognition."""
    return pages.agg(F.avg(F.col("needs_image").cast("double")).alias("image_fraction"))
