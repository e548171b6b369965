"""Numbers that tell rows apart where a doc_id repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import free_names, materialise

#: The number of a row; underscores are added where a column has this name.
ROW = "_row"


def numbered(docs: DataFrame, differing: bool = False, nulls: bool = False) -> tuple[DataFrame, str] | None:
    """``docs`` with a written number for each row and that column's name, if a doc_id repeats (with ``differing`` texts), else None.

    With ``nulls`` a missing id counts as an id.
    """
    named = (docs if nulls else docs.where("doc_id is not null")).groupBy("doc_id")
    if named.count().where("count > 1").isEmpty():
        return None
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    if differing and named.agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").isEmpty():
        return None
    (row,) = free_names(docs.columns, ROW)
    return materialise(docs.withColumn(row, F.monotonically_increasing_id())), row
