"""Values of groups brought back to their rows, where one group may hold most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups with this share of all rows or more are few enough to be sent to every task: at most as many as this number.
HOT_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their group; every row has one, and ``groups`` holds one row a group.

    ``size`` is the column of ``groups`` with the number of its rows, which is dropped in the
    end if ``rows`` needn't know it (name it without an underscore to keep it). The keys ``on``
    are never null. Groups of a thousandth of all rows or more, at most HOT_GROUPS of them by
    their number, are broadcast, so no task of the join gets more than that share for one key.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col(size) * HOT_GROUPS >= F.lit(max(total, 2 * HOT_GROUPS))
    hot, other = groups.where(is_hot), groups.where(~is_hot)
    in_hot = rows.join(F.broadcast(hot), on)
    in_other = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(other, on)
    return in_hot.unionByName(in_other)
