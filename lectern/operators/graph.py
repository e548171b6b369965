"""Connected components of an edge table, by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import discard, materialise


def components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 100) -> DataFrame:
    """One row (node, component) per node of ``edges``; component is the smallest node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest node next to it. Rows per round never exceed a few times the edges, and the
    number of rounds grows with the logarithm of the longest path. Null ends and self
    loops are ignored; repeated edges count once; no edges give no rows. Raises if the rounds
    run out before the labels are settled.
    """
    pairs = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
        .distinct()
    )
    pairs = materialise(pairs)
    before, settled = _mark(pairs), False
    for _ in range(max_rounds):
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(pairs.select("hi", "lo"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.where("lo <> hi").distinct()
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = (
            large.withColumnRenamed("hi", "u")
            .join(least, "u")
            .select(F.col("m").alias("lo"), F.explode(F.array("lo", "u")).alias("hi"))
            .where("lo <> hi")
            .distinct()
        )
        last, pairs = pairs, materialise(small)
        discard(last)
        now = _mark(pairs)
        settled = now == before
        if settled:
            break
        before = now
    if not settled:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        pairs.select("lo", "lo").distinct()
    )


def merge_components(known: DataFrame, links: DataFrame, src: str = "a", dst: str = "b") -> tuple[DataFrame, DataFrame]:
    """``known`` (node, component) with the ``links`` of new rows worked in, and the aliases (alias, component) that this makes.

    Only the components that new links touch are joined with one another; what was known
    isn't gone through again. The result is that of components() over all links so far, and
    each component's old ids that it no longer has are its aliases. Ends of links that
    ``known`` lacks are new nodes, components of their own before.
    """
    links = materialise(links.select(src, dst))  # read several times, and made once
    end = lambda c: links.select(F.col(c).alias("node")).where("node is not null")
    fresh = end(src).union(end(dst)).distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    before = materialise(known.select("node", "component").unionByName(fresh))
    at = lambda c: before.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    edges = links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").join(at("a"), "a").join(at("b"), "b")
    # A component's name is the smallest of its nodes, so the smallest of the joined names is that of the whole.
    moved = components(edges, "a_component", "b_component").where("node <> component").select(F.col("node").alias("alias"), F.col("component").alias("now"))
    moved = materialise(moved)
    discard(links)
    after = before.join(moved, before["component"] == moved["alias"], "left").select("node", F.coalesce("now", "component").alias("component"))
    return after, moved.select("alias", F.col("now").alias("component"))


def merge_aliases(known: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases (alias, component) of earlier merges with those of a ``new`` one: each leads to the component of today."""
    led = known.join(new.select(F.col("alias").alias("component"), F.col("component").alias("now")), "component", "left")
    return led.select("alias", F.coalesce("now", "component").alias("component")).unionByName(new)


def _mark(pairs: DataFrame) -> tuple:
    """Row count and content sums, equal when a round changed nothing."""
    h = F.xxhash64("lo", "hi")
    row = pairs.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))), F.sum(F.shiftrightunsigned(h, 33))).first()
    return tuple(row)
