"""An inverted file over vectors: cells around fitted centres, of which a query probes a few.

Centres are fitted on a bounded sample; every row of the corpus is assigned and written.
Probing is approximate; ``exact=True`` goes on with every cell that could still hold a nearer
vector: a row is no nearer to the query, in angle, than the query is to the cell's
centre less the cell's radius.
"""

from __future__ import annotations

from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.retrieve import BLOCK_ROWS, TILE_CELLS, _cells, _near_cells, _ranked, _unit, _vectors
from lectern.session import materialise

#: Rows, those of smallest id hash, on which centres are fitted, and sample rows a centre needs at least.
SAMPLE_ROWS, ROWS_PER_CELL = 1 << 14, 16
#: What rounding may add to a cosine.
_SLACK = 1e-9


class Cells(NamedTuple):
    """Unit centres, each cell's least cosine to its centre, and the corpus by cell (cell, id, v, dim and metadata)."""

    centres: np.ndarray
    reach: np.ndarray
    rows: DataFrame


def fit_centres(vectors: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of ``cells`` groups of unit vectors by cosine; the first rows are the start, an empty cell keeps its centre."""
    centres = vectors[:cells].copy()
    for _ in range(rounds):
        own = _nearest(vectors, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, cosine, step = np.zeros(len(x), dtype=np.int64), np.zeros(len(x)), max(1, TILE_CELLS // len(centres))
    for a in range(0, len(x), step):
        s = x[a : a + step] @ centres.T
        own[a : a + step] = s.argmax(1)
        cosine[a : a + step] = s.max(1)
    return own, cosine


def _rows_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False)
    return _unit(flat.reshape(batch.num_rows, -1))


def build(corpus: DataFrame, cid: str = "vec_id", vector: str = "embedding", metadata: tuple[str, ...] = (), cells: int | None = None, sample: int = SAMPLE_ROWS) -> Cells:
    """Cells over every usable vector of the sample's commonest length; by default as many cells as the root of their number.

    ``metadata`` columns are kept beside the vectors, for filters that come before the probe.
    """
    vectors = _vectors(corpus, cid, vector, *metadata)
    dims = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return Cells(np.zeros((0, 0)), np.zeros(0), vectors.withColumns({"cell": F.lit(0).cast("long"), "near": F.lit(0.0)}))
    vectors = vectors.where(F.col("dim") == dims[0]["dim"])
    some = vectors.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().combine_chunks()
    x = np.concatenate([_rows_of(b, "v") for b in some.to_batches()])
    n = cells or isqrt(dims[0]["count"])
    centres = fit_centres(x, max(1, min(n, len(x) // ROWS_PER_CELL)))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                own, cosine = _nearest(_rows_of(batch, "v"), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(cosine)], names=[*batch.schema.names, "cell", "near"])

    schema = vectors.withColumns({"cell": F.lit(0).cast("long"), "near": F.lit(0.0)}).schema
    # By range of cell and id: a cell of any size is spread over tasks, and files hold few cells each.
    rows = materialise(vectors.mapInArrow(assign, schema).repartitionByRange("cell", "id").sortWithinPartitions("cell"))
    reach = np.ones(len(centres))
    for r in rows.groupBy("cell").agg(F.min("near").alias("least")).collect():  # one row a centre
        reach[r["cell"]] = r["least"]
    return Cells(centres, reach, rows)


def _probes(asked: DataFrame, index: Cells, probes: int, further: bool) -> DataFrame:
    """cell, id, v and dim of the ``probes`` nearest cells of each query; with ``further`` the other cells that may hold a cosine of ``least`` or more."""
    centres, radius = index.centres, np.arccos(np.clip(index.reach, -1, 1))

    def choose(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = _rows_of(batch, "v") @ centres.T
            first = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            chosen = np.zeros(s.shape, dtype=bool)
            np.put_along_axis(chosen, first, True, axis=1)
            if further:
                best = np.cos(np.maximum(0, np.arccos(np.clip(s, -1, 1)) - radius))
                chosen = ~chosen & (best >= batch.column(batch.schema.get_field_index("least")).to_numpy(zero_copy_only=False)[:, None] - _SLACK)
            row, cell = np.nonzero(chosen)
            some = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(cell), some.column(0), some.column(1), some.column(2)], names=["cell", "id", "v", "dim"])

    return asked.mapInArrow(choose, "cell long, id long, v array<double>, dim int")


def search(
    queries: DataFrame, index: Cells, k: int = 8, probes: int = 8, exact: bool = False, where: Column | None = None,
    qid: str = "q_id", cid: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """qid, cid, cosine and rank of the k nearest rows in the ``probes`` cells nearest to each query, ties by cid.

    Only rows of probed cells travel, one copy for each block of queries that probe their
    cell. ``where`` filters the corpus by its metadata before the probe. With ``exact`` the
    result is that of all rows.
    """
    asked = _vectors(queries, qid, vector)
    asked = asked.where(F.col("dim") == index.centres.shape[1]) if len(index.centres) else asked.limit(0)
    held = (index.rows.where(where) if where is not None else index.rows).select("cell", "id", "v")
    near = lambda rows: _near_cells(_cells(rows.drop("dim"), held, "cell", block_rows), "cell", k)
    found = near(_probes(asked, index, probes, False))
    if exact:
        found = materialise(found)
        kth = _ranked(found, k, "id", "other").groupBy("id").agg(F.when(F.count("*") == k, F.min("cosine")).alias("least"))
        open_ = asked.join(kth, "id", "left").select("id", "v", "dim", F.coalesce("least", F.lit(-2.0)).alias("least"))
        found = found.unionByName(near(_probes(open_, index, probes, True)))
    return _ranked(found, k, qid, cid)


def recall(found: DataFrame, exact: DataFrame, qid: str = "q_id", cid: str = "vec_id") -> DataFrame:
    """queries, neighbours (exact pairs) and recall: the share of them that was found."""
    hit = found.select(qid, cid).withColumn("_hit", F.lit(1))
    return exact.join(hit, [qid, cid], "left").agg(F.count_distinct(qid).alias("queries"), F.count("*").alias("neighbours"), F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(1.0)).alias("recall"))
