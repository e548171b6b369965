"""Cosine retrieval, deduplication and repeat matching over vector columns.

Rows that have to be compared are dealt into blocks of bounded size, and each pair of blocks
meets in one task, which multiplies them tile by tile. Nothing but counts reaches the driver.

Vectors that are null, empty or hold a null or non-finite number are compared with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from lectern.functions import text as T
from lectern.operators.graph import components
from lectern.session import materialise

#: Rows that always fit one block, and products worked on at once (8 MB).
BLOCK_ROWS = 2048
#: Blocks into which vectors to be paired are dealt, and so copies of a row, until a block has this many numbers (32 MB).
BLOCKS, BLOCK_NUMBERS = 16, 1 << 22
TILE_CELLS = 1 << 20
#: Most numbers of all query vectors together that are sent to every task (32 MB); more queries are dealt into blocks.
SENT_NUMBERS = 1 << 22


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _block_counts(rows: DataFrame, key: str, name: str, block_rows: int) -> DataFrame:
    """Blocks of each key. Those of vectors (v) grow with the rows, so that the copies that pairs of blocks take do not."""
    most = F.lit(block_rows)
    if "v" in rows.columns:
        most = F.greatest(most, F.least(F.count("*") / BLOCKS, F.lit(BLOCK_NUMBERS) / F.max(F.size("v"))))
    return rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias(name))


def _own_block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(7)), F.col(blocks)).cast("int")


def _dealt(rows: DataFrame, other: DataFrame, own: str, key: str, block_rows: int) -> DataFrame:
    """``rows`` (key, id, ...) with its block in column ``own`` and one copy for each block of ``other`` under the same key.

    ``rows`` are on side ``own`` (p or q) of the pairs of blocks; keys that ``other`` lacks drop out.
    """
    there = "q" if own == "p" else "p"
    shaped = rows.join(_block_counts(rows, key, "_mine", block_rows), key).join(_block_counts(other, key, "_theirs", block_rows), key)
    return shaped.withColumn(own, _own_block("_mine")).withColumn(there, F.explode(F.sequence(F.lit(0), F.col("_theirs") - 1))).drop("_mine", "_theirs")


def _cells(left: DataFrame, right: DataFrame, key: str, block_rows: int) -> DataFrame:
    """Rows of both frames by key and pair of blocks (p, q), those of ``left`` (side 0) before those of ``right`` (side 1)."""
    x = _dealt(left, right, "p", key, block_rows).withColumn("side", F.lit(0))
    y = _dealt(right, left, "q", key, block_rows).withColumn("side", F.lit(1))
    return x.unionByName(y).repartition(key, "p", "q").sortWithinPartitions(key, "p", "q", "side")


def _own_cells(rows: DataFrame, key: str, block_rows: int) -> DataFrame:
    """Rows by key and pair of blocks (p, q) with p <= q, each pair once: side 0 is block p, side 1 is block q; of p = q there is side 0 only."""
    shaped = rows.join(_block_counts(rows, key, "_n", block_rows), key).withColumn("_own", _own_block("_n")).withColumn("_there", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = shaped.withColumns({"p": F.least("_own", "_there"), "q": F.greatest("_own", "_there"), "side": (F.col("_own") > F.col("_there")).cast("int")})
    return dealt.drop("_n", "_own", "_there").repartition(key, "p", "q").sortWithinPartitions(key, "p", "q", "side")


def _cells_before(left: DataFrame, right: DataFrame, key: str, time: str, block_rows: int) -> DataFrame:
    """Rows as of _cells(), but only pairs of blocks in which a row of ``right`` can be earlier, by ``time``, than one of ``left``.

    Consecutive times of a key form a slice of about ``block_rows`` rows, and a larger one is
    dealt into blocks; slices that begin no earlier than the other ends are never paired.
    """

    def shaped(rows: DataFrame, block: str) -> tuple[DataFrame, DataFrame]:
        upto = W.partitionBy(key).orderBy(time).rowsBetween(W.unboundedPreceding, 0)  # a row for each time of a key
        counted = rows.groupBy(key, time).agg(F.count("*").alias("_n"))
        sliced = counted.withColumn("_slice", F.floor((F.sum("_n").over(upto) - F.col("_n")) / block_rows))
        sizes = sliced.groupBy(key, "_slice").agg(F.sum("_n").alias("_n"), F.min(time).alias("_lo"), F.max(time).alias("_hi"))
        sizes = sizes.withColumn("_parts", F.ceil(F.col("_n") / block_rows).cast("int"))
        placed = rows.join(sliced.drop("_n"), [key, time]).join(sizes.select(key, "_slice", "_parts"), [key, "_slice"])
        name = lambda part: F.xxhash64("_slice", part)
        blocks = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(key, name(F.col("_part")).alias(block), "_lo", "_hi")
        return placed.withColumn(block, name(_own_block("_parts"))).drop("_slice", "_parts"), blocks

    (x, x_blocks), (y, y_blocks) = shaped(left, "p"), shaped(right, "q")
    pairs = x_blocks.withColumnRenamed("_hi", "_end").select(key, "p", "_end").join(y_blocks.select(key, "q", "_lo"), key).where("_lo < _end").select(key, "p", "q")
    x = x.join(pairs, [key, "p"]).withColumn("side", F.lit(0))
    y = y.join(pairs, [key, "q"]).withColumn("side", F.lit(1))
    return x.unionByName(y).repartition(key, "p", "q").sortWithinPartitions(key, "p", "q", "side")


def _runs(batches, key: str) -> Iterator[tuple[object, pa.Table, pa.Table]]:
    """(key, rows of side 0, rows of side 1) of each cell of sorted batches, as Arrow tables."""
    at, parts = None, []

    def cell():
        table = pa.Table.from_batches(parts)
        first = int(pa.compute.sum(pa.compute.equal(table.column("side"), 0)).as_py() or 0)
        return at[0], table.slice(0, first), table.slice(first)

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        columns = [batch.column(names.index(c)) for c in (key, "p", "q")]
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = np.any([pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns], axis=0)
        starts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for i, j in zip(starts, starts[1:], strict=False):
            here = tuple(c[i].as_py() for c in columns)
            if here != at:
                if parts:
                    yield cell()
                at, parts = here, []
            parts.append(batch.slice(i, j - i))
    if parts:
        yield cell()


def _groups(batches, fields: list[str], key: str):
    """(key, rows of side 0, rows of side 1) of each cell of sorted batches, as tuples."""
    for at, *sides in _runs(batches, key):
        yield at, *([tuple(r) for r in zip(*(side.column(c).to_pylist() for c in fields), strict=True)] for side in sides)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of rows whose vectors have one length."""
    ids = table.column("id").to_numpy()
    flat = pa.concat_arrays([c.flatten() for c in table.column("v").chunks]) if table.num_rows else pa.array([], pa.float64())
    return ids, _unit(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))


def _usable(v: Column) -> Column:
    """Whether a vector has numbers, and only finite ones."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def _vectors(df: DataFrame, vid: str, vector: str, *more: str) -> DataFrame:
    """id, v and the length of v, which is the key under which vectors can be compared; unusable vectors are left out."""
    v = F.col(vector).cast("array<double>")
    return df.where(_usable(v)).select(F.col(vid).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"), *more)


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """id, other and cosine of the k nearest rows of ``x`` to each row of ``q``, ties by id, in tiles of bounded size."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    step, n = max(1, TILE_CELLS // len(ids)), min(k, len(ids))
    for a in range(0, len(q_ids), step):
        s = q[a : a + step] @ x.T
        near = np.argpartition(-s, n - 1, axis=1)[:, n - 1]  # the n-th best value; ties with it are all looked at
        least = s[np.arange(len(s)), near]
        row, col = np.nonzero(s >= least[:, None])
        at = np.lexsort((ids[col], -s[row, col], row))
        row, col = row[at], col[at]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < n
        row, col = row[keep], col[keep]
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[a + row]), pa.array(ids[col]), pa.array(s[row, col])], names=["id", "other", "cosine"])


_NEAR = "id long, other long, cosine double"


def _near_cells(cells: DataFrame, key: str, k: int) -> DataFrame:
    """The k nearest rows of side 1 to each row of side 0 of each cell."""

    def best(batches):
        for _, asked, held in _runs(batches, key):
            if asked.num_rows and held.num_rows:
                yield from _best(*_matrix(asked), *_matrix(held), k)

    return cells.mapInArrow(best, _NEAR)


def _sent_to(asked: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each batch of ``corpus`` to each of few queries, which travel to the corpus."""
    by_dim = {}
    for r in asked.orderBy("id").toLocalIterator():  # at most SENT_NUMBERS numbers, as counted before
        by_dim.setdefault(r["dim"], []).append((r["id"], r["v"]))
    held = asked.sparkSession.sparkContext.broadcast({d: (np.array([i for i, _ in rows]), _unit(np.array([v for _, v in rows]))) for d, rows in by_dim.items()})

    def best(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dim, (q_ids, q) in held.value.items():
                own = table.filter(pa.compute.equal(table.column("dim"), dim))
                if own.num_rows:
                    yield from _best(q_ids, q, *_matrix(own), k)

    return corpus.mapInArrow(best, _NEAR)


def _ranked(found: DataFrame, k: int, qid: str, cid: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(qid).orderBy(F.desc("cosine"), cid))
    return found.select(F.col("id").alias(qid), F.col("other").alias(cid), "cosine").withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 8, qid: str = "q_id", cid: str = "vec_id", vector: str = "embedding", where=None, block_rows: int = BLOCK_ROWS, sent: int = SENT_NUMBERS) -> DataFrame:
    """qid, cid, cosine and rank of the k nearest corpus vectors of each query, ties by cid.

    Every query meets every corpus vector of its length, and each task keeps the k best for a
    query. Queries of up to ``sent`` numbers together are counted and go to the corpus, which
    then stays where it is; more are dealt, with the corpus, into pairs of blocks. ``where`` filters the corpus first.
    """
    asked, held = _vectors(queries, qid, vector), _vectors(corpus.where(where) if where is not None else corpus, cid, vector)
    few = (asked.agg(F.sum("dim").alias("n")).first()["n"] or 0) <= sent
    return _ranked(_sent_to(asked, held, k) if few else _near_cells(_cells(asked, held, "dim", block_rows), "dim", k), k, qid, cid)


def retrieval_ceiling(neighbours: DataFrame, truth: DataFrame, labels: DataFrame, qid: str = "q_id", cid: str = "vec_id") -> DataFrame:
    """Share of queries with a neighbour of the right label, and with it ranked first.

    ``truth`` has qid and label; ``labels`` has cid and label.
    """
    hits = (
        neighbours.join(labels.withColumnRenamed("label", "found"), cid).join(truth, qid)
        .groupBy(qid).agg(F.max((F.col("found") == F.col("label")).cast("int")).alias("hit"), F.max(((F.col("found") == F.col("label")) & (F.col("rank") == 1)).cast("int")).alias("first"))
    )
    return hits.agg(F.count("*").alias("queries"), F.avg("hit").alias("ceiling"), F.avg("first").alias("first_rate"))


def _buckets(vectors: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """Each vector once per table, keyed by the signs of its products with ``bits`` fixed random directions."""

    def sign(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim in set(batch.column(2).to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column(2), dim))
                at = planes.get(dim)
                if at is None:
                    at = planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, tables * bits))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                key = ((x @ at).reshape(len(x), tables, bits) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                for t in range(tables):
                    keys = (key[:, t] * tables + t) * (1 << 20) + dim
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys)], names=["id", "v", "dim"])

    return vectors.mapInArrow(sign, "id long, v array<double>, dim long")


def _keyed(vectors: DataFrame, vid: str, vector: str, tables: int, bits: int, seed: int) -> DataFrame:
    """_vectors(), or their _buckets() where ``tables`` are wanted."""
    rows = _vectors(vectors, vid, vector)
    return _buckets(rows, tables, bits, seed) if tables else rows


def _above(batches, threshold: float, within: bool):
    """Ids of both sides of each cell, with tiles of (places on side 0, places on side 1, cosines) of what is above the threshold.

    ``within`` one table (_own_cells()) a block with itself has side 0 only, which meets itself.
    """

    def tiles(x, y):
        step = max(1, TILE_CELLS // len(y))
        for at in range(0, len(x), step):
            s = x[at : at + step] @ y.T
            i, j = np.nonzero(s > threshold)
            yield at + i, j, s[i, j]

    for _, left, right in _runs(batches, "dim"):
        if left.num_rows and right.num_rows:
            (a, x), (b, y) = _matrix(left), _matrix(right)
            yield a, b, tiles(x, y)
        elif within and left.num_rows and left.column("p")[0] == left.column("q")[0]:
            a, x = _matrix(left)
            yield a, a, tiles(x, x)


def _pairs(cells: DataFrame, threshold: float, within: bool) -> DataFrame:
    """(a, b, cosine) with a < b of all pairs above the threshold in each cell."""

    def pairs(batches):
        for a, b, tiles in _above(batches, threshold, within):
            for i, j, s in tiles:
                one, two = a[i], b[j]
                keep = one < two if a is b else one != two
                one, two = one[keep], two[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(s[keep])], names=["a", "b", "cosine"])

    return cells.mapInArrow(pairs, "a long, b long, cosine double")


def _stars(cells: DataFrame, threshold: float, within: bool) -> DataFrame:
    """(a, b) with a < b: each row b of a cell with the smallest id a that pairs above the threshold lead to within the cell."""

    def stars(batches):
        for a, b, tiles in _above(batches, threshold, within):
            ids = np.unique(np.concatenate([a, b]))
            at_a, at_b = np.searchsorted(ids, a), np.searchsorted(ids, b)
            low = np.arange(len(ids))
            for i, j, _ in tiles:
                _lower(low, at_a[i], at_b[j])
            moved = np.flatnonzero(low != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[low[moved]]), pa.array(ids[moved])], names=["a", "b"])

    return cells.mapInArrow(stars, "a long, b long")


def _lower(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Work links i - j into ``low``, which has the smallest place of each place's component."""
    while True:
        x, y = low[i], low[j]
        apart = x != y
        if not apart.any():
            return
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low[:] = low[low]


def similar_pairs(
    vectors: DataFrame, threshold: float = 0.92, vid: str = "vec_id", vector: str = "embedding", tables: int = 0, bits: int = 12, seed: int = 11, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(a, b, cosine) with a < b above the threshold.

    By default exact: each vector meets every other of its length. With ``tables`` only vectors
    that share a sign bucket in one of so many tables meet: work then grows with the buckets,
    and pairs whose signs differ in every table are missed. Two vectors at angle t share a
    bucket of one table with probability (1 - t / pi) ** bits.
    """
    found = _pairs(_own_cells(_keyed(vectors, vid, vector, tables, bits, seed), "dim", block_rows), threshold, within=True)
    return found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")) if tables else found


def similar_to(new: DataFrame, known: DataFrame, threshold: float = 0.92, vid: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, cosine) with a < b above the threshold of pairs with a ``new`` row: among these, and with the ``known`` ones, which don't meet each other."""

    across = _pairs(_cells(_vectors(new, vid, vector), _vectors(known, vid, vector), "dim", block_rows), threshold, within=False)
    return across.unionByName(similar_pairs(new, threshold, vid, vector, block_rows=block_rows))


def links(
    vectors: DataFrame, threshold: float = 0.92, vid: str = "vec_id", vector: str = "embedding", tables: int = 0, bits: int = 12, seed: int = 11, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(a, b) with a < b whose components are those of similar_pairs(): at most one a row and cell, however many pairs there are.

    A link need not be a similar pair itself; similar pairs within the cell lead from one end to the other.
    """
    return _stars(_own_cells(_keyed(vectors, vid, vector, tables, bits, seed), "dim", block_rows), threshold, within=True)


def links_to(new: DataFrame, known: DataFrame, threshold: float = 0.92, vid: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) with a < b whose components are those of similar_to(), as links() has them for similar_pairs()."""
    across = _stars(_cells(_vectors(new, vid, vector), _vectors(known, vid, vector), "dim", block_rows), threshold, within=False)
    return across.unionByName(links(new, threshold, vid, vector, block_rows=block_rows))


def deduplicate(vectors: DataFrame, threshold: float = 0.92, vid: str = "vec_id", vector: str = "embedding", tables: int = 0, bits: int = 12) -> DataFrame:
    """vid and canonical: the smallest id that similar pairs lead to; ids without pairs stand for themselves.

    Equal vectors are one class: classes are compared, and their members follow them.
    """
    v = F.col(vector).cast("array<double>")
    key = F.sha2(F.to_json(F.struct(F.transform(v, lambda x: x + 0.0).alias("v"))), 256)  # -0.0 counts as 0.0
    classed = vectors.where(_usable(v)).select(vid, vector, key.alias("_class"))
    heads = classed.groupBy("_class").agg(F.min(vid).alias("_head"))
    members = materialise(classed.select(vid, "_class").join(heads, "_class").select(vid, "_head"))
    distinct = classed.join(heads, (classed["_class"] == heads["_class"]) & (F.col(vid) == F.col("_head"))).select(vid, vector).dropDuplicates([vid])
    found = components(links(distinct, threshold, vid, vector, tables, bits))
    placed = members.join(found, F.col("_head") == F.col("node"), "left").select(vid, F.coalesce("component", "_head").alias("canonical"))
    return placed.unionByName(vectors.where(~F.coalesce(_usable(v), F.lit(False))).select(vid, F.col(vid).alias("canonical")))


def same_numbers(a: Column, b: Column) -> Column:
    return T.number_list(a) == T.number_list(b)


def repeats(
    new: DataFrame, bank: DataFrame, structural: float = 0.85, exact: float = 0.92, form: bool = False, block_rows: int = BLOCK_ROWS, time: str | None = None
) -> DataFrame:
    """Best match tier of each new question against earlier ones of its concept.

    Both have qid, concept_id, embedding and text (and form). Tiers: verbatim (equal text),
    exact (cosine of ``exact`` or more and the same numbers), structural (``structural`` or
    more; with ``form`` the same form and other numbers), conceptual (the concept only), none.

    With ``time``, a whole number that both have, only questions of strictly smaller time are
    earlier ones; a question without time then meets none and is met by none.

    A concept's questions are dealt into blocks, so one with a third of all rows is spread over
    many tasks; each task puts out the best tier of its new questions.
    """
    fields = ["id", "concept_id", "embedding", "text", "numbers", "form", "time"]
    shape = lambda df: df.select(
        F.col("qid").alias("id"), "concept_id", F.col("embedding").cast("array<double>").alias("embedding"), T.strip("text").alias("text"),
        F.array_join(T.number_list("text"), " ").alias("numbers"), (F.col("form") if form else F.lit(None)).cast("string").alias("form"),
        (F.col(time) if time else F.lit(0)).cast("long").alias("time"),
    )
    fresh, earlier = (shape(df).where("id is not null and concept_id is not null and time is not null") for df in (new, bank))
    keys = new.select("qid", "concept_id")
    types = StructType([StructField(f.name, f.dataType) for f in keys.schema] + [StructField("tier_no", IntegerType())])
    kinds = to_arrow_schema(types)

    def best(batches):
        for concept, asked, held in _groups(batches, fields, "concept_id"):
            if not (asked and held):
                continue
            tiers = np.zeros(len(asked), dtype=np.int8)
            _raise_tiers(tiers, _columns(asked, fields), _columns(held, fields), structural, exact, form, bool(time))
            hits = [(r[0], concept, t) for r, t in zip(asked, tiers.tolist(), strict=True) if t]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], kinds.field(i).type) for i in range(3)], names=kinds.names)

    cells = _cells_before(fresh, earlier, "concept_id", "time", block_rows) if time else _cells(fresh, earlier, "concept_id", block_rows)
    found = cells.mapInArrow(best, types)
    names = F.array(*[F.lit(x) for x in ("none", "conceptual", "structural", "exact", "verbatim")])
    every = keys.withColumn("tier_no", F.lit(0)).unionByName(found)
    return every.groupBy("qid", "concept_id").agg(F.max("tier_no").alias("tier_no")).withColumn("tier", F.element_at(names, F.col("tier_no") + 1))


def _columns(rows: list[tuple], fields: list[str]) -> dict:
    """Columns of question rows; vectors of one length are stacked, as (places, unit vectors) by length."""
    out = {c: [r[i] for r in rows] for i, c in enumerate(fields)}
    places: dict[int, list[int]] = {}
    for i, v in enumerate(out.pop("embedding")):
        if v and None not in v and any(v):
            places.setdefault(len(v), []).append(i)
    at = fields.index("embedding")
    out["unit"] = {n: (np.array(x), _unit(np.array([rows[i][at] for i in x], dtype=np.float64))) for n, x in places.items()}
    return out


def _raise_tiers(tiers: np.ndarray, new: dict, bank: dict, structural: float, exact: float, form: bool, earlier: bool = False) -> None:
    """Raise the tiers of new questions to what rows of the bank of their concept give, in tiles of bounded size."""
    code = {c: _codes(new[c], bank[c]) for c in ("id", "text", "numbers", "form")}
    m = len(bank["id"])
    asked_at, held_at = (np.array(x["time"]) for x in (new, bank))
    step = max(1, TILE_CELLS // m)
    for a in range(0, len(tiers), step):
        n = min(step, len(tiers) - a)
        sim = np.full((n, m), -np.inf)
        for dim, (at, x) in new["unit"].items():
            if dim in bank["unit"]:
                here = slice(*np.searchsorted(at, (a, a + n)))
                y_at, y = bank["unit"][dim]
                sim[np.ix_(at[here] - a, y_at)] = x[here] @ y.T
        same = {c: (x[a : a + n, None] == y[None, :]) & (x[a : a + n, None] >= 0) for c, (x, y) in code.items()}
        alike = sim >= structural
        if form:
            x, y = code["numbers"]
            alike &= same["form"] & ~same["numbers"] & (x[a : a + n, None] >= 0) & (y[None, :] >= 0)
        tier = np.where(same["text"], 4, np.where((sim >= exact) & same["numbers"], 3, np.where(alike, 2, 1)))
        out_of_turn = same["id"] | (held_at[None, :] >= asked_at[a : a + n, None]) if earlier else same["id"]
        np.maximum(tiers[a : a + n], np.where(out_of_turn, 0, tier).max(axis=1).astype(np.int8), out=tiers[a : a + n])


def _codes(x: list, y: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where values are; -1 for nulls."""
    known: dict = {}
    return tuple(np.array([-1 if v is None else known.setdefault(v, len(known)) for v in z], dtype=np.int64) for z in (x, y))


def repeat_history(questions: DataFrame, new: Column, structural: float = 0.85, exact: float = 0.92, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """qid, subject, history and tier_no of each new question against three histories of its concept.

    ``questions`` has qid, subject, concept_id, embedding, text, week and kind (bank, daily
    or weekly); ``new`` says which are asked about. Histories: the bank as a whole, the
    dailies of the question's own week, and the weeklies of strictly earlier weeks.
    """
    asked, of = questions.where(new), lambda kind: questions.where(F.col("kind") == kind)
    both = F.when(F.col("concept_id").isNotNull() & F.col("week").isNotNull(), F.to_json(F.struct("concept_id", "week")))
    in_week = lambda df: df.withColumn("concept_id", both)
    match = lambda x, y, **more: repeats(x, y, structural, exact, block_rows=block_rows, **more).select("qid", "tier_no")
    same_week = match(in_week(asked), in_week(of("daily")))
    found = {"bank": match(asked, of("bank")), "daily": same_week, "weekly": match(asked, of("weekly"), time="week")}
    out = None
    for history, tiers in found.items():
        rows = tiers.withColumn("history", F.lit(history))
        out = rows if out is None else out.unionByName(rows)
    return out.join(asked.select("qid", "subject"), "qid")


def history_rates(matched: DataFrame) -> DataFrame:
    """By subject and history: the rates of verbatim repeats, of equal numbers in other words, and of equal structure with other numbers."""
    rate = lambda tier: F.avg((F.col("tier_no") == tier).cast("double"))
    return matched.groupBy("subject", "history").agg(F.count("*").alias("questions"), rate(4).alias("verbatim"), rate(3).alias("same_numbers"), rate(2).alias("same_structure"))


def reuse_rates(matched: DataFrame, *by: str) -> DataFrame:
    """Shares of questions at each tier or better, and what the exact rate decides."""
    share = lambda n: F.avg((F.col("tier_no") >= n).cast("double"))
    rates = matched.groupBy(*by).agg(F.count("*").alias("questions"), share(4).alias("verbatim"), share(3).alias("exact"), share(2).alias("structural"))
    return rates.withColumn("decision", F.when(F.col("exact") >= 0.3, "reuse").when(F.col("exact") >= 0.1, "mixed").otherwise("generate"))
