"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-gram hash of each run of ``window - k + 1``
consecutive k-grams, so two texts that share ``window`` consecutive words share a
fingerprint. Document fingerprints that a benchmark item also has are extended to whole
windows, whose words are then hit.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. An item
with fewer words than a window, but not none, is one window of its own length and is
looked up at every word. Null and empty texts have no words and no hits; items without
words occur nowhere; repeated rows each get a row; documents' other columns are ignored.
Windows of items without an id are hit like others, and all such items count as one: a null
among the items, first in their order. Items of one id count as one item, whatever their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bitmap import bitmap_of, bits_for, holds
from lectern.llm.words import ALNUM, U64, Words, slices, text_column
from lectern.session import bounded_batches, free_names, materialise

WINDOW = 10
GRAM = 5
#: Benchmarks of up to so many rows of benchmark_windows() are sent to every task with their
#: items. A full window has up to window - k + 1 rows.
BROADCAST_WINDOWS = 200_000
#: Of larger ones up to so many windows are sent as sorted hashes (32 MB) and a bitmap of
#: grams, and only true hits join their items; beyond that bitmaps of at most 128 MB each rule
#: out most places, and what is left joins the windows. Results are the same.
SENT_WINDOWS = 1 << 22

#: The column of row numbers in the join.
ROW = "_row"

_TOP = U64(0xFFFFFFFFFFFFFFFF)


def fingerprints(w: Words, k: int, window: int) -> np.ndarray:
    """Positions of words whose k-gram hash is the least of some run of window - k + 1."""
    h, ok = w.grams(k)
    run = window - k + 1
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    h = np.where(ok, h, _TOP)
    padded = np.concatenate([h, np.full(run - 1, _TOP, dtype=U64)])
    least = np.lib.stride_tricks.sliding_window_view(padded, run).min(axis=1)
    chosen = np.zeros(len(h), dtype=bool)
    for j in range(run):  # every place that holds the least hash of a run
        end = len(h) - j
        chosen[j:] |= h[j:] == least[:end]
    return np.flatnonzero(chosen & ok)


def _window_rows(batches, window, k):
    """Per benchmark batch: the windows of each item, as (length, hash, item_id, grams)."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("item_id")).to_pylist()
        out = {"size": [], "hash": [], "item_id": [], "gram": []}
        for first, last, data, offsets in slices(text_column(batch)):
            w = Words(data, offsets, ALNUM)
            for i in range(last - first):
                a, n = w.bounds[i], int(w.counts[i])
                if not n:
                    continue
                size = min(n, window)
                hashes = _grams_of(w.hashes[a : a + n], size)
                prints = _grams_of(w.hashes[a : a + n], k) if n >= window else None
                for j, h in enumerate(hashes):
                    grams = prints[j : j + window - k + 1].view(np.int64).tolist() if prints is not None else [0]
                    for g in set(grams):
                        out["size"].append(size)
                        out["hash"].append(int(h.view(np.int64)))
                        out["item_id"].append(None if ids[first + i] is None else str(ids[first + i]))
                        out["gram"].append(g)
        yield pa.RecordBatch.from_pydict(
            out, schema=pa.schema([("size", pa.int32()), ("hash", pa.int64()), ("item_id", pa.string()), ("gram", pa.int64())])
        )


def _grams_of(hashes: np.ndarray, k: int) -> np.ndarray:
    w = Words.__new__(Words)
    w.hashes, w.doc = hashes, np.zeros(len(hashes), dtype=np.int64)
    return w.grams(k)[0]


class Index:
    """Benchmark windows as tasks know them: hashes by length, and the grams that lead to full windows.

    ``by_size`` holds the sorted hashes of each length, or, where they are too many, a bitmap and its
    bits for all lengths; ``grams`` is a sorted array or a bitmap and its bits. A bitmap misses none.
    """

    def __init__(self, sizes: list[int], by_size, grams, window: int, k: int):
        self.sizes, self.by_size, self.grams, self.window, self.k = sizes, by_size, grams, window, k
        self.exact = isinstance(by_size, dict)

    def known(self, size: int, hashes: np.ndarray) -> np.ndarray:
        return _known(hashes, self.by_size[size]) if self.exact else holds(self.by_size[0], hashes.view(np.int64), self.by_size[1])

    def leads(self, grams: np.ndarray) -> np.ndarray:
        return holds(self.grams[0], grams.view(np.int64), self.grams[1]) if isinstance(self.grams, tuple) else _known(grams, self.grams)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and hash of the places where a window occurs, or may occur if this isn't exact."""
        found = []
        for size in self.sizes:
            h, ok = w.grams(size)
            if not len(h):
                continue
            if size < self.window:
                at = np.flatnonzero(ok)
            else:
                at = fingerprints(w, self.k, self.window)
                at = at[self.leads(w.grams(self.k)[0][at])]
                near = np.unique(at[:, None] - np.arange(size - self.k + 1)[None, :])
                near = near[(near >= 0) & (near < len(h))]
                at = near[ok[near]]
            at = at[self.known(size, h[at])]
            found.append((at, np.full(len(at), size), h[at].view(np.int64)))
        return tuple(np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in range(3))


def _small_index(rows, window: int, k: int) -> tuple[Index, dict[tuple[int, int], list[str | None]]]:
    """The index of a bounded number of windows, and the items behind each."""
    items: dict[tuple[int, int], set[str | None]] = {}
    grams = set()
    for r in rows:
        items.setdefault((r["size"], r["hash"]), set()).add(r["item_id"])
        if r["size"] == window:
            grams.add(r["gram"])
    as_u64 = lambda xs: np.sort(np.array(sorted(xs), dtype=np.int64).view(U64))
    by_size = {n: as_u64({h for s, h in items if s == n}) for n in {s for s, _ in items}}
    return Index(sorted(by_size), by_size, as_u64(grams), window, k), items


def _known(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), dtype=bool)
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h


_REPORT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<bigint>>, found array<struct<at:bigint,size:int,hash:bigint>>"


def _scan(batches, held):
    """Per document: words, hit words, items (if sent) and hit spans in words, and unless items are sent the places found.

    ``held`` is the broadcast index and items, or None. What bitmaps let through is no hit yet; then there are no spans.
    """
    index, items = held.value
    at_type = pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int32()), ("hash", pa.int64())]))
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        n = batch.num_rows
        words, hit, named, spans, found = np.zeros(n, np.int64), np.zeros(n, np.int64), [[]] * n, [[]] * n, [[]] * n
        for first, last, data, offsets in slices(text_column(batch)):
            w = Words(data, offsets, ALNUM)
            words[first:last] = w.counts
            at, size, hashes = index.hits(w)
            doc = w.doc[at]
            order = np.lexsort((size, at, doc))
            bounds = np.searchsorted(doc[order], np.arange(last - first + 1))
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                own = order[bounds[i] : bounds[i + 1]]
                places = list(zip((at[own] - int(w.bounds[i])).tolist(), size[own].tolist(), hashes[own].tolist(), strict=True))
                if items is None:
                    found[first + i] = [{"at": p, "size": n_, "hash": h} for p, n_, h in places]
                if not index.exact:
                    continue
                merged: list[list[int]] = []
                for p, n_, _ in places:
                    if merged and p <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], p + n_)
                    else:
                        merged.append([p, p + n_])
                hit[first + i], spans[first + i] = sum(b - a for a, b in merged), merged
                if items is not None:
                    named[first + i] = sorted(set().union(*(items[n_, h] for _, n_, h in places)), key=lambda x: (x is not None, x or ""))
        columns = [ids.cast(pa.int64()), pa.array(words), pa.array(hit), pa.array(named, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(found, at_type)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "items", "spans", "found"])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """(size, hash, item_id, gram): the windows of all items and the k-grams inside them."""
    return benchmark.select("item_id", "text").mapInArrow(
        lambda it: _window_rows(it, window, k), "size int, hash long, item_id string, gram long"
    )


def _large_index(windows: DataFrame, window: int, k: int, sent: int) -> Index:
    """The index of ``windows`` without items; its hashes are a bitmap if there are more than ``sent``."""
    distinct = windows.select("size", "hash").distinct()
    number = {r["size"]: r["count"] for r in distinct.groupBy("size").count().collect()}  # one row a length
    grams = windows.where(F.col("size") == window).select("gram").distinct()
    bits = bits_for(grams.count())
    leads, sizes = (bitmap_of(grams, bits), bits), sorted(number)
    if sum(number.values()) > sent:
        bits = bits_for(sum(number.values()))
        return Index(sizes, (bitmap_of(distinct.select("hash"), bits), bits), leads, window, k)
    rows = distinct.toArrow()
    of, hashes = rows["size"].to_numpy(), rows["hash"].to_numpy()
    return Index(sizes, {n: np.sort(hashes[of == n].astype(np.int64).view(U64)) for n in sizes}, leads, window, k)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS, sent_windows: int = SENT_WINDOWS
) -> DataFrame:
    """Per document: n_words, n_hit, the items (sorted strings) whose windows occur, and the hit word spans."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts, windows = docs.select("doc_id", "text"), benchmark_windows(benchmark, window, k)
    if _are_few(windows, broadcast_windows):
        held = spark.sparkContext.broadcast(_small_index(windows.toLocalIterator(), window, k))
        return texts.mapInArrow(lambda it: _scan(it, held), _REPORT).drop("found")
    windows = materialise(windows)
    index = _large_index(windows, window, k, sent_windows)
    held, exact = spark.sparkContext.broadcast((index, None)), index.exact
    # One row a document, written with its number; what was found in it meets windows and items by joins.
    report = materialise(texts.mapInArrow(lambda it: _scan(it, held), _REPORT).withColumn(ROW, F.monotonically_increasing_id()))
    hits = report.select(ROW, F.inline("found"))
    if not exact:
        hits = materialise(hits.join(windows.select("size", "hash").distinct(), ["size", "hash"], "left_semi"))
        spans = hits.groupBy(ROW).agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("end")))).alias("places")).select(ROW, _merged("places").alias("spans"))
        report = report.drop("spans", "n_hit").join(spans, ROW, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<array<bigint>>")))
        report = report.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0]))
    behind = windows.select("size", "hash", "item_id").distinct()
    named = hits.select(ROW, "size", "hash").distinct().join(behind, ["size", "hash"]).groupBy(ROW).agg(F.sort_array(F.collect_set(F.struct("item_id"))).alias("named"))
    out = report.drop("items").join(named, ROW, "left").withColumn("items", F.coalesce(F.col("named.item_id"), F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "n_hit", "items", "spans")


def _are_few(windows: DataFrame, limit: int) -> bool:
    return windows.select("size", "hash", "item_id").limit(limit + 1).count() <= limit


def _merged(places: str):
    """Touching and overlapping (at, end) in order as spans."""
    return F.aggregate(
        places,
        F.array().cast("array<array<bigint>>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (p["at"] <= F.element_at(F.element_at(acc, -1), 2)),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.array(F.element_at(F.element_at(acc, -1), 1), F.greatest(F.element_at(F.element_at(acc, -1), 2), p["end"]))),
            ),
        ).otherwise(F.concat(acc, F.array(F.array(p["at"], p["end"])))),
    )


def digest(report: DataFrame) -> DataFrame:
    """The columns of query op9 from a contamination report."""
    return report.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS, sent_windows: int = SENT_WINDOWS) -> DataFrame:
    """Documents without any hit, with the columns they came with.

    Works in place on the rows, whose items needn't be known, while hashes can be sent, and by
    a join on row numbers beyond. Each row is kept or dropped by its own text, whatever its id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    windows = benchmark_windows(benchmark)
    if _are_few(windows, broadcast_windows):
        index = _small_index(windows.toLocalIterator(), WINDOW, GRAM)[0]
    else:
        windows = materialise(windows)
        index = _large_index(windows, WINDOW, GRAM, sent_windows)
    held, exact = spark.sparkContext.broadcast(index), index.exact

    def clean(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for first, _, data, offsets in slices(text_column(batch)):
                w = Words(data, offsets, ALNUM)
                keep[first + w.doc[held.value.hits(w)[0]]] = False
            yield batch.filter(pa.array(keep))

    if exact:
        return docs.mapInArrow(clean, docs.schema)
    (row,) = free_names(docs.columns, ROW)
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()))

    def places(batches):
        for batch in batches:
            for first, _, data, offsets in slices(text_column(batch)):
                w = Words(data, offsets, ALNUM)
                at, size, hashes = held.value.hits(w)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + w.doc[at])), pa.array(size.astype(np.int32)), pa.array(hashes)], names=["row", "size", "hash"])

    found = rows.select(F.col(row).alias("row"), "text").mapInArrow(places, "row long, size int, hash long")
    hit = found.distinct().join(windows.select("size", "hash").distinct(), ["size", "hash"], "left_semi").select(F.col("row").alias(row)).distinct()
    return rows.join(hit, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
