"""Exact set-similarity self-join of documents on word n-grams, by prefix trees.

A document's set holds its distinct k-word shingles (words: runs without ASCII white
space, A-Z lower-cased); a text with fewer than k words, but not none, has its whole word
sequence as single element. Two documents link when 100 * |x & y| >= percent * |x | y|.
Shingles are compared as 64-bit hashes.

All sets are ordered by one global order, rare shingles first, as told by counts of all
shingles in a table of fixed size. Documents with equal sets form a class, whose smallest
doc_id stands for it. Linked classes share one of their first n - ceil(percent n / 100) + 1
shingles (their prefix), so each class is posted under its prefix only. Within a shingle's
postings the smallest class is the pivot, and each class is compared with its commonest
pivot first; what these links don't connect is then compared pair by pair, but only between
different components. Outlines (counts of a set's shingles by parts of the hash range)
bound overlaps from above and rule out most pairs before any set is moved. Comparisons run
pivot by pivot over a trie of the other sets, in the reverse order so that near copies
share long paths: a partial overlap is computed once for all sets below a node, and a
subtree is left when even its remaining length can't reach the threshold.

Texts that are null or have no words have an empty set and link with nothing. Rows with a
null doc_id take no part (null component). Every row is judged by its own text: repeated
rows are in one class, and where texts differ under one doc_id, the rows are told apart by
numbers of their own, and their component is still the smallest doc_id reachable. An empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.bitmap import bitmap_of, bits_for, holds
from lectern.llm.rows import numbered
from lectern.llm.words import SPACED, U64, Words, slices, text_column
from lectern.operators.graph import components
from lectern.session import bounded_batches, discard, materialise

#: Cells of the shingle counts that give the global order: 4 bytes each, whatever the corpus.
SKETCH_BITS = 20
#: Sets compared with a pivot in one task; more are split over tasks.
SETS_PER_PIVOT = 256
#: Shingles whose cell counts more than this, and more than CROWDED times the mean cell, may have
#: postings too many for one task and find their pivot by aggregation instead of in a sorted run.
HOT_CELL = 100_000
CROWDED = 4
#: Sets in one trie.
TRIE_SETS = 256
#: Members of a group whose outlines are compared in one task, with as many others.
#: Rows that a task collects before it hands them on.
PUT_ROWS = 20_000
GROUP_BLOCK = 2048
#: Sets, and shingles in them, of one block of a family.
FAMILY_SETS = 256
FAMILY_SHINGLES = 1 << 20

_PART = 1 << 16


def shingle_sets(col: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of each row of a text column."""
    for first, last, data, offsets in slices(col):
        w = Words(data, offsets, SPACED)
        h, ok = w.grams(k)
        for i in range(last - first):
            a, n = int(w.bounds[i]), int(w.counts[i])
            if n >= k:
                yield first + i, np.unique(h[a : a + n - k + 1])
            elif n:
                short = w.hashes[a : a + n].tobytes()
                yield first + i, np.array([xxhash.xxh3_64_intdigest(short)], dtype=U64)
            else:
                yield first + i, np.zeros(0, dtype=U64)


def shingle_counts(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How often shingles fall into each cell of a table of 2**bits cells, over all documents."""
    size = 1 << bits
    part = min(_PART, size)

    def count(batches):
        total = np.zeros(size, dtype=np.uint32)
        for batch in batches:
            for _, _, data, offsets in slices(text_column(batch)):
                h, ok = Words(data, offsets, SPACED).grams(k)
                total += np.bincount((h[ok] >> U64(64 - bits)).astype(np.int64), minlength=size).astype(np.uint32)
        rows = [(i, zstandard.compress(total[i * part : (i + 1) * part].tobytes(), 1)) for i in range(size // part)]
        yield _rows(rows, ["part", "counts"], [pa.int32(), pa.binary()])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(zstandard.decompress(raw), dtype=np.uint32)
                sums[i] = sums[i] + more if i in sums else more
        rows = [(i, zstandard.compress(x.tobytes(), 1)) for i, x in sums.items()]
        yield _rows(rows, ["part", "counts"], [pa.int32(), pa.binary()])

    schema = "part int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    out = np.zeros(size, dtype=np.uint32)
    for r in parts.toLocalIterator():
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(zstandard.decompress(bytes(r["counts"])), dtype=np.uint32)
    return out


def _rows(rows, names, kinds):
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def needed(n: int, percent: int) -> int:
    """The least overlap that a set of n shingles needs with any set it links to."""
    return (percent * n + 99) // 100


def profiles(docs: DataFrame, k: int, percent: int, counts, bits: int = SKETCH_BITS, hot: int = HOT_CELL) -> DataFrame:
    """Per row: doc_id, n_shingles, the class of its set, and the set's prefix in the global order.

    The prefix is in two parts; ``crowd`` holds the shingles that may be in very many sets.
    """

    def profile(batches):
        limit = max(hot, CROWDED * int(counts.value.mean()))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for i, s in shingle_sets(text_column(batch), k):
                n = len(s)
                if not n:
                    rows.append((ids[i], 0, None, [], [], None))
                    continue
                often = counts.value[(s >> U64(64 - bits)).astype(np.int64)]
                rare = np.argsort(often, kind="stable")[: n - needed(n, percent) + 1]
                prefix, crowded = s[rare].view(np.int64), often[rare] > limit
                cls = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                rows.append((ids[i], n, cls, prefix[~crowded], prefix[crowded], outline(s)))
            yield _rows(
                rows, ["doc_id", "n", "cls", "prefix", "crowd", "outline"],
                [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        profile, "doc_id long, n long, cls long, prefix array<bigint>, crowd array<bigint>, outline binary"
    )


def outline(s: np.ndarray) -> bytes:
    """How many shingles fall into each of about n / 2 equal parts of the hash range, half a byte each.

    The smaller counts of two outlines bound the overlap of their sets from above. Without
    an outline (tiny sets, or a count beyond half a byte) only sizes are compared.
    """
    b = _outline_bits(len(s))
    if not b:
        return b""
    counts = np.bincount((s >> U64(64 - b)).astype(np.int64), minlength=1 << b)
    return (counts[::2] << 4 | counts[1::2]).astype(np.uint8).tobytes() if counts.max() < 16 else b""


def _outline_bits(n: int) -> int:
    return max(0, (n // 2).bit_length() - 1)


def _parts(raw: bytes) -> np.ndarray:
    packed = np.frombuffer(raw, dtype=np.uint8)
    out = np.empty(2 * len(packed), dtype=np.uint8)
    out[::2], out[1::2] = packed >> 4, packed & 15
    return out


def _fold(x: np.ndarray) -> np.ndarray:
    """An outline, or rows of them, with half as many parts."""
    return x.reshape(*x.shape[:-1], -1, 2).sum(axis=-1, dtype=np.uint16)


def may_link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """False only for sets of n and m shingles that can't link."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    if not x or not y:
        return True
    a, b = _parts(x), _parts(y)
    while len(a) > len(b):
        a = _fold(a)
    while len(b) > len(a):
        b = _fold(b)
    most = int(np.minimum(a, b).sum(dtype=np.int64))
    return 100 * most >= percent * (n + m - most)


class Trie:
    """Ordered sets, with runs of shingles that no set leaves as single nodes."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = _Node(np.zeros(0, dtype=U64))

    def insert(self, ordered: np.ndarray, name: int) -> None:
        node, at, n = self.root, 0, len(ordered)
        node.span(n, n)
        while at < n:
            child = node.children.get(int(ordered[at]))
            if child is None:
                child = _Node(ordered[at:])
                node.children[int(ordered[at])] = child
                child.span(n, 0)
                node, at = child, n
                break
            m = min(len(child.run), n - at)
            other = np.flatnonzero(child.run[:m] != ordered[at : at + m])
            same = int(other[0]) if len(other) else m
            if same < len(child.run):
                child = child.split(same, node)
            at += same
            child.span(n, n - at)
            node = child
        node.names.append(name)

    def join(self, probe: np.ndarray, percent: int, held: np.ndarray | None = None):
        """(name, overlap) of the stored sets that link with the sorted set ``probe``.

        Where shingles are small numbers, ``held`` may tell for each whether the probe holds it.
        """
        n = len(probe)
        stack = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if len(node.run) and held is not None:
                shared += int(np.count_nonzero(held[node.run]))
            elif len(node.run):
                at = np.searchsorted(probe, node.run)
                at[at == n] = 0
                shared += int(np.count_nonzero(probe[at] == node.run))
            if 100 * (shared + min(node.left, n - shared)) < percent * (n + node.least - shared - min(node.left, n - shared)):
                continue
            for name, size in zip(node.names, [node.size] * len(node.names), strict=True):
                if 100 * shared >= percent * (n + size - shared):
                    yield name, shared
            stack.extend((c, shared) for c in node.children.values())


class _Node:
    """run: shingles on the way here; least: smallest set at or below; left: most shingles below."""

    __slots__ = ("run", "children", "names", "least", "left", "size")

    def __init__(self, run):
        self.run, self.children, self.names, self.least, self.left, self.size = run, {}, [], 1 << 62, 0, 0

    def span(self, n: int, left: int) -> None:
        self.least, self.left = min(self.least, n), max(self.left, left)
        if not left:
            self.size = n

    def split(self, at: int, above: _Node) -> _Node:
        upper = _Node(self.run[:at])
        upper.least, upper.left = self.least, self.left + len(self.run) - at
        upper.children[int(self.run[at])] = self
        above.children[int(upper.run[0])] = upper
        self.run = self.run[at:]
        return upper


def _with_sets(docs: DataFrame, wants: DataFrame, k: int, counts, bits: int) -> DataFrame:
    """The sets, commonest shingle first, of the rows (doc_id, key, p, q, own, label) of ``wants``, one task's rows together.

    Texts of needed documents only are moved; where a doc_id repeats in ``docs`` its texts are equal.
    """
    size = bits_for(wants.count())
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(wants.select("doc_id"), size))

    def only_needed(batches):
        for batch in batches:
            keep = holds(wanted.value, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), size)
            batch = batch.filter(pa.array(keep))
            if batch.num_rows:
                yield batch

    def sets(batches):
        for batch in batches:
            ids, tasks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows, size = [], 0
            for i, s in shingle_sets(text_column(batch), k):
                order = np.argsort(-counts.value[(s >> U64(64 - bits)).astype(np.int64)].astype(np.int64), kind="stable")
                raw = s[order].tobytes()
                for t in tasks[i]:
                    rows.append((t["key"], t["p"], t["q"], t["own"], t["label"], ids[i], raw))
                    size += len(raw)
                    if size > 8 << 20:
                        yield _rows(rows, *_SETS)
                        rows, size = [], 0
            if rows:
                yield _rows(rows, *_SETS)

    texts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(only_needed, "doc_id long, text string")
    tasks = wants.groupBy("doc_id").agg(F.collect_list(F.struct("key", "p", "q", "own", "label")).alias("tasks"))
    return (
        texts.dropDuplicates(["doc_id"]).join(tasks, "doc_id")
        .mapInArrow(sets, "key long, p int, q int, own int, label long, doc_id long, set binary")
        .repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "doc_id")
    )


_SETS = ["key", "p", "q", "own", "label", "doc_id", "set"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def compare(docs: DataFrame, pairs: DataFrame, k: int, percent: int, counts, bits: int = SKETCH_BITS) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose documents link: each set goes to its pivots (a), dealt over tasks in bounded lots."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SETS_PER_PIVOT).cast("int").alias("lots"))
    row = lambda doc_id, p: (F.col(doc_id).alias("doc_id"), F.col("a").alias("key"), p.alias("p"), F.lit(0).alias("q"), F.lit(0).alias("own"), F.lit(0).cast("long").alias("label"))
    others = pairs.join(many, "a").select(*row("b", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int")))
    pivots = many.select(*row("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))))
    wants = materialise(others.union(pivots))

    def join(batches):
        task, probe, trie, held, links = None, None, Trie(), 0, []
        for batch in batches:
            for a, at, b, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "p", "doc_id", "set")), strict=True):
                if (a, at) != task or held >= TRIE_SETS:
                    if held:
                        links += [(task[0], b2) for b2, _ in trie.join(probe, percent)]
                    trie, held = Trie(), 0
                ordered = np.frombuffer(raw, dtype=U64)
                if (a, at) != task:
                    task, probe = (a, at), None
                if b == a:
                    probe = np.sort(ordered)
                else:
                    trie.insert(ordered, b)
                    held += 1
            if links:
                yield _rows(links, ["a", "b"], [pa.int64(), pa.int64()])
                links = []
        if held:
            yield _rows([(task[0], b2) for b2, _ in trie.join(probe, percent)], ["a", "b"], [pa.int64(), pa.int64()])

    return _with_sets(docs, wants, k, counts, bits).mapInArrow(join, "a long, b long")


def compare_families(docs: DataFrame, members: DataFrame, k: int, percent: int, counts, bits: int = SKETCH_BITS) -> DataFrame:
    """Links (a, b) between ``members`` (key, doc_id, label, n) of one key but of different labels.

    A family's sets are dealt into blocks of bounded size; each pair of blocks meets in one
    task, where one block's tries are probed with the other's sets. Links that join nothing
    new are not put out, so a task gives fewer rows than it has members.
    """
    shape = members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / FAMILY_SETS, F.sum("n") / FAMILY_SHINGLES)).cast("int").alias("s"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("s")).cast("int")
    wants = (
        members.join(shape, "key").withColumn("own", own).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        .select("doc_id", "key", F.least("own", "t").alias("p"), F.greatest("own", "t").alias("q"), "own", "label")
    )
    wants = materialise(wants)

    def join(batches):
        task, block = None, []
        for batch in batches:
            links = []
            for key, p, q, own, label, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in _SETS[0]), strict=True):
                if (key, p, q) != task:
                    links += _block_links(block, percent)
                    task, block = (key, p, q), []
                block.append((own == p, own == q, doc_id, label, raw))
            if links:
                yield _rows(links, ["a", "b"], [pa.int64(), pa.int64()])
        yield _rows(_block_links(block, percent), ["a", "b"], [pa.int64(), pa.int64()])

    return _with_sets(docs, wants, k, counts, bits).mapInArrow(join, "a long, b long")


def _block_links(block: list[tuple], percent: int) -> list[tuple]:
    """Links (a, b) that connect the labels of (stored, probes, doc_id, label, set bytes, commonest shingle first).

    Stored sets of the commonest label fill one trie, which sets of that label don't probe;
    the others fill another. A set that is stored and probes meets those before it.
    """
    labels = {doc_id: label for _, _, doc_id, label, _ in block}
    above = {label: label for label in labels.values()}
    if len(above) < 2:
        return []
    most = Counter(labels.values()).most_common(1)[0][0]

    def top(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    # Shingles of a block are numbered, which makes a lookup cheap.
    found, number = np.unique(np.frombuffer(b"".join(raw for *_, raw in block), dtype=U64), return_inverse=True)
    ends = np.cumsum([len(raw) // 8 for *_, raw in block])
    sets = np.split(number, ends[:-1])
    held = np.zeros(len(found), dtype=bool)
    common, others, links = Trie(), Trie(), []
    for (stored, probes, doc_id, label, _), ordered in zip(block, sets, strict=True):
        if stored and (label == most or not probes):
            (common if label == most else others).insert(ordered, doc_id)
    for (stored, probes, doc_id, label, _), ordered in zip(block, sets, strict=True):
        if not probes or (stored and label == most):
            continue
        held[ordered] = True
        for trie in (others,) if label == most else (common, others):
            for other, _ in trie.join(ordered, percent, held):
                x, y = top(label), top(labels[other])
                if x != y:
                    above[y] = x
                    links.append((min(doc_id, other), max(doc_id, other)))
        held[ordered] = False
        if stored:
            others.insert(ordered, doc_id)
    return links


def _prepared(docs: DataFrame, k: int, percent: int, bits: int, hot: int):
    """The shingle counts, sent to all tasks; profiles of rows; classes; and (token, doc_id, pivot a) of shared prefix shingles."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = spark.sparkContext.broadcast(shingle_counts(docs, k, bits))
    profile = materialise(profiles(docs, k, percent, counts, bits, hot))
    classes = (
        profile.where("n > 0 and doc_id is not null").groupBy("cls")
        .agg(F.min(F.struct("doc_id", "n", "prefix", "crowd", "outline")).alias("one")).select("one.*")
    )
    classes = materialise(classes)
    by_token = W.partitionBy("token").orderBy("doc_id")
    led = (
        classes.select(F.explode("prefix").alias("token"), "doc_id")
        .withColumn("a", F.first("doc_id").over(by_token.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("next", F.lead("doc_id").over(by_token))
        .where("doc_id <> a or next is not null").select("token", "doc_id", "a")
    )
    # A shingle of very many sets: its pivot is a minimum that tasks work out in part, and the join splits.
    crowd = classes.where(F.size("crowd") > 0).select(F.explode("crowd").alias("token"), "doc_id")
    if not crowd.isEmpty():
        pivots = crowd.groupBy("token").agg(F.min("doc_id").alias("a"), F.count("*").alias("sets")).where("sets > 1").select("token", "a")
        led = led.unionByName(crowd.join(pivots, "token").select("token", "doc_id", "a"))
    return counts, profile, classes, materialise(led)


def _by_number(rows: DataFrame, row: str) -> DataFrame:
    """doc_id and text with the number in place of each doc_id that isn't null."""
    return rows.select(F.when(F.col("doc_id").isNotNull(), F.col(row)).alias("doc_id"), "text")


def _heads(rows: DataFrame, row: str, found: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles and component (number), least (doc_id, row) of the component, of numbered rows with an id."""
    named = found.where("doc_id is not null").select(F.col("doc_id").alias(row), "n_shingles", F.col("component_id").alias("_component"))
    placed = materialise(named.join(rows.where("doc_id is not null").select(row, F.col("doc_id").cast("long").alias("doc_id")), row))
    least = placed.groupBy("_component").agg(F.min(F.struct(F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))).alias("_least"))
    return placed.join(least, "_component")


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80, bits: int = SKETCH_BITS, hot: int = HOT_CELL) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Only links that connect components are looked for; all_links() gives every one.
    """
    repeated = numbered(docs)
    if repeated is None:
        return _similar(docs, k, percent, bits, hot)
    rows, row = repeated
    found = materialise(_similar(_by_number(rows, row), k, percent, bits, hot))
    named = _heads(rows, row, found).select("doc_id", "n_shingles", F.col("_least.doc_id").alias("component_id"))
    return named.unionByName(found.where("doc_id is null"))


def _similar(docs: DataFrame, k: int, percent: int, bits: int, hot: int) -> DataFrame:
    """similar_documents() where no doc_id repeats."""
    counts, profile, classes, led = _prepared(docs, k, percent, bits, hot)
    outlines = classes.select("doc_id", "n", "outline")
    # Each class is tried with the pivot that leads most of its shingles, so there is one pair a class.
    shared = led.where("a <> doc_id").groupBy("doc_id", "a").agg(F.count("*").alias("s"))
    chosen = materialise(shared.groupBy(F.col("doc_id").alias("b")).agg(F.min_by("a", F.struct(-F.col("s"), F.col("a"))).alias("a")))
    tried = materialise(_promising(chosen.select("a", "b"), outlines, percent))
    links = materialise(compare(docs, tried, k, percent, counts, bits))
    labels = components(links)
    # Classes with one pivot are a family: what its links left apart meets in blocks, with the sets at hand.
    family = chosen.select(F.col("a").alias("key"), F.col("b").alias("doc_id"))
    near = materialise(_near(family, labels, outlines, percent))
    if not near.isEmpty():
        links = links.union(materialise(compare_families(docs, near, k, percent, counts, bits)))
    rest = materialise(_across(led.select(F.col("token").alias("key"), "doc_id"), family, labels, outlines, percent).join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.union(materialise(compare(docs, rest, k, percent, counts, bits)))
    if not (near.isEmpty() and rest.isEmpty()):
        labels = components(links)
    discard(classes, led, chosen, near, rest)
    heads = profile.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("head"))
    found = heads.join(labels, heads["head"] == labels["node"], "left").select("cls", F.coalesce("component", "head").alias("component"))
    return profile.join(found, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id")).cast("long").alias("component_id"),
    )


def all_links(docs: DataFrame, k: int = 5, percent: int = 80, bits: int = SKETCH_BITS, hot: int = HOT_CELL) -> tuple[DataFrame, DataFrame]:
    """Every link: (a, b) with a < b of class representatives, and the membership (doc_id, n_shingles, class_id, n_links) of rows.

    Documents of one class have equal sets and link with each other. A document links with
    each other document of its own class and of the classes that its class links to; n_links
    counts these documents, each doc_id once. Rows without words or id have a null class and
    no links. The number of links grows with the square of a group of near copies.

    Where a doc_id repeats with differing texts, each row counts as a document of its own:
    a, b and class_id are then numbers of rows, and n_links counts rows.
    """
    repeated = numbered(docs, differing=True)
    if repeated is None:
        return _all_links(docs, k, percent, bits, hot)
    rows, row = repeated
    links, found = _all_links(_by_number(rows, row), k, percent, bits, hot)
    ids = rows.where("doc_id is not null").select(F.col(row).alias("_number"), F.col("doc_id").cast("long").alias("id"))
    named = found.join(ids, F.col("doc_id") == F.col("_number")).select(F.col("id").alias("doc_id"), "n_shingles", "class_id", "n_links")
    return links, named.unionByName(found.where("doc_id is null"))


def _all_links(docs: DataFrame, k: int, percent: int, bits: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """all_links() where no doc_id has two texts."""
    counts, profile, classes, led = _prepared(docs, k, percent, bits, hot)
    outlines = classes.select("doc_id", "n", "outline")
    alone = docs.sparkSession.createDataFrame([], "node long, component long")
    single = docs.sparkSession.createDataFrame([], "key long, doc_id long")
    # Each class is its own component and family, so every pair under one shingle counts as open.
    pairs = materialise(_across(led.select(F.col("token").alias("key"), "doc_id"), single, alone, outlines, percent))
    links = materialise(compare(docs, pairs, k, percent, counts, bits))
    rows = profile.where("n > 0 and doc_id is not null").select("cls", "doc_id").distinct()
    sizes = materialise(rows.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size")))
    size = sizes.select(F.col("class_id").alias("b"), "size")
    both = links.union(links.select("b", "a"))
    outside = both.join(size, "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("size").alias("outside"))
    per_class = sizes.join(outside, "class_id", "left").select(
        "cls", "class_id", (F.col("size") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links")
    )
    named = F.col("doc_id").isNotNull()
    members = profile.join(per_class, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(named, F.col("class_id")).alias("class_id"),
        F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"),
    )
    return links, members


def _promising(pairs: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose outlines don't rule a link out."""
    side = lambda c: outlines.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}_n"), F.col("outline").alias(f"{c}_o"))

    def check(batches):
        for batch in batches:
            n, x, m, y = (batch.column(c).to_pylist() for c in ("a_n", "a_o", "b_n", "b_o"))
            keep = [may_link(*r, percent) for r in zip(n, x, m, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "a_o", "b_n", "b_o")
    return both.mapInArrow(check, "a long, b long")


def _blocks(grouped: DataFrame, labels: DataFrame, outlines: DataFrame) -> DataFrame:
    """Members of groups (key, doc_id) of more than one label, dealt so that all pairs of bounded blocks (p, q) meet."""
    marked = grouped.join(labels, grouped["doc_id"] == labels["node"], "left").select("key", grouped["doc_id"], F.coalesce("component", "doc_id").alias("label"))
    open_ = (
        marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("g")).where("lo <> hi")
        .select("key", F.ceil(F.col("g") / GROUP_BLOCK).cast("int").alias("s"))
    )
    own = F.pmod(F.xxhash64("doc_id"), F.col("s")).cast("int")
    return (
        marked.join(open_, "key").withColumn("own", own).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        .select("key", F.least("own", "t").alias("p"), F.greatest("own", "t").alias("q"), "own", "doc_id", "label")
        .join(outlines, "doc_id")
    )


def _per_block(blocks: DataFrame, put, names: list[str], kinds: list, schema: str) -> DataFrame:
    """``put(key, members, crossing)`` of each block pair; members are (n, doc_id, label, own, family, outline)."""
    fields = ["key", "p", "q", "own", "doc_id", "label", "family", "n", "outline"]

    def run(batches):
        at, group, out = None, [], set()

        def full(last=False):
            """What was put out since, in bounded lots: one pair of blocks may give millions of rows."""
            for row in put(at[0], group, at[1] != at[2]) if at else ():
                out.add(row)
                if len(out) >= PUT_ROWS:
                    yield _rows(list(out), names, kinds)
                    out.clear()
            if last:
                yield _rows(list(out), names, kinds)

        for batch in batches:
            for key, p, q, own, doc_id, label, family, n, raw in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                if (key, p, q) != at:
                    yield from full()
                    at, group = (key, p, q), []
                group.append((n, doc_id, label, own, family, raw))
        yield from full(last=True)

    return blocks.select(*fields).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, schema)


def _near(family: DataFrame, labels: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id, label, n) of members that may link to a member of their family in another component."""

    def put(key, group, crossing):
        found = {x for pair in _open_pairs(group, crossing, percent) for x in pair}
        return [(key, doc_id, label, n) for n, doc_id, label, _, _, _ in group if doc_id in found]

    blocks = _blocks(family, labels, outlines).withColumn("family", F.col("doc_id"))
    return _per_block(blocks, put, ["key", "doc_id", "label", "n"], [pa.int64()] * 4, "key long, doc_id long, label long, n long").distinct()


def _across(postings: DataFrame, family: DataFrame, labels: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) under one shingle, of different families, whose outlines allow a link and that are not yet in one component."""
    kin = family.select("doc_id", F.col("key").alias("family"))
    blocks = _blocks(postings, labels, outlines).join(kin, "doc_id", "left").withColumn("family", F.coalesce("family", "doc_id"))
    put = lambda _, group, crossing: _open_pairs(group, crossing, percent)
    return _per_block(blocks, put, ["a", "b"], [pa.int64()] * 2, "a long, b long").distinct()


def _open_pairs(group: list[tuple], crossing: bool, percent: int):
    """(smaller, larger doc_id) of members of different labels and families (and blocks) whose outlines allow a link."""
    if len({g[4] for g in group}) < 2:
        return

    def plain_pair(x, y):
        apart = x[2] != y[2] and x[4] != y[4] and not (crossing and x[3] == y[3])
        return apart and may_link(x[0], x[5], y[0], y[5], percent)

    shelves: dict[int, list[tuple]] = {}
    if len(group) > 8:
        for member in group:
            shelves.setdefault(_outline_bits(member[0]) if member[5] else -1, []).append(member)
        plain = shelves.pop(-1, [])
    else:
        plain = group
    for i, x in enumerate(plain):
        for y in [*plain[i + 1 :], *(g for s in shelves.values() for g in s)]:
            if plain_pair(x, y):
                yield min(x[1], y[1]), max(x[1], y[1])
    made = {}
    for b, shelf in shelves.items():
        shelf.sort()
        made[b] = *(np.array([g[c] for g in shelf]) for c in range(5)), np.stack([_parts(g[5]) for g in shelf])
    for b, (n, ids, label, own, kin, x) in made.items():
        for other in sorted(c for c in made if c >= b):
            m, y_ids, y_label, y_own, y_kin, y_rows = made[other]
            if 100 * n.max() < percent * m.min():  # sizes too far apart, also for what follows
                break
            for _ in range(other - b):
                y_rows = _fold(y_rows)
            for i in range(len(n)):
                ok = (y_label != label[i]) & (y_kin != kin[i]) & (100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i]))
                if crossing:
                    ok &= y_own != own[i]
                if other == b:
                    ok[: i + 1] = False
                at = np.flatnonzero(ok)
                if len(at):
                    most = np.minimum(y_rows[at], x[i]).sum(axis=1, dtype=np.int64)
                    for j in at[100 * most >= percent * (n[i] + m[at] - most)]:
                        yield (int(min(ids[i], y_ids[j])), int(max(ids[i], y_ids[j])))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that link, directly or not, to one of smaller doc_id.

    Rows without doc_id stay. Where a doc_id repeats, each row is judged by its own text: of
    a group's rows of smallest doc_id one stays, and texts that link with nothing all stay.
    """
    repeated = numbered(docs)
    if repeated is None:
        first = _similar(docs, k, percent, SKETCH_BITS, HOT_CELL).where("doc_id = component_id").select("doc_id")
        named = docs.join(first, "doc_id", "left_semi").select(*docs.columns)
        return named.unionByName(docs.where("doc_id is null"))
    rows, row = repeated
    found = materialise(_similar(_by_number(rows, row), k, percent, SKETCH_BITS, HOT_CELL))
    heads = _heads(rows, row, found).where(F.col("_least.row") == F.col(row)).select(row)
    named = rows.join(heads, row, "left_semi").select(*docs.columns)
    return named.unionByName(rows.where("doc_id is null").select(*docs.columns))
