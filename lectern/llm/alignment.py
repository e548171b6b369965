"""Alignment of the tokens of two tokenizers over the bytes of a corpus.

A text, with a space before it, is encoded by a byte-level tokenizer (A) and by a SentencePiece
model (B, which adds the space itself). Tokens are byte intervals. Where a token of A and one of B
end together, both token rows are cut; between cuts lies a group, and every token of A in it
is linked with every token of B in it. Pairs of ids are counted by the documents that hold them
linked, over the whole corpus, and each document is measured by those counts.

Arrow partitions hand blocks of bounded size to an in-process DuckDB: interval tables on
one byte axis, a join of ends for the cuts, a window sum that numbers the groups, ASOF joins
that place tokens in groups and groups in documents, and counts of a pair in a document. A text of many tokens is cut into several blocks at cuts of its own. One pass
writes, per document, its pairs and times, and per partition how many of its documents hold a
pair. Spark sums these partial counts. The most frequent pairs, at most TOP_PAIRS, are sent to the
tasks that measure documents; other pairs meet their counts in a join.

A text that is null or empty, or that either tokenizer does not give back byte by byte, has no
tokens: zeros, and an empty digest. Repeated rows and rows without doc_id are documents like
others. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import text_column
from lectern.session import bounded_batches, materialise

#: Tokens of one side of a block, and pairs a partition counts before it passes its counts on.
BLOCK_TOKENS, HELD_PAIRS = 1 << 18, 500_000
#: Most frequent pairs that are sent to every task, 20 bytes each.
TOP_PAIRS = 1 << 20
_DUCKDB_MEMORY = "512MB"
#: Links a token on average up to which a block's links are paired one by one, which is cheaper for small groups.
FEW_LINKS = 4
#: Pairs of a row of partial counts.
_CHUNK = 20_000
#: The pattern by which byte-level tokenizers of this family cut text, a fixed value.
_CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_SPACE = regex.compile(r"\s{500}")
_PROBES = (" The quick, brown fox's 12 tails don't  jump...\n\n \tÉté naïve 日本語 🙂 x_y <|endoftext|> a\u0000b   ", " 1234567 !?!? 'S 'll\r\n end ", " " + "ab" * 400)


class Bytes:
    """The bytes of every id of a tokenizer, in one array."""

    def __init__(self, table: list[bytes]):
        self.size = np.array([len(x) for x in table], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        """The joined bytes of some ids."""
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class ByteLevel:
    """Tokenizer A: ids of whole texts, and the bytes of every id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_padding()
        self.exact.no_truncation()
        self.exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        special = {t["id"] for t in given.get("added_tokens", [])}
        alphabet = byte_alphabet()
        vocab = {i: t for t, i in given["model"]["vocab"].items()}
        vocab |= {t["id"]: t["content"] for t in given.get("added_tokens", [])}
        decoded = lambda i, t: t.encode() if i in special else bytes(alphabet[c] for c in t)
        self.bytes = [decoded(i, vocab[i]) if i in vocab else b"" for i in range(max(vocab) + 1)]
        #: Where merges rank as ids do, a faster encoder gives the same; probes decide.
        self.quick = tiktoken.Encoding("own", pat_str=_CUT, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if i not in special}, special_tokens={})
        if any(self.encode(p).tolist() != self.exact.encode(p, add_special_tokens=False).ids for p in _PROBES):
            self.quick = None

    def encode(self, text: str) -> np.ndarray:
        if self.quick is None or (len(text) > 500 and _LONG_SPACE.search(text)):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


class PieceModel:
    """Tokenizer B: ids of whole texts, to which it adds a space, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        one = lambda i, p: bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
        self.bytes = [one(i, self.model.id_to_piece(i)) for i in range(self.model.vocab_size())]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@lru_cache(maxsize=2)
def _loaded(a: str, b: str):
    """Both tokenizers of this worker process, the bytes of their ids, and the table of digest text."""
    pair = ByteLevel(a), PieceModel(b)
    tables = [Bytes(t.bytes) for t in pair]
    ends = [[f"{i}{e}" for e in both for i in range(len(t.bytes))] for t, both in zip(pair, (",|", ",;"), strict=True)]
    return (*pair, *tables, ends[0] + ends[1])


class _Intervals:
    """DuckDB over the token intervals of one block after another."""

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": _DUCKDB_MEMORY, "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")

    def cuts(self, a: pa.Table, b: pa.Table, d: pa.Table) -> np.ndarray:
        """Where tokens of both sides end together, in order; the groups that end there are numbered from 1."""
        for name, rows in (("a", a), ("b", b), ("d", d)):
            self.db.register(name, rows)
        numbered = "SELECT hi, (count(*) OVER (ORDER BY hi ROWS UNBOUNDED PRECEDING))::INT AS g FROM a SEMI JOIN b USING (hi)"
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE cut AS SELECT c.hi, g, doc FROM ({numbered}) c ASOF JOIN d ON c.hi > d.lo")
        return self.db.sql("SELECT hi FROM cut ORDER BY g").fetchnumpy()["hi"]

    def links(self, few: bool) -> dict[str, np.ndarray]:
        """doc, a, b, n (times) of the linked pairs of each document; unless links are ``few``, equal ids of a group are counted before they are paired."""
        what, n, by = ("count(*)", "", "") if few else ("sum(in_a.n * in_b.n)::BIGINT", ", count(*) AS n", "GROUP BY ALL")
        placed = lambda side, more: f"SELECT g, id {more} {n} FROM {side} ASOF JOIN cut ON {side}.hi <= cut.hi {by}"
        return self.db.sql(
            f"SELECT doc, in_a.id AS a, in_b.id AS b, {what} AS n FROM ({placed('a', ', doc')}) in_a JOIN ({placed('b', '')}) in_b USING (g) GROUP BY ALL"
        ).fetchnumpy()


def _pieces(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> Iterator[tuple[slice, slice]]:
    """Runs of a document's tokens of about ``size``, cut where both tokenizers end a token."""
    i = j = 0
    while max(len(ends_a) - i, len(ends_b) - j) > size:
        reach = size
        while True:
            a, b = ends_a[i : i + reach], ends_b[j : j + reach]
            both = np.intersect1d(a, b, assume_unique=True)
            if len(both) or (i + reach >= len(ends_a) and j + reach >= len(ends_b)):
                break
            reach *= 2
        k, m = (int(np.searchsorted(e, both[-1], side="right")) for e in (ends_a, ends_b))
        yield slice(i, k), slice(j, m)
        i, j = k, m
    yield slice(i, len(ends_a)), slice(j, len(ends_b))


_MEASURED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_LINKED = f"kind string, {_MEASURED}, a array<int>, b array<int>, n array<long>"


class _Document:
    """What is known of a document while its pieces pass."""

    def __init__(self, doc_id: int | None, row: int):
        self.doc_id, self.row, self.sha, self.pairs = doc_id, row, hashlib.sha256(), []
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.held = b""

    def add(self, text: str) -> None:
        """Digest text of a piece; its last semicolon is only written when another piece follows."""
        self.sha.update(self.held + text[:-1].encode())
        self.held = b";"


class _Block:
    """Pieces of documents on one byte axis, and what DuckDB finds in them."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray], strings: list[str]):
        self.sizes, self.strings, self.db = sizes, strings, _Intervals()
        self.clear()

    def clear(self) -> None:
        self.pieces: list[tuple[_Document, np.ndarray, np.ndarray]] = []
        self.tokens = 0

    def put(self, doc: _Document, a: np.ndarray, b: np.ndarray) -> None:
        self.pieces.append((doc, a, b))
        self.tokens += max(len(a), len(b))

    def solve(self) -> None:
        """Add groups, links, digests and pairs of the pieces to their documents."""
        if not self.pieces:
            return
        ids = [np.concatenate([p[k] for p in self.pieces]) for k in (1, 2)]
        ends = [np.cumsum(size[i]) for i, size in zip(ids, self.sizes, strict=True)]
        ends = [e.astype(np.int32) for e in ends] if ends[0][-1] < 1 << 31 else ends
        upto = [np.cumsum([len(p[k]) for p in self.pieces]) for k in (1, 2)]
        last = ends[0][upto[0] - 1]
        begin = np.concatenate([[0], last[:-1]])
        tables = [pa.table({"id": i, "hi": e}) for i, e in zip(ids, ends, strict=True)]
        cuts = self.db.cuts(*tables, pa.table({"doc": np.arange(len(self.pieces), dtype=np.int32), "lo": begin}))
        group = [np.searchsorted(cuts, e) for e in ends]
        number = np.prod([np.bincount(g, minlength=len(cuts)) for g in group], axis=0).sum()
        found = self.db.links(number <= FEW_LINKS * self.tokens)
        order = np.argsort(found["doc"], kind="stable")
        doc, a, b, n = (np.asarray(found[k])[order] for k in ("doc", "a", "b", "n"))
        bounds = np.searchsorted(doc, np.arange(len(self.pieces) + 1))
        groups = np.searchsorted(cuts, np.concatenate([begin, last[-1:]]), side="right")
        texts = self._texts(ids, group, [cuts[g] == e for g, e in zip(group, ends, strict=True)], upto)
        for i, (d, own_a, own_b) in enumerate(self.pieces):
            at = slice(bounds[i], bounds[i + 1])
            d.n_a, d.n_b = d.n_a + len(own_a), d.n_b + len(own_b)
            d.n_groups += int(groups[i + 1] - groups[i])
            d.n_links += int(n[at].sum())
            d.pairs.append((a[at], b[at], n[at]))
            d.add(texts[i])
        self.clear()

    def _texts(self, ids: list[np.ndarray], group: list[np.ndarray], stops: list[np.ndarray], upto: list[np.ndarray]) -> list[str]:
        """For each piece its groups as ``a1,a2|b1;a3|b2,b3;``; ``stops`` marks the last tokens of groups."""
        n_a, n_b = (len(s) for s in self.sizes)
        code = [ids[0] + n_a * stops[0], ids[1] + 2 * n_a + n_b * stops[1]]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        out = [self.strings[c] for c in np.concatenate(code)[order].tolist()]
        bounds = np.concatenate([[0], upto[0] + upto[1]]).tolist()
        return ["".join(out[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one or several pieces, each once."""
    if len(parts) == 1:
        return parts[0]
    key = np.concatenate([a.astype(np.int64) << 32 | b for a, b, _ in parts])
    keys, place = np.unique(key, return_inverse=True)
    times = np.zeros(len(keys), dtype=np.int64)
    np.add.at(times, place, np.concatenate([n for _, _, n in parts]))
    return keys >> 32, keys & 0xFFFFFFFF, times


class _Counts:
    """How many documents of this partition hold a pair; passed on when there are too many pairs."""

    def __init__(self):
        self.keys, self.counts, self.new, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.new.append(a.astype(np.int64) << 32 | b)
        self.size += len(a)

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *self.new])
        counts = np.concatenate([self.counts, np.ones(self.size, np.int64)])
        self.keys, place = np.unique(keys, return_inverse=True)
        self.counts, self.new, self.size = np.bincount(place, counts, minlength=len(self.keys)).astype(np.int64), [], 0

    def rows(self) -> Iterator[dict]:
        self.merge()
        for i in range(0, len(self.keys), _CHUNK):
            some = self.keys[i : i + _CHUNK]
            yield {"kind": "count", "a": some >> 32, "b": some & 0xFFFFFFFF, "n": self.counts[i : i + _CHUNK]}
        self.__init__()


def _arrow(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    names = [x.split() for x in schema.split(", ")]
    column = lambda n, k: _lists([r.get(n) for r in rows], kinds[k]) if k.startswith("array") else pa.array([r.get(n) for r in rows], kinds[k])
    return pa.RecordBatch.from_arrays([column(n, k) for n, k in names], names=[n for n, _ in names])


def _lists(values: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """Arrays as lists; none is an empty one."""
    offsets = np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in values])]).astype(np.int32)
    flat = [v for v in values if v is not None]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)).cast(kind.value_type))


def links(docs: DataFrame, model_a: str, model_b: str, block_tokens: int = BLOCK_TOKENS, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """Rows of kind ``doc``, one a document with its pairs and their times, and of kind ``count``, partial numbers of documents by pair."""

    def run(batches):
        first, second, bytes_a, bytes_b, strings = _loaded(model_a, model_b)
        size_a, size_b = bytes_a.size, bytes_b.size
        block, counts = _Block((size_a, size_b), strings), _Counts()
        row, open_docs = TaskContext.get().partitionId() << 40, []

        def close():
            block.solve()
            rows = [_closed(d) for d in open_docs]
            open_docs.clear()
            for r in rows:
                if r["a"] is not None:
                    counts.add(r["a"], r["b"])
            if counts.size > held_pairs:
                counts.merge()
            if len(counts.keys) > held_pairs:
                rows += counts.rows()
            return _arrow(rows, _LINKED)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_column(batch).to_pylist(), strict=True):
                doc, row = _Document(doc_id, row), row + 1
                open_docs.append(doc)
                a, b = _tokens(text, first, second, bytes_a, bytes_b)
                if len(a) and max(len(a), len(b)) <= block_tokens:
                    block.put(doc, a, b)
                    if block.tokens >= block_tokens:
                        block.solve()
                elif len(a):
                    for s, t in _pieces(np.cumsum(size_a[a]), np.cumsum(size_b[b]), block_tokens):
                        block.put(doc, a[s], b[t])
                        if block.tokens >= block_tokens:
                            block.solve()
                if not block.pieces or len(open_docs) >= 2000:
                    yield close()
        yield close()
        for r in counts.rows():
            yield _arrow([r], _LINKED)

    def _tokens(text, first, second, bytes_a, bytes_b):
        none = np.zeros(0, dtype=np.int32)
        if not text:
            return none, none
        a, b, raw = first.encode(" " + text), np.array(second.encode(text), dtype=np.int32), (" " + text).encode()
        return (a, b) if bytes_a.of(a) == raw == bytes_b.of(b) else (none, none)

    def _closed(d):
        out = {"kind": "doc", "row": d.row, "doc_id": d.doc_id} | {k: getattr(d, k) for k in ("n_a", "n_b", "n_groups", "n_links")}
        a, b, n = _merged(d.pairs) if d.pairs else (None, None, None)
        return out | {"groups_sha256": d.sha.hexdigest() if d.pairs else "", "a": a, "b": b, "n": n}

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, _LINKED)


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, documents, best: how many documents hold each pair, and whether none of the pairs of its A id is in more."""
    parts = linked.where("kind = 'count'").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p"))
    counts = parts.groupBy("p.a", "p.b").agg(F.sum("p.n").alias("documents"))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))  # one row an id of the vocabulary
    return counts.join(F.broadcast(most), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def measure(linked: DataFrame, counts: DataFrame, top: int = TOP_PAIRS) -> DataFrame:
    """Each document of ``linked`` with n_best and count_sum by the ``counts`` of pairs."""
    spark = linked.sparkSession
    number = counts.count()
    sent = (counts.orderBy(F.desc("documents"), "a", "b").limit(top) if number > top else counts).toArrow()
    key = sent["a"].to_numpy().astype(np.int64) << 32 | sent["b"].to_numpy().astype(np.int64)
    order = np.argsort(key)
    known = spark.sparkContext.broadcast((key[order], sent["documents"].to_numpy()[order], sent["best"].to_numpy()[order]))
    out = f"{_MEASURED}, n_best long, count_sum long, a array<int>, b array<int>, n array<long>"

    def run(batches):
        keys, documents, best = known.value
        for batch in batches:
            lists = batch.column(7)
            size = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            a, b, n = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (7, 8, 9))
            own = a << 32 | b
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            found = keys[at] == own if len(keys) else np.zeros(len(own), dtype=bool)
            bounds = np.concatenate([[0], np.cumsum(size)])
            totals = []
            for value in (n * best[at] * found, n * documents[at] * found) if len(keys) else (0 * n, 0 * n):
                running = np.concatenate([[0], np.cumsum(value)])
                totals.append(pa.array(running[bounds[1:]] - running[bounds[:-1]]))
            rest = pa.array(np.concatenate([[0], np.cumsum(~found)])[bounds], pa.int32())
            left = [pa.ListArray.from_arrays(rest, pa.array(x[~found], kind)) for x, kind in ((a, pa.int32()), (b, pa.int32()), (n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *totals, *left], names=[x.split()[0] for x in out.split(", ")])

    measured = linked.where("kind = 'doc'").drop("kind").mapInArrow(run, out)
    if number > top:
        measured = materialise(measured)
        rest = measured.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("row", "p.*").join(counts, ["a", "b"])
        more = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("documents")).alias("more_sum"))
        measured = measured.join(more, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
        })
    return measured.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(docs: DataFrame, model_a: str, model_b: str, top: int = TOP_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    bounded_batches(docs.sparkSession)
    linked = materialise(links(docs, model_a, model_b))
    return measure(linked, materialise(pair_counts(linked)), top)
