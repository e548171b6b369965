"""Exact dedup, vector codes and token alignment against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import alignment, exact_dedup, queries, vector_codes
from lectern.llm.groups import join_groups

TEXTS = [None, "", " ", "\n\t ", "a b", "a  b", "a\n\tb", "a b ", "A b", "a b", "é", "é", "x" * 300_000, "x" * 300_000, "x" * 299_999 + "y"]


def plain_copies(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((i is None, i or 0, n, i))
    out = []
    for n, (i, t) in enumerate(rows):
        own = sorted(groups[norm(t)])
        out.append((i, own[0][3], len(own), own[0][2] == n, hashlib.sha256(norm(t).encode()).hexdigest()))
    return Counter(out)


def copied_rows(seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(TEXTS)) for i in range(60)] + [(i, f"text {i % 150}") for i in range(60, 400)]
    rows += [(i, "hot  text") for i in range(400, 600)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("capacity", [1, 7, None])
def test_copies(docs_of, capacity):
    rows = copied_rows(1)
    got = exact_dedup.copies(docs_of(rows, extra=True).repartition(5), capacity)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_copies(rows)


def test_copies_of_repeated_and_missing_ids(docs_of):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c "), (None, "c"), (2, None), (2, ""), (3, "b")]
    got = exact_dedup.copies(docs_of(rows, extra=True))
    mine, want = Counter(map(tuple, got.collect())), plain_copies(rows)
    assert mine == want  # of rows that tie, one stays
    kept = exact_dedup.keep_first(docs_of(rows, extra=True))
    assert Counter((r.doc_id, re.sub(r"\s+", " ", r.text or "")) for r in kept.collect()) == Counter([(1, "a"), (1, "b"), (None, "c"), (None, "c "), (2, "")])
    assert kept.columns == docs_of(rows, extra=True).columns


def test_texts_held_by_a_task_are_bounded(docs_of, monkeypatch):
    """Copies that a task sends on in several rows meet again at their owner."""
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", 300)
    rows = copied_rows(2)
    assert Counter(map(tuple, exact_dedup.copies(docs_of(rows)).collect())) == plain_copies(rows)


def test_no_copies_of_an_empty_table(docs_of):
    assert exact_dedup.copies(docs_of([])).count() == 0
    assert exact_dedup.keep_first(docs_of([])).count() == 0


def test_colliding_keys_form_chains(spark):
    """Texts under one key are told apart by their bytes."""
    rows = [(0, 5, 3, 0, 1, b"1", b"one"), (0, 5, 1, 0, 2, b"2", b"two"), (0, 5, 2, 0, 1, b"1", b"one"), (0, 9, 4, 0, 1, b"3", None), (1, -5, 8, 0, 1, b"1", b"one")]
    got = exact_dedup.chains(spark.createDataFrame(rows, exact_dedup._ENTRY)).collect()
    assert sorted((r.bucket, r.key, r.chain, bytes(r.sha), r.keep_id, r.group_size) for r in got) == [
        (0, 5, 0, b"1", 2, 2), (0, 5, 1, b"2", 1, 2), (0, 9, 0, b"3", 4, 1), (1, -5, 0, b"1", 8, 1)]


@pytest.mark.parametrize("capacity,first_bits", [(1, 4), (5, 2), (40, 16), (1000, 16)])
def test_directory(spark, capacity, first_bits):
    """Buckets cover all keys, none holds more than its capacity, and each split one would have been too full."""
    rnd = random.Random(capacity)
    keys = sorted({rnd.randrange(-(1 << 63), 1 << 63) for _ in range(300)} | {(1 << 40) + i * (1 << 44) for i in range(30)})
    directory = exact_dedup.directory_of(spark.createDataFrame([(k,) for k in keys], "key long"), capacity, first_bits)
    slots = directory.slots()
    assert len(slots) == 1 << directory.depth and sorted(set(slots.tolist())) == list(range(len(directory)))
    assert directory.depth == directory.local.max() or len(directory) == 1
    sizes = Counter(exact_dedup.bucket_of(slots, np.array(keys, dtype=np.int64)).tolist())
    full = [b for b, n in sizes.items() if n > capacity]
    assert all(directory.local[b] + exact_dedup.MORE_BITS > exact_dedup.MOST_BITS for b in full)
    halves = Counter()
    for b, (prefix, local) in enumerate(zip(directory.prefix.tolist(), directory.local.tolist(), strict=True)):
        halves[prefix >> 1, local - 1] += sizes[b]
        first = slots.tolist().index(b)
        assert first >> (directory.depth - local) == prefix
    for (prefix, local), n in halves.items():
        twins = [b for b in range(len(directory)) if (directory.prefix[b] >> 1, directory.local[b] - 1) == (prefix, local)]
        assert local < 0 or len(twins) < 2 or n > capacity


def test_groups_are_joined_whatever_their_size(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("size"))
    got = join_groups(rows, groups, ["k"], "size")
    assert got.count() == 5000 and got.where("(k = 0 and size = 1667) or (k <> 0 and size = 1)").count() == 5000


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, np.floor(4096 * np.array(v, dtype=np.float64)).astype(object)) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][2]) // parts
    cut = [(i, lab, [[int(x) for x in v[p * width : (p + 1) * width]] for p in range(parts)]) for i, lab, v in kept]
    books = [[list(c[2][p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, _, x in cut:
                own.setdefault(near(x[p], books[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(books[p])]
    flat = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    coded = [(i, lab, [near(x[p], books[p]) for p in range(parts)]) for i, lab, x in cut]
    total = Counter()
    for _, lab, best in coded:
        total[lab] += sum(d for d, _ in best)
    return Counter((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), total[lab], flat) for i, lab, best in coded)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumns({c: F.lit("x") for c in ("x", "old", "new", "error", "label_rows", "code")})


@pytest.mark.parametrize("n,scale", [(200, 1), (200, 900), (9, 1)])
def test_codes(spark, n, scale):
    rnd = random.Random(n)
    rows = [(3 * i - 50, [round(rnd.gauss(rnd.choice([-1, 0, 2]), 0.3), 3) * scale for _ in range(16)], rnd.choice([None, 1, 2])) for i in range(n)]
    rows += [(1000 + i, rows[i % 3][1], None) for i in range(40)]  # repeated vectors and ties
    bad = [(2000, None, 1), (2001, [1.0] * 15 + [None], 1), (2002, [float("nan")] * 16, 1), (2003, [float("-inf")] + [0.0] * 15, 1)]
    got = vector_codes.compress(vectors(spark, rows + bad).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_codes(rows)


def test_codes_of_odd_vectors(spark):
    """Other lengths are dropped, huge values held, missing ids come last, an empty table gives no rows."""
    rows = [(1, [0.5] * 8, 1), (2, [0.5] * 7, 1), (3, [0.5] * 16, 1), (4, [], 1), (None, [1e300] * 8, 1), (5, [-3e38] * 8, None), (1, [0.25] * 8, 1)]
    got = vector_codes.compress(vectors(spark, rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.error) for r in got) == [(False, 1, 0), (False, 1, 0), (False, 5, 0), (True, None, 0)]
    assert vector_codes.compress(vectors(spark, rows[:0])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).count() == 0


def test_only_changed_parts_are_shuffled(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(rnd.choice([-2, 2]), 0.1) for _ in range(8)], 0) for i in range(300)]
    whole = vector_codes.whole_vectors(vectors(spark, rows))
    _, books = vector_codes.train(whole)
    state = vector_codes.assign(whole.selectExpr("*", "cast(null as binary) old", "cast(null as binary) new"), books)
    sums, counts = vector_codes.changes(state, books)
    assert counts.sum() == 8 * 300
    again = vector_codes.assign(state, books)
    sums, counts = vector_codes.changes(again, books)
    assert not sums.any() and not counts.any()
    other = vector_codes.assign(state, books[:, ::-1].copy())
    sums, counts = vector_codes.changes(other, books)
    assert counts.sum() == 0 and counts.any()


def test_decoded_vectors_are_near(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-1.0, 1.0])] * 8, 0) for i in range(50)]
    kept, books = vector_codes.train(vector_codes.whole_vectors(vectors(spark, rows)))
    got = vector_codes.decode(vector_codes.encode(kept, books), books).collect()
    assert {r.vec_id: list(r.embedding) for r in got} == {i: v for i, v, _ in rows}


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine, sql = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    as_rows = lambda df: Counter(df[sorted(sql.columns)].itertuples(index=False, name=None))
    assert as_rows(mine) == as_rows(sql)


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_vector_codes"])
def test_queries_with_sql(spark, sf, name):
    same_as_sql(spark, sf, name)


def plain_alignment(rows, path_a, path_b):
    """All of it with lists and sets, from the tokenizer libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(path_a)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=path_b)
    alphabet = alignment.byte_alphabet()
    docs = []
    for i, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in first.id_to_token(t)) for t in a]
        bytes_b = [bytes([int(second.id_to_piece(t)[3:-1], 16)]) if second.is_byte(t) else second.id_to_piece(t).replace("▁", " ").encode() for t in b]
        groups = []
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            j, at_a, at_b, own = 0, 0, 0, ([], [])
            for t, x in zip(a, bytes_a, strict=True):
                at_a += len(x)
                own[0].append(t)
                while at_b < at_a:
                    own[1].append(b[j])
                    at_b += len(bytes_b[j])
                    j += 1
                if at_a == at_b:
                    groups.append(own)
                    own = ([], [])
        docs.append((i, groups))
    counts = Counter(p for _, g in docs for p in {(x, y) for a, b in g for x in a for y in b})
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for i, g in docs:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(counts[p] == most[p[0]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return Counter(out)


STRANGE = [
    None, "", " ", "  ", "a", " a", "a ", "\n", "\t x\r\n", "a▁b", "<|endoftext|> </s> <s> <unk> <0x41>", "\u0000", "éé ﬁ ​ ﻿", "日本語の文", "\U0001f642\U0001f642\U0001f469‍\U0001f469‍\U0001f467",
    "     indented    text", "1234567890 12,345.67", "aaaa" * 500, "ab" * 3000, "It's   we'll\n\n\nI'd", " 　x y", "x" + " " * 2000 + "y", "ক্ষ বাংলা",
]


@pytest.mark.parametrize("block,held,top", [(1 << 18, 500_000, 1 << 20), (40, 30, 0), (40, 100, 25)])
def test_alignment(docs_of, tokenizers, block, held, top):
    """Also with texts cut into small pieces, partial counts passed on early, and most counts joined."""
    rnd = random.Random(block)
    rows = list(enumerate(STRANGE)) + [(500 + i, " ".join(rnd.choice("the quick bröwn fóx jumps over 12 日本 don't unbelievable, tokenization".split(" ")) for _ in range(rnd.choice([2, 30, 200])))) for i in range(30)]
    rows += [(500, "again the quick"), (None, "no id"), (501, rows[-1][1])]
    a, b = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
    linked = alignment.links(docs_of(rows, extra=True).repartition(3), a, b, block, held)
    linked = linked.persist()
    got = alignment.measure(linked, alignment.pair_counts(linked), top)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    mine, want = Counter(map(tuple, got.collect())), plain_alignment(rows, a, b)
    assert mine == want
    linked.unpersist()


def test_alignment_of_a_table(spark, sf, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_token_alignment"](spark, sf)
    assert Counter(map(tuple, got.collect())) == plain_alignment(rows, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))


def test_alignment_of_an_empty_table(docs_of, tokenizers):
    got = alignment.align(docs_of([]), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))
    assert got.count() == 0
