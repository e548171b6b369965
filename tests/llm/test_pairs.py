"""N-gram join, line dedup and decontamination against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import bitmap, decontaminate, line_dedup, ngram_join, queries

EDGES = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "one"), (905, "one two"), (None, "null id text here"), (903, "one")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n=60):
    """Originals, near copies of several degrees, a common passage and unlike texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 6)))
    passage = " ".join(word() for _ in range(30))
    base = [" ".join(word() for _ in range(rnd.choice([3, 8, 60, 200]))) for _ in range(6)]
    rows = []
    for i in range(n):
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            words[rnd.randrange(len(words))] = word()
        rows.append((i, rnd.choice([" ", "\n"]).join(words) + (" " + passage if rnd.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("k,percent", [(2, 60)])
def test_all_links(docs_of, k, percent):
    """Every link between different sets, also inside a component, and the links of each document."""
    base = [f"w{i}" for i in range(200)]
    clump = [(100 + i, " ".join([*base[: 15 * i], f"v{i}", *base[15 * i + 1 :]])) for i in range(12)]
    rows = corpus(k) + clump + EDGES
    links, members = ngram_join.all_links(docs_of(rows), k, percent, bits=12)
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    head = {}
    for i in sorted(sets):
        if sets[i]:
            head.setdefault(frozenset(sets[i]), i)
    heads = sorted(head.values())
    near = lambda x, y: bool(x and y) and 100 * len(x & y) >= percent * len(x | y)
    want = {(a, b) for n, a in enumerate(heads) for b in heads[n + 1 :] if near(sets[a], sets[b])}
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > len({x for pair in want for x in pair})  # more than a forest: links within components are there
    n_links = {i: sum(near(x, y) for j, y in sets.items() if j != i) for i, x in sets.items()}
    found = members.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.class_id, r.n_links) == ((head.get(frozenset(sets[r.doc_id])), n_links[r.doc_id]) if r.doc_id is not None else (None, 0))


def test_all_links_of_repeated_ids(docs_of):
    """Two texts under one id are two documents, named by the numbers of their rows."""
    text = "a b c d e f g h"
    rows = [(1, text), (1, "some other words that stand alone here"), (2, text + " i"), (2, text), (None, text), (3, None)]
    links, members = ngram_join.all_links(docs_of(rows), 2, 60, bits=12)
    pairs, found = links.collect(), members.collect()
    assert len(pairs) == 1 and len(found) == len(rows)
    assert sorted((r.doc_id or 0, r.n_links, r.class_id is None) for r in found) == [(0, 0, True), (1, 0, False), (1, 2, False), (2, 2, False), (2, 2, False), (3, 0, True)]


@pytest.mark.parametrize("percent", [35, 80])
def test_repeated_ids_with_differing_texts(docs_of, percent):
    """Each row is judged by its own text; the component is the smallest id that links reach."""
    rows = [(i % 40, t) for i, t in corpus(7, 80)] + EDGES + [(3, None), (3, "")]
    sets = [(i, shingles(t, 3)) for i, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if None not in (i, j) and x and y and 100 * len(x & y) >= percent * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), 1 << 60), i)
    want = sorted(str((i, len(x), None if i is None else least[find(a)])) for a, (i, x) in enumerate(sets))
    got = ngram_join.similar_documents(docs_of(rows, extra=True), 3, percent, bits=12, hot=4).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    kept = ngram_join.keep_first(docs_of(rows, extra=True), 3, percent)
    groups_ = {find(a) for a, (i, _) in enumerate(sets) if i is not None}
    assert kept.count() == len(groups_) + sum(i is None for i, _ in rows)
    assert {(r.doc_id, r.text) for r in kept.collect()} <= set(rows)


@pytest.mark.parametrize("percent", [20, 30, 45])
def test_open_pairs_at_low_thresholds(percent):
    """Sets whose sizes differ much still meet, whatever shelf their outlines are on."""
    import numpy as np

    rnd = np.random.default_rng(percent)
    base = np.unique(rnd.integers(0, 1 << 63, 900).astype(np.uint64))
    sets = [np.sort(rnd.choice(base, n, replace=False)) for n in (900, 700, 450, 300, 220, 200, 150, 90, 60, 30, 12)]
    group = [(len(s), i, i, 0, i, ngram_join.outline(s)) for i, s in enumerate(sets)]
    found = set(ngram_join._open_pairs(group, False, percent))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                assert (j, i) in found


@pytest.mark.parametrize("k,percent,hot", [(4, 85, ngram_join.HOT_CELL), (5, 80, 3), (3, 20, 3)])
def test_similar_documents(docs_of, k, percent, hot):
    rows = corpus(k) + EDGES
    got = ngram_join.similar_documents(docs_of(rows, extra=True), k, percent, bits=12, hot=hot).collect()
    want = groups(rows, k, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_hot_group_of_near_copies(docs_of):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(60)] = f"x{rnd.random()}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs_of(rows), 4, 85).collect()}
    assert got == groups(rows, 4, 85)


def test_outline_never_rules_out_a_link():
    import numpy as np

    rnd = np.random.default_rng(2)
    for _ in range(300):
        n = int(rnd.integers(1, 300))
        x = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        keep = x[rnd.random(len(x)) < rnd.uniform(0.7, 1)]
        y = np.unique(np.concatenate([keep, rnd.integers(0, 2**63, int(rnd.integers(0, 40))).astype(np.uint64)]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            assert ngram_join.may_link(len(x), ngram_join.outline(x), len(y), ngram_join.outline(y), 80)


def test_trie_finds_what_sets_say():
    import numpy as np

    rnd = random.Random(4)
    sets = [sorted(rnd.sample(range(40), rnd.randint(1, 30))) for _ in range(80)]
    trie = ngram_join.Trie()
    for i, s in enumerate(sets):
        trie.insert(np.array(s, dtype=np.uint64), i)
    for probe in sets[:20]:
        p = set(probe)
        want = {(i, len(p & set(s))) for i, s in enumerate(sets) if 100 * len(p & set(s)) >= 60 * len(p | set(s))}
        assert set(trie.join(np.array(probe, dtype=np.uint64), 60)) == want


def test_keep_first(docs_of):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words are here now ok"), (3, "other words are here now ok"), (None, "x"), (4, None), (5, None)]
    kept = ngram_join.keep_first(docs_of(rows)).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 1, 3, 4, 5]


def test_empty_tables(docs_of):
    empty = docs_of([])
    bench = empty.select(F.col("doc_id").alias("item_id"), "text")
    assert ngram_join.similar_documents(empty).count() == 0
    assert line_dedup.deduplicate(empty).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    some = docs_of([(1, "a b")])
    assert decontaminate.digest(decontaminate.contamination(some, bench)).first().contaminated is False


def near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def redundant(rows, min_chars=line_dedup.MIN_CHARS):
    lines = sorted({(d, i, x.strip(line_dedup._STRIP)) for d, t in rows if d is not None for i, x in enumerate((t or "").split("\n")) if x.strip(line_dedup._STRIP)})
    out, seen = set(), []
    for d, i, x in lines:
        if any(y == x and at != (d, i) or (min(len(x), len(y)) >= min_chars and at != (d, i) and near(x, y)) for at, y in seen):
            out.add((d, i))
        seen.append(((d, i), x))
    return out


def test_line_dedup(docs_of):
    rnd = random.Random(3)
    base = [f"the quick brown fox jumps {i} times" for i in range(6)] + ["x" * 16, "x" * 17, "x" * 18, "short line", "shorx line", "", " aaaaaaaaaaaaaaaabbbb", "é" * 20]

    def edit(s):
        if rnd.random() < 0.5 or not s:
            return s
        i = rnd.randrange(len(s))
        return rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice("abé ") + s[i:], s[:i] + rnd.choice("xyé") + s[i + 1 :]])

    rows = [(i, "\n".join(edit(rnd.choice(base)) for _ in range(rnd.randint(0, 6)))) for i in range(120)] + EDGES
    df = docs_of(rows)
    got = {(r.doc_id, r.line) for r in line_dedup.removed_lines(df).collect()}
    want = redundant(rows)
    assert got == want
    made = line_dedup.deduplicate(docs_of(rows, extra=True)).collect()
    assert len(made) == len(rows)
    texts = dict(rows)
    for r in made:
        if r.doc_id is not None and r.doc_id < 900:
            kept = [x for i, x in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, i) not in want]
            assert r.text == "\n".join(kept)
    assert {r.text for r in made if r.doc_id is None} == {"null id text here"}


@pytest.mark.parametrize("min_chars", [1, 5])
def test_short_lines(docs_of, min_chars):
    rnd = random.Random(min_chars)
    rows = [(i, "\n".join("".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(0, 7))) for _ in range(4))) for i in range(60)]
    got = {(r.doc_id, r.line) for r in line_dedup.removed_lines(docs_of(rows), min_chars).collect()}
    assert got == redundant(rows, min_chars) and got


def test_ties_and_emptied_documents(docs_of):
    line = "a line that is long enough"
    rows = [(2, line + "x\n" + line + "y"), (1, line + "z\n\nother text"), (3, line), (4, None), (5, "\n"), (None, line)]
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeated(docs_of(rows, extra=True)).collect()}
    assert kept == {1: line + "z\n\nother text", 4: None, 5: "\n", None: line}
    df = docs_of(rows, extra=True)
    assert line_dedup.drop_repeated(df).columns == df.columns


def test_lines_of_repeated_ids(docs_of):
    """Each row loses lines by its own text, whatever stands at that place of another row of its id."""
    rows = [(1, "first line of a text\nand then another one"), (2, "first line of a text\nkept by this row"), (2, "this other row keeps it\nand then another one"), (2, None)]
    got = sorted(str(r.text) for r in line_dedup.deduplicate(docs_of(rows, extra=True)).collect())
    assert got == sorted(["first line of a text\nand then another one", "kept by this row", "this other row keeps it", "None"])


def test_very_long_text_of_lines(docs_of):
    """Removal is linear in the lines of a document."""
    import time

    rows = [(1, "\n".join(f"line number {i * i} of a long text" for i in range(30_000))), (2, "\n".join(f"line number {i * i} of a long text" for i in range(0, 60_000, 2)))]
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.deduplicate(docs_of(rows)).collect()}
    assert got[1].n_lines == got[2].n_lines == 30_000 and got[2].n_removed >= 15_000 and time.time() - began < 120


def test_bitmap(spark):
    import numpy as np

    keys = [1, -5, 1 << 62]
    b = bitmap.bitmap_of(spark.createDataFrame([(k,) for k in keys], "k long"))
    assert bitmap.holds(b, np.array(keys)).all()
    assert not bitmap.holds(b, np.arange(100, 200)).all()


def windows(text, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return w, [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("limit", [(decontaminate.BROADCAST_WINDOWS, 1), (0, decontaminate.SENT_WINDOWS), (0, 0)])
def test_decontamination(spark, docs_of, limit):
    rnd = random.Random(8)
    text = lambda n: " ".join("".join(rnd.choice("abC1é") for _ in range(rnd.randint(1, 3))) for _ in range(n))
    items = [(i, text(rnd.choice([1, 3, 9, 10, 11, 30, 60]))) for i in range(25)] + [(50, None), (51, "..."), (52, text(12)), (52, text(12))]
    rows = []
    for i in range(80):
        parts = [text(rnd.randint(0, 40))]
        if rnd.random() < 0.6:
            w = (rnd.choice(items)[1] or "").split(" ")
            a = rnd.randrange(len(w))
            parts += [", ".join(w[a : a + rnd.randint(1, 30)]).upper().replace("É", "é"), text(5)]
        rows.append((i, " ".join(parts)))
    rows += EDGES
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = collections.defaultdict(set)
    for i, t in items:
        w, _ = windows(t)
        for x in windows(t, min(10, len(w)))[1] if w else []:
            known[x].add(str(i))
    got = decontaminate.digest(decontaminate.contamination(docs_of(rows, extra=True), bench, 10, 5, *limit)).collect()
    want = []
    for i, t in rows:
        w, _ = windows(t)
        hit, found = set(), set()
        for n in {len(x) for x in known}:
            for j, x in enumerate(windows(t, n)[1]):
                if x in known:
                    hit |= set(range(j, j + n))
                    found |= known[x]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_removal_keeps_clean_rows(spark, docs_of):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    rows = [(1, "x " + " ".join(f"w{i}" for i in range(10))), (2, " ".join(f"w{i}" for i in range(9))), (None, None)]
    assert sorted((r.doc_id or -1) for r in decontaminate.remove_contaminated(docs_of(rows), bench).collect()) == [-1, 2]


def test_decontamination_forms_agree(spark, docs_of):
    """Broadcast and join judge each row by its own text: null ids, shared ids, repeated rows."""
    passage = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage), (2, "rare pair"), (None, passage + " end"), (None, "of no id")], "item_id long, text string")
    rows = [(4, "it is of no id"), (1, "x " + passage), (1, "clean"), (None, "y " + passage), (None, "clean too"), (2, "a rare pair"), (2, "a rare pair"), (3, None)]
    docs = docs_of(rows + EDGES, extra=True)
    limits = [(1000, 1000), (0, 1000), (0, 0)]
    reports = [sorted(map(str, decontaminate.contamination(docs, bench, 10, 5, *n).collect())) for n in limits]
    assert reports[0] == reports[1] == reports[2]
    by_id = {(r.doc_id, tuple(r.items)) for r in decontaminate.contamination(docs, bench, broadcast_windows=0).collect()}
    assert {(4, (None,)), (1, (None, "1")), (1, ()), (2, ("2",))} <= by_id
    kept = [sorted(map(str, decontaminate.remove_contaminated(docs, bench, *n).collect())) for n in limits]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3 + len(EDGES)


def test_a_large_benchmark(spark, docs_of):
    """20,000 items: hashes alone are sent, and only true hits meet the items."""
    rnd = random.Random(12)
    items = [(i, " ".join(f"w{rnd.randrange(3000)}" for _ in range(14))) for i in range(20_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, " ".join(f"w{rnd.randrange(3000)}" for _ in range(40)) + (" " + items[i * 7][1] if i % 3 == 0 else "")) for i in range(300)]
    rows += [(1000, " ".join(t for _, t in items[:9000]))]  # a very long text
    for limits in ((decontaminate.BROADCAST_WINDOWS, decontaminate.SENT_WINDOWS), (0, 0)):
        got = {r.doc_id: r for r in decontaminate.contamination(docs_of(rows), bench, 10, 5, *limits).collect()}
        assert all(got[i]["items"] == ([str(i * 7)] if i % 3 == 0 else []) and got[i].n_hit == 14 * (i % 3 == 0) for i in range(300))
        assert got[1000].n_hit == 14 * 9000 and len(got[1000]["items"]) == 9000


@pytest.mark.parametrize("name", ["op2_ngram_join", "op9_decontamination", "op4_line_dedup"])
def test_queries_on_the_small_table(spark, sf, name):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES[name](spark, sf).collect()
    assert len(got) == len(docs)
    if name == "op2_ngram_join":
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(docs, 4, 85)
    if name == "op4_line_dedup":
        gone = redundant(docs)
        assert {r.doc_id: r.n_removed for r in got} == {d: sum(x[0] == d for x in gone) for d, _ in docs}
