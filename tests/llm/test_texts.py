"""Token store, SentencePiece, chat, HTML, quality rules and classifiers."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import chat, html_text, pieces, quality_classifier, quality_rules, queries, token_store, toxicity
from lectern.llm.encoder import WordEncoder
from lectern.session import fresh_path

ODD = ["", " ", "a\x1cb c\x1f", "It's I'LL don't", "<|endoftext|>x <|startoftext|>", "É é  x\u3000y", "İstanbul ß ǅ", "日本語 テスト １２３", "x'S 's't 1,2", "👩‍👩‍👧 e", "a" * 500 + " b", "\x00 \x7f"]
EDGES = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (903, "one"), (None, "null id")]


@pytest.mark.parametrize("limit", [5, 10**6])
def test_word_encoder(tokenizers, limit):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    mine, theirs = WordEncoder(path, limit), Tokenizer.from_file(path)
    for t in ODD:
        raw = t.encode()
        assert np.frombuffer(mine.encode(raw, np.array([0, len(raw)]))[0], "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("make", [lambda w: [["[^ ]+"], w], lambda w: [["."], w]])
def test_other_tokenizers(tmp_path, make):
    """A file that cuts or writes words otherwise is encoded its own way; one that keeps white space is refused."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    (cut,), words = make(["[UNK]", "The", "the", "word", "a", "b", ".", "'"])
    tok = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    split = pre_tokenizers.Split(Regex(cut), "removed", invert=True)
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), split]) if cut != "." else split
    tok.save(path := str(tmp_path / "tok.json"))
    if cut == ".":
        with pytest.raises(ValueError):
            WordEncoder(path)
        return
    mine = WordEncoder(path)
    raw = b"The word the. A b"
    assert not mine.quick
    assert np.frombuffer(mine.encode(raw, np.array([0, len(raw)]))[0], "<u4").tolist() == tok.encode(raw.decode(), add_special_tokens=False).ids


def test_token_store(spark, docs_of, tokenizers):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    rows = [(10 * i + 5, t) for i, t in enumerate(ODD)] + EDGES
    where = fresh_path(spark, "store")
    token_store.write_store(docs_of(rows, extra=True).repartition(3), where, path)
    theirs, start = Tokenizer.from_file(path), 0
    got = sorted(token_store.read_store(spark, where).collect(), key=lambda r: r.start)
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1] is not None, x[1])), strict=True):
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 1]
        raw = np.array(ids, "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)
    some = token_store.read_documents(spark, where, docs_of([(5, ""), (903, ""), (77, ""), (None, "")])).collect()
    assert sorted(r.doc_id for r in some) == [5, 903, 903]


def test_damaged_frames_are_noticed(spark, docs_of, tokenizers):
    where = fresh_path(spark, "store")
    token_store.write_store(docs_of([(1, "some words here")]), where, tokenizers.path("word_bpe_49k.json"))
    folder = where.removeprefix("file://").removeprefix("file:")
    import glob
    import os

    name = next(f for f in glob.glob(f"{folder}/files/*.zst") if os.path.getsize(f))
    raw = bytearray(open(name, "rb").read())
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read()  # plain tools can read it
    whole, target = bytes(raw), f"{folder}/damaged"
    want = [bytes(x) for x in token_store.FrameReader(f"file://{name}").frames()]
    for at in range(len(whole)):  # any damaged byte is noticed, wherever it is
        for bit in (0, 3, 7):
            bad = bytearray(whole)
            bad[at] ^= 1 << bit
            open(target, "wb").write(bad)
            try:
                reader = token_store.FrameReader(f"file://{target}")
                same = (reader.ids.tolist(), [bytes(x) for x in reader.frames()]) == ([1], want)
            except ValueError:
                continue
            assert same, (at, bit)  # bits of a frame header that no content depends on


def test_random_reads_find_every_document(spark, docs_of, tokenizers):
    """Ids far apart, negative and repeated ones, over many files."""
    rows = [(i * i * (-1) ** i, f"text {i}") for i in range(80)] + [(7, "a"), (7, "b"), ((1 << 62), "far"), (None, "none")]
    where = fresh_path(spark, "store")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    token_store.write_store(docs_of(rows).repartition(5), where, tokenizers.path("word_bpe_49k.json"))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    every = {}
    for r in token_store.read_store(spark, where).collect():
        every.setdefault(r.doc_id, []).append(bytes(r.ids))
    wanted = [i for i, _ in rows] + [5, -6, 1 << 61]
    got = {}
    for r in token_store.read_documents(spark, where, docs_of([(i, "") for i in wanted])).collect():
        got.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in every.items() if k is not None}


def test_empty_store(spark, docs_of, tokenizers):
    assert token_store.encode_and_read_back(docs_of([]), tokenizers.path("word_bpe_49k.json")).count() == 0


PIECE_ODD = ["", " ", "  a  b ", "é😀 x\t\ny", "▁a ▁", "日本語テスト", "<s> </s>", "\x00\x01", "hello   world", "𝔘𝔫", "的的的 的"]


def test_pieces_equal_the_library(spark, docs_of, tokenizers):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate(PIECE_ODD)) + EDGES
    got = pieces.encode(docs_of(rows, extra=True), path)
    for r, (i, t) in zip(got.collect(), rows, strict=True):
        assert (r.doc_id, r.ids, r.n_tokens, r.round_trip) == (i, sp.encode(t or ""), len(r.ids), True)
    back = {r.doc_id: r.text for r in pieces.decode(got, path).collect() if r.doc_id is not None and r.doc_id < 900}
    assert back == {i: t.replace("▁", " ") for i, t in enumerate(PIECE_ODD)}


def test_pieces_over_a_whole_table(spark, sf, tokenizers):
    """Every document of the table: the library's ids, and the text again."""
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op5_sentencepiece"](spark, sf).collect()
    assert len(got) == len(texts) and all(r.ids == sp.encode(texts[r.doc_id] or "") and r.round_trip for r in got)


def test_token_ids_of_a_whole_table(spark, sf, tokenizers):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in queries.QUERIES["op1_token_store"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        x = got.pop(r.doc_id)
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_byte_pairs_relax_to_the_way_without_faults(tokenizers):
    """Against the plain definition: the fewest faults over all ways to cut a part."""
    e = pieces.Encoder(pieces.Pieces.load(tokenizers.path("piece_bpe_32k.model")))
    by = e.ids

    def least(t):
        best = {(0, -1): 0}  # (position, last piece)
        for end in range(1, len(t) + 1):
            for start in range(max(0, end - 16), end):
                if (i := by.get(t[start:end])) is not None:
                    for (at, last), f in list(best.items()):
                        if at == start:
                            got = f + (not e._stay_apart(last, i))
                            best[end, i] = min(best.get((end, i), 99), got)
        return min(f for (at, _), f in best.items() if at == len(t))

    for w in ("▁internationalisation", "▁Wörterbücher", "▁1234567", "▁thethethe", "▁▁▁x", "▁aaaaaaaaaaa"):
        ids = e.part(w)
        assert least(w) == 0 and "".join(e.pieces.strings[i] for i in ids) == w
        assert all(e._stay_apart(a, b) for a, b in zip([-1, *ids], ids, strict=False))


def test_very_long_texts(spark, docs_of, tokenizers):
    """Texts far beyond a slice, with and without spaces."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from tokenizers import Tokenizer

    path, piece = tokenizers.path("word_bpe_49k.json"), tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "words and more words, " * 100_000), (2, "é" * 300_000), (3, "x1" * 150_000 + " end")]
    df = docs_of(rows)
    got = {r.doc_id: r for r in token_store.encode_and_read_back(df, path).collect()}
    got_pieces = {r.doc_id: r for r in pieces.encode(df, piece).collect()}
    tok, sp = Tokenizer.from_file(path), sentencepiece.SentencePieceProcessor(model_file=piece)
    for i, t in rows:
        assert got[i].n_tokens == len(tok.encode(t, add_special_tokens=False).ids) + 1
        assert got_pieces[i].round_trip and (i != 1 or got_pieces[i].ids == sp.encode(t))


def test_unigram_is_the_best_segmentation():
    import random

    rnd = random.Random(0)
    strings = {3 + i: s for i, s in enumerate(sorted({"▁", "a", "b", "ab", "▁a", "ba", "aab", "▁ab", "bb"}))}
    scores = {i: -rnd.random() * 3 - 0.5 for i in strings}
    e = pieces.Encoder(pieces.Pieces(strings, scores, {}, 0, "unigram"))
    by = {s: i for i, s in strings.items()}

    def best(t):
        if not t:
            return 0.0
        return max((scores[by[t[:n]]] + best(t[n:]) for n in range(1, len(t) + 1) if t[:n] in by), default=-1e30)

    for _ in range(200):
        t = "▁" + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9)))
        assert sum(scores[i] for i in e.part(t)) == pytest.approx(best(t))


CONTROL = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>x", "[INST]", "a<", "<<s>>", "[/INST", "]", "\\", "</s>", "[\\/INST]", "<\\", "[[INST]]", "", "user"]


@pytest.mark.parametrize("role", CONTROL)
def test_turns_round_trip(role):
    for text in CONTROL:
        x = chat.render_turn(role, text)
        assert [y[:2] for y in chat.parse(x + x)] == [(role, text)] * 2


def test_plain_texts_stay_plain():
    assert chat.render_turn("user", "a [b] <c> \\d") == "<s>[INST]user[/INST]a [b] <c> \\d</s>"
    for bad in ("x", "<s>[INST]user", "<s>[INST]u[/INST]t", "<s>[INST]u[/INST]<s></s>"):
        with pytest.raises(chat.FormatError):
            chat.parse(bad)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, None, None), (None, 5, "assistant", "x"), (1, 2, "assistant", "b</s>"), (1, 2, "assistant", "b</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("piece", F.lit(2))
    got = {r.conv_id: r for r in chat.read_back(chat.render(df)).collect()}
    loss = "b</s>" * 3
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].turns_sha256 == hashlib.sha256(("user\na\n" + "assistant\nb</s>\n" * 3).encode()).hexdigest()
    assert (got[2].n_turns, got[2].loss_chars, got[None].loss_chars) == (1, 0, 1)
    whole = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert len(whole[1].formatted) == got[1].formatted_chars
    assert "".join(chat.unescape(whole[1].formatted[a:b]) for a, b in whole[1].loss_spans) == loss
    assert chat.read_back(chat.render(df.limit(0))).count() == 0


def test_chat_query(spark, sf):
    got = {r.conv_id: r for r in queries.QUERIES["op7_chat_format"](spark, sf).collect()}
    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows[r.conv_id].append(r)
    for i, turns in rows.items():
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r.role}\n{r.text or ''}\n" for r in turns).encode()).hexdigest()
    assert (got[-1].n_turns, got[-1].loss_chars) == (2, 21) and len(got) == len(rows) + 1


PAGE = """<html><head><title>t</title></head><body><header class="top">H</header><div id="cookie-notice">We use cookies here</div><ul class="menu"><li>m</ul>
<div class="wrap"><div class="content post-12"><h1>T &amp; &#233;</h1><p>Some long text  that is <b>bo</b>ld<p>second &lt;para&gt;<br>x &nbsp; y</p><script>no()</script>
<div class="comments"><p>a reader's comment that is longer than all of the article's own text and should not be taken for it at all, ever, by anyone</p></div></div>
<aside>side</aside></div><form><p>f</p></form><div class="ad">buy</div><footer>c</footer></body>"""
TEXT = "T & é Some long text that is bold second <para> x y"


def test_page_text(spark):
    rows = [(1, "http://a/1", PAGE), (2, "http://a/2", None), (3, None, ""), (4, "http://a/3", PAGE[: PAGE.index("<aside")]), (4, "x", "just text"), (5, "http://b", "<p>no end &amp"), (6, "http://c", "<<<>>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("path", F.lit("y"))).collect()
    texts = collections.Counter((r.page_id, r.text) for r in got)
    assert texts[(1, TEXT)] == 1 and texts[(2, "")] == 1 and texts[(3, "")] == 1 and texts[(4, TEXT)] == 1 and texts[(4, "just text")] == 1 and texts[(5, "no end &")] == 1
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)


def test_host_vote_overrules_a_page(spark):
    page = lambda i, main, side: f"<body><div class='main{i}'><p>{'w ' * main}</p></div><div class='box'><p>{'s ' * side}</p></div></body>"
    rows = [(i, "http://h/", page(i, 50, 5)) for i in range(5)] + [(9, "http://h/", page(9, 3, 60))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "w w w"


ARTICLE = "<body><article><h1>T</h1><p>Some text of the article, long enough</p>{0}</article></body>"


@pytest.mark.parametrize("inside,kept", [
    ("<article class='comment'><p>a reader's opinion</p></article>", ""),
    ("<div itemtype='https://schema.org/Comment'>a reader</div>", ""),
    ("<p class='related-work'>Earlier work is cited here.</p>", "Earlier work is cited here."),
    ("<div class='related'><a href='x'>one</a> <a href='y'>two</a></div>", ""),
    ("<section class='search form'><p>How we searched and what form it took.</p></section>", "How we searched and what form it took."),
    ("<p>see <a title=it's href=x>here</a> and it's fine</p>", "see here and it's fine"),
    ("<p>5 > 4 <a title='x > y' href=\"a'b\">q</a></p>", "5 > 4 q"),
    ("<div data-id='ad' data-class='comments'>plain</div>", "plain"),
    ("<div class='cookie-notice'>We use cookies</div>", ""),
    ("wo<span class='tag'>rd</span>", "word"),
    *[(f"<div class='{c}'>Buy or accept this</div>", "") for c in (
        "promo-content", "sponsored-post", "banner-text", "newsletter-text", "modal-body", "popup-content", "menu-content", "widget-body", "breadcrumb-main", "gdpr-text", "consent-text",
        "pagination-content", "toolbar-main", "copyright-text", "ad", "ad-slot-2", "article-ad", "comments-area", "post ad", "cookies")],
    *[(f"<section class='{c}'><p>A part of the article.</p></section>", "A part of the article.") for c in (
        "menu-planning", "widget-theory", "promoted-growth", "reply-all-explained", "comments-open", "has-sidebar", "advertising-history", "elementor-widget-theme", "content notice")],
    ("<header><h2>A headline</h2></header>", "A headline"),
    ("<header class='entry-header'><h2>A headline</h2></header>", "A headline"),
    ("<footer>about the author</footer>", ""),
    ("<div class='menu-planning'><a href=x>One</a> <a href=y>Two</a></div>", ""),
])
def test_inside_an_article(spark, inside, kept):
    page = ARTICLE.format(inside)
    (r,) = html_text.extract(spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")).collect()
    assert r.text == f"T Some text of the article, long enough {kept}".strip()


@pytest.mark.parametrize("teaser", ["", "<p>Read on</p>"])
def test_an_article_outside_the_voted_path(spark, teaser):
    """A page without text, or with a line of it, under its host's path keeps its own article."""
    page = lambda i: f"<body><div class='content'><p>{'w ' * 50}</p></div></body>"
    odd = f"<body><div class='content'>{teaser}</div><section class='longread'><p>{'s ' * 300}</p></section></body>"
    rows = [(i, "http://h/", page(i)) for i in range(5)] + [(9, "http://h/", odd)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == ("s " * 300).strip() and got[0] == ("w " * 50).strip()


def test_no_pages(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hosts_of_many_paths(spark):
    """The join gives what the votes beside a page give; ties go to the first path."""
    page = lambda c, n: f"<body><div class='{c}'><p>{'w ' * n}{c}</p></div><div class='box'><p>{'s ' * 9}</p><ul class='links'><li><a href='x'>l</a></ul></div></body>"
    rows = [(i, f"http://h{i % 2}/", page("abcdef"[i % 6], i)) for i in range(40)] + [(None, None, page("z", 3)), (7, "http://h1/", None), (8, "http://h1/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("votes", F.lit(2))
    texts = [sorted(map(str, html_text.extract(df, n).collect())) for n in (64, 1)]
    assert texts[0] == texts[1] and len(texts[0]) == len(rows)


def test_deep_and_long_pages():
    import time

    began = time.time()
    deep = "<div class='c'>" * 20_000 + "text" + "</div>" * 20_000
    assert html_text.main_text(deep, html_text.ballot(deep)) == "text"
    wide = "<body><article>" + "<p>some words here</p>" * 100_000 + "<a b=\"" * 1000
    assert len(html_text.main_text(wide, html_text.ballot(wide))) >= 1_499_999
    assert time.time() - began < 60


def test_pages_table(spark, sf):
    import html

    for r in queries.QUERIES["op8_html_text"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r.html.split("<article>", 1)[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>|<[^>]*\Z", "", body))
        assert r.text == " ".join(x for x in (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks) if x)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base_counts(t):
    w = words(t)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(runs)
    hit = {j for i, x in enumerate(runs) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, sf, docs_of):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += EDGES + [(910, "a b c d e f g h " * 9), (911, "\n".join(["x", " x", "x", "", ""])), (912, "é #|<" * 30), (913, "q\x0bw\x0ce\rr")]
    trusted = docs_of([(i, "") for i, _ in rows if i is not None and i % 3 == 0]).select("doc_id").distinct()
    buckets = 256

    def grams(t):
        w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in words(t)]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(w, w[1:])]
        return [x % buckets for x in w], [x % buckets for x in two]

    raw, target = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for i, t in rows:
        for kind, g in enumerate(grams(t)):
            raw[kind].update(g)
            if i is not None and i % 3 == 0:
                target[kind].update(g)
    # Two multinomials, each smoothed by the same share of its mass.
    ratio, five = [], 5.0
    for k in (0, 1):
        t_all, r_all = target[k].total(), raw[k].total()
        mine = lambda b, k=k, t_all=t_all: (target[k][b] + five) / (t_all + five * buckets)
        theirs = lambda b, k=k, t_all=t_all, r_all=r_all: (raw[k][b] + five * r_all / t_all) / (r_all + five * buckets * r_all / t_all)
        ratio.append({b: np.log(mine(b) / theirs(b)) for b in range(buckets)})
    want = []
    for i, t in rows:
        g = grams(t)
        n = sum(map(len, g))
        score = sum(ratio[k][b] for k in (0, 1) for b in g[k]) / n if n else 0.0
        c = base_counts(t)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want.append((i, *c, failed, score))
    for limit in (1 << 19, 0):  # sent to all tasks, or joined
        got = quality_rules.judge(docs_of(rows, extra=True), trusted, -0.05, buckets, limit, limit).collect()
        order = lambda x: (str(x[:7]), round(x[-1], 4))
        for r, x in zip(sorted(((*r[:7], r.kept, r.score) for r in got), key=order), sorted(want, key=order), strict=True):
            assert r[:7] == x[:7] and r[-1] == pytest.approx(x[-1], abs=2e-6)
            assert r[7] == (not x[6] and r[-1] >= -0.05)


def test_quality_rules_trust_every_good_document(spark):
    """All good labels count, however many there are."""
    labels = spark.range(30_000).selectExpr("id as doc_id", "1 as quality")
    good = quality_rules.trusted_documents(labels)
    assert good.count() == 30_000
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('w', id % 5) as text")
    ratios = quality_rules.bucket_ratios(docs, good, 64)
    assert all(x == 0 for r in ratios.collect() for x in r.ratios)  # every document is trusted: both distributions are one


def test_quality_rules_tell_good_from_bad(spark):
    """Ratings that the trusted documents don't include: nearly all good ones are kept, and nearly no bad ones."""
    where = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    good = quality_rules.trusted_documents(labels.where(~held))
    got = quality_rules.judge(docs, good).join(labels.where(held), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n"))
    rates = {r.quality: r.kept for r in got.collect()}
    assert rates[1] > 0.98 and rates[0] < 0.05, rates


def test_quality_rules_buckets_grow(spark, docs_of):
    small, large = docs_of([(1, "a b")]), spark.range(30_000).selectExpr("id as doc_id", "repeat('word ', 4000) as text")
    assert quality_rules.bucket_number(docs_of([])) == quality_rules.bucket_number(small) == quality_rules.LEAST_BUCKETS < quality_rules.bucket_number(large)


def test_trusted_ids_of_any_kind(spark, docs_of):
    """Masks and the shuffle mark the same documents: negative, huge and repeated ids."""
    ids = [0, 1, 63, 64, -1, -64, -65, (1 << 62) + 5, -(1 << 63), 127, 127]
    docs = docs_of([(i, "x") for i in [*ids, 2, 62, 65, -2, None]])
    trusted = docs_of([(i, "") for i in [*ids, None]]).select("doc_id")
    for limit in (1 << 20, 0):
        got = quality_rules._marked(docs, trusted, limit).collect()
        assert len(got) == len(ids) + 5 and {r.doc_id for r in got if r.good} == set(ids)


def test_quality_rules_without_trust(spark, docs_of):
    labels = spark.createDataFrame([(None, 1), (1, 0)], "doc_id long, quality int")
    good = quality_rules.trusted_documents(labels)
    r = quality_rules.judge(docs_of([(1, "word " * 3 + " ".join(map(str, range(30))))]), good).first()
    assert (r.score, r.kept) == (0.0, True)
    assert quality_rules.judge(docs_of([]), good).count() == 0


def test_toxicity(spark, docs_of):
    import random

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 7)))
    rows, labels = [], []
    for i in range(600):
        w, bad = [word() for _ in range(rnd.randint(5, 80))], i % 5 == 0
        if bad:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["Gruzzle", "blarghy", "éxecrâ"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df = docs_of(rows + EDGES, extra=True)
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.scores(df, toxicity.train(df, lab)).collect()
    assert len(got) == len(rows) + len(EDGES)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(600))
    right = sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held)
    assert right > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id is None or r.doc_id >= 900)
    clean = toxicity.remove_toxic(df, lab)
    assert clean.columns == df.columns and clean.where("doc_id % 5 = 0 and doc_id < 600").count() < 10
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scores(df, toxicity.train(df, one)).collect()} == {0.0}
    assert toxicity.scores(docs_of([]), toxicity.train(docs_of([]), lab)).count() == 0


def test_quality_classifier(spark, docs_of):
    import random

    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        g = i % 3
        rows.append((i, " ".join(rnd.choice(["alpha", "beta", "gamma"] if rnd.random() > 0.5 * g else ["zip", "zap", "zup"]) for _ in range(60))))
        labels.append((i, 2 - g))
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    df = docs_of(rows + EDGES, extra=True)
    model = quality_classifier.train(df, lab.where("doc_id % 4 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality_classifier.rate(df, model).collect() if r.doc_id is not None}
    held = [got[i] for i in range(0, 400, 4)]
    assert np.mean([abs(r.expected_grade - (2 - r.doc_id % 3)) for r in held]) < 0.35
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got.values())
    none = quality_classifier.train(df, lab.where("quality = 1"))
    assert all(r.kept and r.expected_grade == 1.0 for r in quality_classifier.rate(df, none).collect())
    assert quality_classifier.rate(docs_of([]), quality_classifier.train(docs_of([]), lab)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    from lectern.llm import decontaminate, line_dedup, ngram_join

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, sf))
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(set(after)) == len(after) and set(after) <= before, name
    assert docs.where("n_chars <> length(text)").count() == 0
    assert ngram_join.similar_documents(docs, 5, 80).where("component_id <> doc_id").count() == 0
    assert line_dedup.removed_lines(docs).count() == 0
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.contamination(docs, bench).where("n_hit > 0").count() == 0
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.collect()} == set(after) and out.where("not round_trip").count() == 0
