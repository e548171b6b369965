"""Quality rules with DataFrame functions only: base counts and a hashed n-gram likelihood ratio.

Words are runs without ASCII white space. Words and word pairs fall into buckets by hash,
whose number grows with the square root of the corpus, about as its vocabulary does. Two
smoothed multinomials over the buckets, one of the whole raw corpus and one of trusted
documents, give each bucket a log-likelihood ratio; a document's score is the mean ratio
of its words and pairs, and it is kept when it passes the base rules and its score reaches
the threshold. There is no sampling in that verdict. Ratios are rounded to multiples of
2**-20, so sums don't depend on their order and the same score always gives the same verdict.

Both multinomials are smoothed by SMOOTHING target counts a bucket: their ratio is
(target + SMOOTHING) / (raw * all target / all raw + SMOOTHING), 1 where nothing is known,
so what a bucket saw once says little, and trusted documents gain little by their own words.

Null texts have no words: their counts are 0, their score is 0.0 and they fail the base
rules. An empty table gives no rows; without trusted documents every ratio is 0. Repeated
rows each count and each get a row. Only doc_id and text are read, whatever other columns
are named, and a null doc_id is never trusted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import discard, materialise

#: Least number of buckets for words and for pairs, and buckets per square root of a byte of text.
LEAST_BUCKETS = 1 << 17
GROWTH = 8
#: Masks of 64 ids each that are sent to every task (40 MB at most) to tell trusted documents
#: where they are; with more of them ids and texts meet in a shuffle, with the same results.
MASK_ROWS = 1 << 20
#: Buckets whose ratios travel in one row, and so many of those rows that are sent to every
#: task (40 MB at most); larger tables are joined, with the same results.
PACKED = 16
BROADCAST_ROWS = 1 << 19
SMOOTHING = 5.0
#: Least mean log-likelihood ratio of a kept document.
THRESHOLD = -0.2
_UNIT = 1 << 20

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\f\r"


def _following(h: Column, step: int) -> Column:
    """Hashes of neighbours ``step`` apart: from runs of n words to runs of n + step words."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, step + 1, n), lambda x, y: F.xxhash64(x, y))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = lambda x, j: same(x, j - 1) | same(x, j + 1)
        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    at = F.transform(F.array(pairs), places)[0]
    return F.aggregate(
        at, start,
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def with_words(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, the columns ``more`` and the hashes of words and of word pairs."""
    solid = F.btrim("text", F.lit(_SPACE))
    words = F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, r"[\x20\x09-\x0D]+"))
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
        .withColumn("word", F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn("pair", _following(F.col("word"), 1))
    )


def _bucket(buckets: int) -> Column:
    """Bucket of an exploded gram (n words, pos, h): pairs come after all words."""
    kind = F.when(F.col("pos") < F.col("n"), 0).otherwise(buckets)
    return (F.col("h").bitwiseAND(F.lit(buckets - 1)) + kind).cast("int")


def bucket_number(docs: DataFrame) -> int:
    """A power of two that grows with the square root of the bytes of all texts, up to the largest table that is sent to tasks.

    Another number is another model, so verdicts near the threshold may move where a corpus passes a power of two.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(BROADCAST_ROWS * PACKED // 2, max(LEAST_BUCKETS, 1 << math.ceil(math.log2(GROWTH * math.sqrt(size) + 1))))


def _marked(docs: DataFrame, trusted: DataFrame, mask_rows: int) -> DataFrame:
    """doc_id, text and good: 1 for trusted documents, else null."""
    texts = docs.select("doc_id", "text")
    bit = F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")
    masks = trusted.where("doc_id is not null").groupBy(F.shiftright(F.col("doc_id").cast("long"), 6).alias("ids"))
    masks = materialise(masks.agg(F.bit_or(F.expr("shiftleft(1L, cast(doc_id & 63 as int))")).alias("mask")))
    if masks.count() > mask_rows:
        good = trusted.select("doc_id").distinct().withColumn("good", F.lit(1)).hint("shuffle_hash")
        return texts.join(good, "doc_id", "left")
    found = texts.join(F.broadcast(masks), F.shiftright(F.col("doc_id").cast("long"), 6) == F.col("ids"), "left")
    set_ = F.call_function("shiftrightunsigned", F.col("mask"), bit).bitwiseAND(F.lit(1)) == 1
    return found.select("doc_id", "text", F.when(set_, 1).alias("good"))


def bucket_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, smoothing: float = SMOOTHING, mask_rows: int = MASK_ROWS) -> DataFrame:
    """slot and ratios: log-likelihood ratios of PACKED buckets a row, in units of 1 / _UNIT.

    ``trusted`` (doc_id) may be of any size. The raw counts cover every document, the target
    ones every trusted document.
    """
    marked = with_words(_marked(docs, trusted, mask_rows), "good")
    grams = marked.select("good", F.size("word").alias("n"), F.posexplode(F.concat("word", "pair")).alias("pos", "h"))
    counts = materialise(grams.groupBy(_bucket(buckets).alias("bucket")).agg(F.count("*").alias("raw"), F.count("good").alias("target")))
    totals = {r["pairs"]: (r["target"], r["raw"]) for r in counts.groupBy((F.col("bucket") >= buckets).alias("pairs")).agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()}
    share = lambda pairs: F.lit(totals[pairs][0] / totals[pairs][1] if pairs in totals else 0.0)
    expected = F.col("raw") * F.when(F.col("bucket") >= buckets, share(True)).otherwise(share(False))
    known = F.when(F.col("bucket") >= buckets, share(True) > 0).otherwise(share(False) > 0)
    ratio = F.when(known, F.round(F.ln((F.col("target") + smoothing) / (expected + smoothing)) * _UNIT).cast("int")).otherwise(0)
    place = F.col("bucket") % PACKED
    each = [F.coalesce(F.max(F.when(place == i, F.col("ratio"))), F.lit(0)) for i in range(PACKED)]
    packed = counts.withColumn("ratio", ratio).groupBy(F.shiftright("bucket", int(math.log2(PACKED))).alias("slot")).agg(F.array(*each).alias("ratios"))
    table = materialise(packed)
    discard(counts)
    return table


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids of all documents rated good."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


_BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int | None = None, broadcast_rows: int = BROADCAST_ROWS, mask_rows: int = MASK_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score."""
    buckets = buckets or bucket_number(docs)
    table = bucket_ratios(docs, trusted, buckets, mask_rows=mask_rows)
    sent = 2 * buckets // PACKED <= broadcast_rows
    if sent:
        table = F.broadcast(table)
    else:  # a table asked for that is too large to send: grams are shuffled by row number, which is written so that it stays
        docs = materialise(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    base = (
        with_words(docs, *([] if sent else ["row"]))
        .withColumn("four", _following(F.col("pair"), 2))
        .withColumn("lines", lines)
        .select(
            (F.monotonically_increasing_id() if sent else F.col("row")).alias("row"), "doc_id",
            F.size("word").cast("long").alias("n_words"),
            (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            # A window that comes twice holds four words that do.
            F.when(F.size(F.array_distinct("four")) < F.size("four"), _covered(_following(F.col("four"), 4)))
            .otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
            F.concat("word", "pair").alias("grams"),
        )
    )
    # A row's grams stay together, so they are summed where they are and one row a document is shuffled.
    grams = base.select("row", *(_BASE if sent else []), F.col("n_words").alias("n"), F.posexplode_outer("grams").alias("pos", "h")).withColumn("bucket", _bucket(buckets))
    found = grams.join(table, F.shiftright("bucket", int(math.log2(PACKED))) == F.col("slot"), "left")
    ratio = F.get("ratios", F.col("bucket") % PACKED).cast("long")
    sums = F.sum(ratio).alias("sum"), F.count("h").alias("grams")
    summed = found.groupBy("row").agg(*[F.first(c).alias(c) for c in _BASE], *sums) if sent else base.select("row", *_BASE).join(found.groupBy("row").agg(*sums), "row")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    score = F.when(F.col("grams") > 0, F.col("sum") / (F.col("grams") * F.lit(float(_UNIT)))).otherwise(F.lit(0.0))
    return (
        summed.withColumn("score", score).withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .select(*_BASE, "base_failed", "kept", "score")
    )
