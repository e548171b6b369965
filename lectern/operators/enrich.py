"""Keywords and metadata of chunks."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import batched, chain, groupby
from operator import and_, itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lectern.functions import text as T
from lectern.session import bounded_batches, free_names, materialise

#: Most keys shared by texts that are sent to every task, to tell these texts from those with keys of their own; more are joined.
SENT_KEYS = 1 << 18
#: Most texts of one key that are brought together as texts; words of more are counted apart.
TEXTS_TOGETHER = 64
_WORD, _STOP = re.compile("[\u0980-\u09FF]{3,}|[a-zA-Z]{4,}"), frozenset(T.STOPWORDS)


def _words(text: str | None) -> list[str]:
    """The words of T.words() in a text."""
    return [w for w in map(str.lower, _WORD.findall(text or "")) if w not in _STOP]


def _texts(df: DataFrame, key: list[str]) -> tuple[int, bool]:
    """Number of texts, and whether each has a key of its own without nulls."""
    n, own = df.agg(F.count("*"), F.count_distinct(*key)).first()
    return n, n == own


def _counted(df: DataFrame, key: list[str], body: str, top_n: int | None = None) -> DataFrame:
    """key, word, n, first_pos and rank of the words of T.words() in each text, where every key has one: no text leaves its task."""
    bounded_batches(df.sparkSession, size="2m")
    rows = df.select(*key, body)

    def count(batches):
        for batch in batches:
            at, words, numbers, places, ranks = [], [], [], [], []
            for i, text in enumerate(batch.column(len(key)).to_pylist()):
                found = _words(text)
                first = {w: j for j, w in reversed(list(enumerate(found)))}
                best = Counter(found).most_common(top_n)  # ties in order of first occurrence
                at += [i] * len(best)
                words += [w for w, _ in best]
                numbers += [n for _, n in best]
                places += [first[w] for w, _ in best]
                ranks += range(1, len(best) + 1)
            own = [batch.column(c).take(pa.array(at, pa.int32())) for c in range(len(key))]
            made = [pa.array(words, pa.string()), pa.array(numbers, pa.int64()), pa.array(places, pa.int32()), pa.array(ranks, pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, *made], names=[*key, "word", "n", "first_pos", "rank"])

    return rows.mapInArrow(count, _counted_as(rows))


def _counted_as(rows: DataFrame) -> StructType:
    kinds = (("word", StringType()), ("n", LongType()), ("first_pos", IntegerType()), ("rank", IntegerType()))
    return StructType([*rows.schema.fields[:-1], *[StructField(c, k) for c, k in kinds]])


def _merged(df: DataFrame, key: list[str], body: str, top_n: int | None = None) -> DataFrame:
    """The columns of _counted() where few texts share a key: they meet as texts, which take less than rows of their words."""
    bounded_batches(df.sparkSession, size="2m")
    rows = df.select(*key, body).repartition(*key).sortWithinPartitions(*key)

    def counted(batches):
        texts = (row for b in batches for row in zip(zip(*[c.to_pylist() for c in b.columns[:-1]], strict=True), b.columns[-1].to_pylist(), strict=True))
        for own, group in groupby(texts, itemgetter(0)):
            n, first = Counter(), {}
            for _, text in group:
                found = _words(text)
                n.update(found)
                for w, j in {w: j for j, w in reversed(list(enumerate(found)))}.items():
                    first[w] = min(j, first.get(w, j))
            for rank, w in enumerate(sorted(n, key=lambda w: (-n[w], first[w], w))[:top_n], 1):
                yield *own, w, n[w], first[w], rank

    def merge(batches):
        for head in batches:
            names, kinds = [*key, "word", "n", "first_pos", "rank"], [*head.schema.types[:-1], pa.string(), pa.int64(), pa.int32(), pa.int32()]
            for made in batched(counted(chain([head], batches)), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(merge, _counted_as(rows))


def _apart(df: DataFrame, key: list[str], most: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """Texts whose key has ``most`` texts, and those whose key has more (None where none has); nulls count as equal."""
    if most == 1 and _texts(df, key)[1]:
        return df, None
    names = free_names(df.columns, *key, "n")
    sizes = df.groupBy(*[F.col(c).alias(name) for c, name in zip(key, names, strict=False)]).agg(F.count("*").alias(names[-1]))
    shared = materialise(sizes.where(F.col(names[-1]) > most).drop(names[-1]))
    n = shared.count()
    if not n:
        return df, None
    same = reduce(and_, [df[c].eqNullSafe(shared[name]) for c, name in zip(key, names, strict=False)])
    few = F.broadcast(shared) if n <= SENT_KEYS else shared
    return df.join(few, same, "left_anti"), df.join(few, same, "left_semi")


def _ranked(counts: DataFrame, key: list[str], top_n: int | None, by: str = "n") -> DataFrame:
    """The first words of each key, or all, with their rank."""
    order = W.partitionBy(*key).orderBy(F.desc(by), "first_pos", "word")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked if top_n is None else ranked.where(F.col("rank") <= top_n)


def _gathered(df: DataFrame, key: list[str], body: str, top_n: int | None = None) -> DataFrame:
    """The columns of _counted() where texts share keys: few of one key meet as texts, of more the words counted in each text."""
    few, many = _apart(df, key, TEXTS_TOGETHER)
    best = _merged(few, key, body, top_n)
    if many is None:
        return best
    counts = _counted(many, key, body).groupBy(*key, "word").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    return best.unionByName(_ranked(counts, key, top_n))


def word_counts(df: DataFrame, key: list[str], body: str = "text") -> DataFrame:
    """key, word, n and the word's first place; empty where a text has no words.

    Keys are counted first. Words of texts with a key of their own are counted in place, and only those of texts that share one are shuffled.
    """
    own, shared = _apart(df, key)
    counts = _counted(own, key, body).drop("rank")
    return counts if shared is None else counts.unionByName(_gathered(shared, key, body).drop("rank"))


def top_keywords(df: DataFrame, key: list[str], body: str = "text", top_n: int = 10, by: str = "n") -> DataFrame:
    """The most frequent words of each text with their rank; ties by first occurrence."""
    if by != "n":
        return _ranked(tf_idf(df, key, body), key, top_n, by)
    own, shared = _apart(df, key)
    best = _counted(own, key, body, top_n)
    return best if shared is None else best.unionByName(_gathered(shared, key, body, top_n))


def tf_idf(df: DataFrame, key: list[str], body: str = "text") -> DataFrame:
    """word_counts with weight = n * ln(texts / texts that have the word)."""
    counts = word_counts(df, key, body)
    with_word = counts.groupBy("word").agg(F.count("*").alias("texts_with"))
    total = df.agg(F.count("*").alias("texts"))
    return counts.join(with_word, "word").crossJoin(F.broadcast(total)).withColumn("weight", F.col("n") * F.ln(F.col("texts") / F.col("texts_with")))


def tf_idf_totals(df: DataFrame, key: list[str], by: str, body: str = "text") -> DataFrame:
    """``by``, words (rows of tf_idf()) and the sum of their weights.

    Weights are sums, so where each key has one text they are taken from counts by ``by`` and word, and no row of a text and word travels.
    """
    texts, own = _texts(df, key)
    if not own:
        scored = tf_idf(df, key, body).join(df.select(*key, by), key)
        return scored.groupBy(by).agg(F.count("*").alias("words"), F.sum("weight").alias("weight"))
    sums = _counted(df, [*key, by], body).groupBy(by, "word").agg(F.count("*").alias("words"), F.sum("n").alias("n"))
    with_word = F.sum("words").over(W.partitionBy("word"))  # a row for each value of by
    weight = F.col("n") * F.ln(F.lit(texts) / with_word)
    return sums.withColumn("weight", weight).groupBy(by).agg(F.sum("words").alias("words"), F.sum("weight").alias("weight"))


def flags(df: DataFrame, body: str = "text") -> DataFrame:
    """``df`` with has_math, has_questions, difficulty and char_count; each pattern runs once over a text."""
    found = df.withColumns({"has_math": T.has_math(body), "has_questions": T.has_questions(body)})
    return found.withColumns({"difficulty": T.difficulty(body, F.col("has_math") | F.col("has_questions")), "char_count": F.length(body)})


def _keywords(body: str, top_n: int) -> Column:
    """The most frequent words of a text as an array; ties by first occurrence."""

    @F.pandas_udf("array<string>")
    def best(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w for w, _ in Counter(_words(t)).most_common(top_n)])

    return best(F.coalesce(body, F.lit("")))


def enrich(chunks: DataFrame, key: str = "chunk_id", top_n: int = 10) -> DataFrame:
    """Chunks with flags and their keywords as an array, most frequent first; none where the key is null.

    Chunks with a key of their own get them in place, by no join or shuffle; those that share one get the keywords of all its texts.
    """
    bounded_batches(chunks.sparkSession, size="2m")
    own, shared = _apart(chunks, [key])
    none = F.array().cast("array<string>")
    alone = flags(own).withColumn("keywords", F.when(F.col(key).isNotNull(), _keywords("text", top_n)).otherwise(none))
    if shared is None:
        return alone
    words = _gathered(shared, [key], "text", top_n)
    lists = words.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    return alone.unionByName(flags(shared).join(lists, key, "left").withColumn("keywords", F.coalesce("keywords", none)))


def report(enriched: DataFrame, *by: str) -> DataFrame:
    """Chunks, tokens, math and question counts; with ``by`` for each prefix of it and in total."""
    grouped = enriched.rollup(*by) if by else enriched.groupBy()
    return grouped.agg(
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.count_if("has_math").alias("with_math"), F.count_if("has_questions").alias("with_questions"),
    )


def ocr_report(pages: DataFrame, chunks: DataFrame | None = None, low: float = 0.6, blank: int = 20) -> tuple[DataFrame, DataFrame | None]:
    """Per book: pages, mean confidence, pages of low confidence and near-blank pages; and per book and section: chunks and tokens."""
    books = pages.groupBy("book").agg(
        F.count("*").alias("pages"), F.avg("avg_confidence").alias("avg_confidence"), F.count_if(F.col("avg_confidence") < low).alias("low_confidence"),
        F.count_if(F.length("text") < blank).alias("near_blank"),
    )
    if chunks is None:
        return books, None
    tokens = lambda f, name: f("token_count").alias(name)
    sections = chunks.groupBy("book", "section_title").agg(
        F.count("*").alias("chunks"), tokens(F.sum, "tokens"), tokens(F.min, "least"), tokens(F.max, "most"), tokens(F.avg, "mean")
    )
    return books, sections


def cooccurrence(words: DataFrame, key: str, word: str = "word") -> DataFrame:
    """Number of texts that hold both words of each pair, for distinct words of bounded number a text."""
    w = words.select(key, word).distinct()
    return (
        w.alias("x").join(w.alias("y"), key).where(F.col(f"x.{word}") < F.col(f"y.{word}"))
        .groupBy(F.col(f"x.{word}").alias("a"), F.col(f"y.{word}").alias("b")).agg(F.count("*").alias("n"))
    )


def incremental(new: DataFrame, known: DataFrame, key: list[str], body: str = "text") -> DataFrame:
    """Rows whose key and text hash are not in ``known`` (key, text_hash): what an index must take in."""
    hashed = new.withColumn("text_hash", F.sha2(F.coalesce(body, F.lit("")), 256))
    return hashed.join(known.select(*key, "text_hash"), [*key, "text_hash"], "left_anti")
