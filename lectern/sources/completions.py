"""Model replies for prompts: each distinct prompt once, cached, repaired once, else for review."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.messages import json_reply
from lectern.session import materialise

# Fixed values of the client.
RETRIED = (429, 500, 502, 503, 504)
ATTEMPTS = 3
BACKOFF = 2.0


class HttpError(Exception):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def _call(client: Callable[[str], str], prompt: str, sleep: Callable[[float], None]) -> tuple[str | None, str | None, int]:
    error = None
    for attempt in range(ATTEMPTS):
        try:
            return client(prompt), None, attempt + 1
        except (HttpError, TimeoutError, ConnectionError) as e:
            error = str(e)
            if attempt + 1 < ATTEMPTS:
                sleep(BACKOFF * 2**attempt)
    return None, error, ATTEMPTS


def complete(prompts: DataFrame, cache: DataFrame | None, client: Callable[[str], str], sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """(replies for every prompt row, new cache rows); ``prompts`` has key and prompt.

    The client is asked once per distinct key that the cache lacks; failures are not cached.
    Replies have reply, json (null if none could be read), error, cached and attempts.
    """
    keys = prompts.groupBy("key").agg(F.min("prompt").alias("prompt"))
    open_ = keys.join(cache.select("key"), "key", "left_anti") if cache is not None else keys

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *_call(client, p, sleep)) for k, p in zip(b["key"], b["prompt"], strict=True)]
            yield pd.DataFrame(rows, columns=["key", "reply", "error", "attempts"])

    fresh = materialise(open_.mapInPandas(ask, "key string, reply string, error string, attempts int"))
    new = fresh.where("error is null").select("key", "reply")
    known = fresh.withColumn("cached", F.lit(False))
    if cache is not None:
        old = cache.select("key", "reply", F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"), F.lit(True).alias("cached"))
        known = known.unionByName(old)
    return prompts.join(known, "key", "left").withColumn("json", json_reply("reply")), new


def repair(replies: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """One more try for replies that aren't JSON; what still isn't needs review."""
    good = replies.where("json is not null").withColumn("needs_review", F.lit(False))
    bad = replies.where("json is null")
    again, _ = complete(bad.select("key", "prompt"), None, client)
    return good.select("key", "prompt", "reply", "json", "needs_review").unionByName(
        again.withColumn("needs_review", F.col("json").isNull()).select("key", "prompt", "reply", "json", "needs_review")
    )


def batches(rows: DataFrame, size: int = 5, by: str = "book", order: str = "chunk_id") -> DataFrame:
    """``rows`` with the number of their batch of ``size`` within each ``by``."""
    from pyspark.sql import Window as W

    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / size))


# Fields of the replies.
CONCEPTS = "concepts array<struct<label_en: string, aliases_bn: array<string>, typical_forms: array<string>, difficulty_1_5: int, grounding_quote_bn: string>>"
QUESTIONS = (
    "questions array<struct<question_bn: string, options_bn: array<string>, answer: string, worked_solution_bn: string,"
    " distractor_logic: map<string, string>, question_form: string>>"
)


def fill(template: str, **values: Column) -> Column:
    """``template`` with each {name} replaced by a column; nulls become empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def concepts(replies: DataFrame, key: str = "section_id", source: str = "section_text") -> tuple[DataFrame, DataFrame]:
    """(concepts, dropped ones): a row per concept of ``replies`` (key, json, source), those with a quote that their section lacks apart."""
    one = replies.select(key, source, F.explode(F.from_json("json", CONCEPTS)["concepts"]).alias("c")).select(key, source, "c.*")
    stands = F.coalesce(F.contains(F.col(source), F.col("grounding_quote_bn")), F.lit(False)) & (F.trim("label_en") != "")
    return one.where(stands).drop(source), one.where(~F.coalesce(stands, F.lit(False))).drop(source)


def generated_questions(replies: DataFrame, key: str = "concept_id") -> tuple[DataFrame, DataFrame]:
    """(questions, malformed ones): a row per question of ``replies`` (key, json); a fine one has a stem, four options and a letter for an answer."""
    one = replies.select(key, F.posexplode(F.from_json("json", QUESTIONS)["questions"]).alias("place", "q")).select(key, "place", "q.*")
    fine = F.coalesce((F.trim("question_bn") != "") & (F.size(F.filter("options_bn", lambda o: F.trim(o) != "")) == 4) & F.col("answer").isin(*"ABCD"), F.lit(False))
    return one.where(fine), one.where(~fine)


def store_cache(new: DataFrame, path: str) -> None:
    """Append new replies (key, reply) to the cache at ``path``, which read_cache() reads."""
    new.select("key", "reply").write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """key and reply of a stored cache, one row a key."""
    return spark.read.schema("key string, reply string").parquet(path).groupBy("key").agg(F.min("reply").alias("reply"))


def grounded(found: DataFrame, quote: str = "quote", source: str = "source") -> DataFrame:
    """Rows whose quote stands in their source."""
    return found.where(F.contains(F.col(source), F.col(quote)))


def solvable(generated: DataFrame) -> DataFrame:
    """Generated questions that a solver could answer as stated."""
    return generated.where(F.col("solvable") & (F.col("solver_answer") == F.col("stated_answer")))


def stats(replies: DataFrame) -> DataFrame:
    """Calls, cache hits, failures and unreadable replies."""
    return replies.dropDuplicates(["key"]).agg(
        F.sum("attempts").alias("calls"), F.count_if("cached").alias("cache_hits"), F.count_if(F.col("error").isNotNull()).alias("failures"),
        F.count_if(F.col("error").isNull() & F.col("json").isNull()).alias("unreadable"),
    )
