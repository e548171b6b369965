"""Queries over labels and their joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import enrich, metrics
from lectern.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT count(*) AS n, round(avg(CAST(s = ts AS INTEGER)), 6) AS subject_accuracy, round(avg(CAST(c = tc AS INTEGER)), 6) AS concept_accuracy, round(avg(CAST(c // 2 = tc // 2 AS INTEGER)), 6) AS parent_accuracy FROM
 (SELECT lang AS s, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS ts, doc_id % 10 AS c, (doc_id + CAST(toxic AS INTEGER)) % 10 AS tc FROM documents JOIN labels USING (doc_id))""")
def label_accuracy(spark, sf):
    """Accuracy of made-up predictions against labels, by subject, concept and parent concept."""
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    concept = lambda n: F.format_string("c%d", n % 10)
    predicted = both.select(F.col("doc_id").alias("qid"), F.col("lang").alias("subject"), concept(F.col("doc_id")).alias("concept_id"))
    truth = both.select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")).alias("subject"), concept(F.col("doc_id") + F.col("toxic")).alias("concept_id"))
    parents = spark.range(10).select(F.format_string("c%d", "id").alias("concept_id"), F.format_string("p%d", F.floor(F.col("id") / 2)).alias("parent"))
    m = metrics.label_accuracy(predicted, truth, parents)
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("subject_accuracy", "concept_accuracy", "parent_accuracy")])


@query("SELECT doc_id AS qid, CAST((doc_id * 37) % 100 AS INTEGER) AS confidence FROM documents WHERE (doc_id * 37) % 100 < 60 OR doc_id % 10 NOT IN (1, 2, 3, 5, 8)")
def review_queue(spark, sf):
    """Labels that people should look at."""
    labels = table(spark, sf, "documents").select(
        F.col("doc_id").alias("qid"), (F.col("doc_id") * 37 % 100).cast("int").alias("confidence"), (F.col("doc_id") % 10).alias("concept_id"), F.array(*[F.lit(x).cast("long") for x in (1, 2, 3, 5, 8)]).alias("concept_candidates")
    )
    return metrics.needs_review(labels).select("qid", "confidence")


@query("""SELECT metric, round(value, 6) AS value, threshold, coalesce(value >= threshold, false) AS passed FROM (VALUES ('quality', 0.8), ('toxic', 0.5), ('missing', 0.1)) t(metric, threshold)
 LEFT JOIN (SELECT 'quality' AS metric, avg(quality) AS value FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels) v USING (metric)""")
def gates(spark, sf):
    """Stage metrics against their thresholds."""
    labels = table(spark, sf, "labels")
    values = labels.agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic")).unpivot([], ["quality", "toxic"], "metric", "value")
    limits = spark.createDataFrame([("quality", 0.8), ("toxic", 0.5), ("missing", 0.1)], "metric string, threshold double")
    return metrics.gates(values, limits).select("metric", F.round("value", 6).alias("value"), "threshold", "passed")


@query("""SELECT source AS filename_subject, lang AS subject, count(*) AS n FROM documents WHERE source <> 'src' || (length(lang) + doc_id % 20) GROUP BY ALL""")
def disagreements(spark, sf):
    """Labels whose subject is not the one their name tells."""
    docs = table(spark, sf, "documents")
    named = F.concat(F.lit("src"), (F.length("lang") + F.col("doc_id") % 20).cast("string"))
    return docs.where(F.col("source") != named).groupBy(F.col("source").alias("filename_subject"), F.col("lang").alias("subject")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT DISTINCT user_id, event_type AS word FROM events) SELECT x.word AS a, y.word AS b, count(*) AS n FROM w x JOIN w y ON x.user_id = y.user_id AND x.word < y.word GROUP BY ALL""")
def cooccurrence(spark, sf):
    """Pairs of event types that share users."""
    return enrich.cooccurrence(table(spark, sf, "events").select("user_id", F.col("event_type").alias("word")), "user_id")


@query("""SELECT d.doc_id FROM documents d LEFT JOIN documents k ON k.doc_id = d.doc_id AND k.doc_id % 3 = 0 AND NOT (k.doc_id % 2 = 0) WHERE k.doc_id IS NULL""")
def incremental_index(spark, sf):
    """Documents that an index made of every third, half of them changed since, must take in."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 3 = 0").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    known = old.select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return enrich.incremental(docs, known, ["doc_id"]).select("doc_id")
