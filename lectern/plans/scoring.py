"""Queries over the assembled features, further metrics and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import checks, metrics, model
from lectern.plans import history
from lectern.session import table
from lectern.sources import completions

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_EV = "ev AS (SELECT event_type || '.' || user_id AS concept_id, event_type AS subject, user_id AS u, event_id, " + history._WEEK + " AS week FROM events)"


@query("SELECT event_type AS concept_id, count(DISTINCT event_id % 9) AS form_diversity FROM events GROUP BY 1")
def form_diversity(spark, sf):
    """Distinct forms of each concept's questions."""
    return model.form_diversity(table(spark, sf, "events").select(F.col("event_type").alias("concept_id"), (F.col("event_id") % 9).alias("question_form")))


@query(f"""WITH {history._GRID}, full_ AS (SELECT *, event_type || '.' || user_id AS concept_id, {history._WEEK} AS week FROM events),
 daily AS (SELECT concept_id, week, round(n / sum(n) OVER (PARTITION BY subject, week), 6) AS daily FROM (SELECT subject, week, concept_id, count(*) AS n FROM ev GROUP BY ALL)),
 bank AS (SELECT concept_id, count(*) AS bank_frequency, count(DISTINCT event_id % 9) AS form_diversity FROM full_ GROUP BY 1),
 diff AS (SELECT DISTINCT concept_id, week FROM full_ WHERE event_id % 3 = 0), syl AS (SELECT DISTINCT concept_id, week FROM full_ WHERE week < 3 AND event_id % 2 = 0), kn AS (SELECT DISTINCT week FROM syl),
 pre AS (SELECT DISTINCT concept_id, event_type || '.' || (user_id + 1) AS needs FROM full_ WHERE user_id % 2 = 0),
 first_ AS (SELECT concept_id AS needs, min(week) AS first_week FROM grid WHERE y = 1 GROUP BY 1), ready AS (SELECT concept_id, max(coalesce(first_week, 2147483647)) AS ready FROM pre LEFT JOIN first_ USING (needs) GROUP BY 1)
 SELECT concept_id, week, split_part(concept_id, '.', 1) AS subject, y, CAST(n_hits AS BIGINT) AS n_hits, n_weeks, appeared_last AS repeat, CAST(weeks_since AS INTEGER) AS weeks_since, bank_frequency, coalesce(daily, 0.0) AS daily,
 CAST(d.concept_id IS NOT NULL AS INTEGER) AS diff_set, CAST(s.concept_id IS NOT NULL AS INTEGER) AS syllabus, kn.week IS NOT NULL AS syllabus_known, CAST(coalesce(ready, -1) < h.week AS INTEGER) AS prereq, form_diversity
 FROM hist h JOIN bank USING (concept_id) LEFT JOIN daily USING (concept_id, week) LEFT JOIN diff d USING (concept_id, week) LEFT JOIN syl s USING (concept_id, week) LEFT JOIN kn USING (week) LEFT JOIN ready USING (concept_id)""")
def feature_table(spark, sf):
    """All signals of every concept and week, joined from their sources."""
    rows = history.concept_events(spark, sf)
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type").join(rows.select("event_id", "concept_id", "week", "subject"), "event_id")
    hist = model.history(history.grid(spark, sf)).withColumn("subject", F.substring_index("concept_id", ".", 1))
    counts = ev.groupBy("concept_id", "subject", "week").agg(F.count("*").alias("n"))
    needs = F.concat_ws(".", "event_type", (F.col("user_id") + 1).cast("string"))
    made = model.assemble_features(
        hist, counts.select("concept_id", "n"), counts, ev.where("event_id % 3 = 0"), ev.where("week < 3 and event_id % 2 = 0"),
        ev.where("user_id % 2 = 0").select("concept_id", needs.alias("needs")), ev.select("concept_id", (F.col("event_id") % 9).alias("question_form")),
    )
    return made.withColumn("daily", F.round("daily", 6))


@query(f"WITH {history._FEATURES} SELECT concept_id, week, round(probability * 20 / 8, 6) AS expected FROM final")
def expected_counts(spark, sf):
    """Expected number of questions of each concept."""
    scored = model.score(history.features(spark, sf))
    return scored.select("concept_id", "week", F.round(model.expected_count(F.col("probability"), F.lit(20), F.lit(8)), 6).alias("expected"))


@query("""SELECT 1 AS list_id, count(*) AS questions, CAST(count_if(item_id % 10 < 4 AND item_id % 3 = 0) AS BIGINT) AS hits, round(avg(CAST(item_id % 10 < 4 AND item_id % 3 = 0 AS INTEGER)), 6) AS question_hit FROM benchmark""")
def question_hits(spark, sf):
    """Real questions that a generated one of a top concept matches."""
    items = table(spark, sf, "benchmark")
    concept = (F.col("item_id") % 10).alias("id")
    ranked = spark.range(10).select(F.lit(1).alias("list_id"), "id", (F.col("id") + 1).alias("rank"))
    real = items.select(F.lit(1).alias("list_id"), F.col("item_id").alias("qid"))
    generated = items.select(F.lit(1).alias("list_id"), concept, F.col("item_id").alias("qid"), (F.col("item_id") % 3 == 0).alias("match"))
    return metrics.question_hits(ranked, real, generated.unionByName(generated), 4).withColumn("question_hit", F.round("question_hit", 6))


_SOLVED = "(SELECT doc_id % 4 <> 0 AS solvable, doc_id % 5 AS a, doc_id % 3 AS b FROM documents)"


def _solved(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 4 != 0).alias("solvable"), (F.col("doc_id") % 5).alias("solver_answer"), (F.col("doc_id") % 3).alias("stated_answer"))


@query(f"SELECT count(*) AS generated, round(avg(CAST(solvable AND a = b AS INTEGER)), 6) AS solvability_pass FROM {_SOLVED}")
def solvability(spark, sf):
    """How often a solver answers generated questions as stated."""
    return metrics.solvability_pass(_solved(spark, sf)).withColumn("solvability_pass", F.round("solvability_pass", 6))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 5 = doc_id % 3")
def solvable_questions(spark, sf):
    """Generated questions that a solver answers as stated."""
    return completions.solvable(_solved(spark, sf)).select("doc_id")


@query("""SELECT round(avg(CAST(item_id % 4 <> 0 AS INTEGER)), 6) AS decode_clean_rate, round(avg(CASE WHEN item_id % 2 = 0 THEN 2 / length(t) END), 6) AS decode_cer, round(sum(item_id % 3) / sum(3), 6) AS math_conversion_rate,
 round(avg(CAST(item_id % 5 <> 0 AS INTEGER)), 6) AS option_completeness FROM (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') || 'zz' AS t FROM benchmark)""")
def stage_metrics(spark, sf):
    """Health of decoding: clean texts, errors of characters, formulas, options."""
    text = F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", ""), F.lit("zz"))
    option = lambda c: F.struct(F.lit("A").alias("letter"), c.alias("text"))
    last = F.when(F.col("item_id") % 5 == 0, " ").otherwise("d")
    q = table(spark, sf, "benchmark").select(
        (F.col("item_id") % 4 != 0).alias("clean"), F.expr("substring(concat(regexp_replace(text, '[^\\\\x00-\\\\x7F]', ''), 'zz'), 1, length(regexp_replace(text, '[^\\\\x00-\\\\x7F]', '')))").alias("decoded"),
        F.when(F.col("item_id") % 2 == 0, text).alias("reference"), (F.col("item_id") % 3).alias("math_ok"), F.lit(3).alias("math_total"),
        F.array(*[option(F.lit(x)) for x in "abc"], option(last)).alias("options"),
    )
    m = metrics.decoding_metrics(q)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(f"""WITH {_EV}, f AS (SELECT event_id AS qid, week, week - 1 - CAST(event_id % 50 = 0 AS INTEGER) AS last_week_used FROM ev), held AS (SELECT event_id AS qid FROM ev WHERE event_id % 97 = 0)
 SELECT * FROM (SELECT 'held-out questions in the features' AS rule, count(*) AS broken FROM f WHERE qid IN (SELECT qid FROM held) UNION ALL SELECT 'bank frequency from more than the bank', count(*) FROM ev WHERE event_id % 11 = 0
 UNION ALL SELECT 'daily signal from more than the week''s dailies', count(*) FROM ev WHERE event_id % 13 = 0 UNION ALL SELECT 'last week isn''t the one before the target', count(*) FROM ev WHERE event_id % 50 = 0
 UNION ALL SELECT 'taxonomy from more than books', 0 UNION ALL SELECT 'cache keys without the week', count(*) FROM ev WHERE event_id % 17 = 0)""")
def leakage_checklist(spark, sf):
    """Rows that break each rule of a held-out exam."""
    rows = history.concept_events(spark, sf)
    qid, every = F.col("event_id").alias("qid"), lambda n: F.col("event_id") % n == 0
    last = F.col("week") - 1 - every(50).cast("int")
    prompts = rows.select(F.when(every(17), F.array(F.lit("model"))).otherwise(F.array(F.lit("model"), F.lit("week"))).alias("key_parts"))
    return metrics.leakage_checklist(
        rows.select(qid, "week", last.alias("last_week_used")), rows.select(F.when(every(11), "weekly").otherwise("bank").alias("source")),
        rows.select(F.lit("daily").alias("source"), "week", (F.col("week") + every(13).cast("int")).alias("target_week")), rows.select(F.lit("books").alias("source")).limit(1),
        prompts, rows.where(every(97)).select(qid, "week"),
    )


@query(f"""WITH {_EV} SELECT 'features use the target week' AS rule, count(*) AS rows FROM ev WHERE event_id % 5 = 0 UNION ALL SELECT 'labels come from the target week', count(*) FROM ev WHERE week >= 3 UNION ALL SELECT 'taxonomy is not from books', count(*) FROM ev WHERE event_id % 7 = 0""")
def leaks(spark, sf):
    """Rows that use the target week or later."""
    rows = history.concept_events(spark, sf)
    last = F.when(F.col("event_id") % 5 == 0, F.col("week")).otherwise(F.col("week") - 1)
    return metrics.leaks(
        rows.select(last.alias("last_week_used"), F.col("week").alias("target_week")), rows.select("week", F.lit(3).alias("target_week")),
        rows.select(F.when(F.col("event_id") % 7 == 0, "exams").otherwise("books").alias("source")),
    )


@query(f"""WITH {_EV}, a AS (SELECT week, count(DISTINCT concept_id) AS n FROM ev GROUP BY 1)
 SELECT week AS target_week, ranking, round(CASE ranking WHEN 'none' THEN 0 ELSE least(30, n) / n END, 6) AS recall, round(CASE ranking WHEN 'none' THEN 0 ELSE least(30, n) / 30 END, 6) AS precision,
 round(CASE ranking WHEN 'none' THEN 0 ELSE list_sum(list_transform(range(1, n + 1), lambda i: 1.0 / i)) / n END, 6) AS mrr FROM a, (SELECT unnest(['none', 'ideal']) AS ranking)""")
def selftest(spark, sf):
    """The harness on each week's outcomes: all zeros for an empty ranking, what is possible at most for the ideal one."""
    counts = history.concept_events(spark, sf).groupBy("week", "concept_id").agg(F.count("*").alias("n"))
    actual = counts.select(F.col("week").alias("list_id"), F.col("concept_id").alias("id"))
    ideal = counts.select(F.col("week").alias("list_id"), F.col("concept_id").alias("id"), F.row_number().over(W.partitionBy("week").orderBy(F.desc("n"), "concept_id")).alias("rank"))
    made = [metrics.ranking_metrics(ranked, actual).withColumn("ranking", F.lit(name)) for name, ranked in (("none", ideal.where("rank < 0")), ("ideal", ideal))]
    return made[0].unionByName(made[1]).select(F.col("list_id").alias("target_week"), "ranking", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr")])


@query("""SELECT doc_id AS concept_id, count(*) AS chunks, min(c) AS first_chunk FROM (SELECT doc_id, unnest([doc_id % 7, doc_id % 11]) AS s FROM documents), (SELECT item_id % 4 AS section, item_id AS c FROM benchmark) WHERE s = section AND doc_id % 7 <> doc_id % 11 GROUP BY 1
 UNION ALL SELECT doc_id, count(*), min(item_id) FROM documents JOIN benchmark ON doc_id % 7 = item_id % 4 WHERE doc_id % 7 = doc_id % 11 GROUP BY 1""")
def citations(spark, sf):
    """Source chunks behind ranked concepts."""
    return _cited(spark, sf)[0].groupBy("concept_id").agg(F.count("*").alias("chunks"), F.min(F.col("chunk_id").cast("long")).alias("first_chunk"))


@query("""SELECT doc_id AS concept_id FROM documents WHERE doc_id % 7 NOT IN (SELECT item_id % 4 FROM benchmark) AND doc_id % 11 NOT IN (SELECT item_id % 4 FROM benchmark)""")
def ungrounded_concepts(spark, sf):
    """Ranked concepts without any source."""
    return _cited(spark, sf)[1]


def _cited(spark, sf):
    docs = table(spark, sf, "documents")
    concepts = docs.select(F.col("doc_id").alias("concept_id"), F.array((F.col("doc_id") % 7).cast("string"), (F.col("doc_id") % 11).cast("string")).alias("section_ids"))
    made = table(spark, sf, "benchmark").select((F.col("item_id") % 4).cast("string").alias("section_no"), F.col("item_id").cast("string").alias("chunk_id"), F.lit("b").alias("book"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    return checks.citations(concepts, concepts, made)


@query("""SELECT doc_id AS qid, doc_id, lang AS subject, CASE WHEN doc_id % 3 = 0 THEN 'de' ELSE 'en' END AS filename_subject FROM documents WHERE doc_id % 4 <> 0 AND lang <> CASE WHEN doc_id % 3 = 0 THEN 'de' ELSE 'en' END""")
def subject_disagreements(spark, sf):
    """Labels whose subject isn't the one their file's name tells."""
    docs = table(spark, sf, "documents")
    hint = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 3 == 0, "de").otherwise("en")
    return checks.disagreements(docs.select(F.col("doc_id").alias("qid"), "doc_id", F.col("lang").alias("subject")), docs.select("doc_id", hint.alias("subject_hint")))


@query(f"""WITH {_EV}, a AS (SELECT week AS list_id, concept_id AS id, CAST(count(*) AS DOUBLE) AS weight FROM ev GROUP BY 1, 2), r AS (SELECT DISTINCT week AS list_id, concept_id AS id, row_number() OVER (PARTITION BY week ORDER BY concept_id) AS rank FROM (SELECT DISTINCT week, concept_id FROM ev WHERE u % 2 = 0)),
 j AS (SELECT a.list_id, a.id, weight, rank FROM a LEFT JOIN r USING (list_id, id))
 SELECT list_id AS week, round(count_if(rank <= 30) / count(*), 6) AS recall, round(coalesce(sum(CASE WHEN rank <= 30 THEN weight END), 0) / sum(weight), 6) AS weighted_recall, round(sum(coalesce(1.0 / rank, 0)) / count(*), 6) AS mrr FROM j GROUP BY 1""")
def rescored(spark, sf):
    """Stored rankings against outcomes that came later."""
    from pyspark.sql import Window as W

    rows = history.concept_events(spark, sf)
    log = rows.groupBy("week", "concept_id").agg(F.count("*").alias("n_questions"))
    even = log.where(F.substring_index("concept_id", ".", -1).cast("long") % 2 == 0)
    ranked = even.select("week", "concept_id", F.row_number().over(W.partitionBy("week").orderBy("concept_id")).alias("rank"))
    m = checks.rescore(log, ranked, 30)
    return m.select(F.col("list_id").alias("week"), *[F.round(c, 6).alias(c) for c in ("recall", "weighted_recall", "mrr")])


@query("""SELECT count(*) AS labelled, CAST(count_if(doc_id % 6 = 0) AS BIGINT) AS needs_review, round(avg(CAST(doc_id % 6 = 0 AS INTEGER)), 6) AS review_rate FROM documents""")
def classify_report(spark, sf):
    """Labels and those that need a review."""
    docs = table(spark, sf, "documents").select("doc_id")
    return checks.classify_report(docs, docs.where("doc_id % 6 = 0")).withColumn("review_rate", F.round("review_rate", 6))


@query(f"""WITH {history._FEATURES}, g AS (SELECT round(probability, 1) AS p, sum(y) AS s, count(*) AS n FROM final GROUP BY 1),
 span AS (SELECT lo.p AS lo, hi.p AS hi, sum(m.s) / sum(m.n) AS mean FROM g lo JOIN g hi ON hi.p >= lo.p JOIN g m ON m.p BETWEEN lo.p AND hi.p GROUP BY 1, 2)
 SELECT p, round(max(least_), 6) AS calibrated FROM (SELECT g.p, lo, min(mean) AS least_ FROM g JOIN span ON lo <= g.p AND hi >= g.p GROUP BY 1, 2) GROUP BY p""")
def isotonic(spark, sf):
    """Probabilities calibrated by the monotonous step function nearest to what came."""
    scores = model.score(history.features(spark, sf)).select("week", F.round("probability", 1).alias("p"), "y")
    steps = model.calibrate(scores, 1).transform(scores.select("p").distinct())
    return steps.select("p", F.round("prediction", 6).alias("calibrated"))


@query(f"""WITH {history._RECALL}, b AS (SELECT week, avg((probability - y) * (probability - y)) AS brier FROM final GROUP BY week),
 l AS (SELECT week, unnest(['concept_recall@10', 'concept_recall@20', 'concept_recall@30', 'concept_recall@50', 'weighted_recall@30', 'brier', 'MRR']) AS name,
  unnest([h10 / actual, h20 / actual, hits / actual, h50 / actual, coalesce(hit_weight, 0) / weight, brier, rr / actual]) AS value FROM r JOIN b USING (week) WHERE week = 2)
 SELECT '  ' || rpad(name, 20, ' ') || ' ' || format('{{:.4f}}', round(value, 4)) || CASE name WHEN 'concept_recall@30' THEN '   <- HEADLINE' ELSE '' END AS line FROM l
 UNION ALL SELECT unnest(['SCORECARD -- target week 2', 'PREDICTION', 'STAGE HEALTH', '  retrieval_ceiling              0.9', 'WARNINGS', '  ! few weeks'])""")
def scorecard_lines(spark, sf):
    """The lines of the scorecard of one week."""
    ranked, actual = history._ranked(spark, sf)
    ranked, actual = ranked.where("list_id = 2"), actual.where("list_id = 2")
    m = metrics.ranking_metrics(ranked.select("list_id", "id", "rank"), actual, 30, actual).first()
    curve = {r["k"]: r["recall"] for r in metrics.recall_curve(ranked.select("list_id", "id", "rank"), actual).collect()}
    b = metrics.brier(ranked.select("list_id", "id", "p", F.col("rank").alias("pos")), actual).first()
    card = metrics.scorecard(2, curve, m["weighted_recall"], b["brier"], m["mrr"], {"retrieval_ceiling": 0.9}, ["few weeks"])
    lines = [(x,) for x in metrics.scorecard_text(card).split("\n") if x]
    return spark.createDataFrame(lines, "line string")
