"""Queries over events as concept counts per week, and the scoring model, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import metrics, model
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


_WEEK = "CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 604800) AS INTEGER)"
_GRID = f"""ev AS (SELECT event_type || '.' || user_id AS concept_id, event_type AS subject, {_WEEK} AS week FROM events),
 grid AS (SELECT c.concept_id, w.week, count(e.week) AS n, CAST(count(e.week) > 0 AS INTEGER) AS y FROM (SELECT DISTINCT concept_id FROM ev) c CROSS JOIN (SELECT DISTINCT week FROM ev) w
  LEFT JOIN ev e ON e.concept_id = c.concept_id AND e.week = w.week GROUP BY 1, 2),
 hist AS (SELECT *, coalesce(sum(y) OVER p, 0) AS n_hits, count(*) OVER p AS n_weeks, coalesce(lag(y) OVER o, 0) AS appeared_last,
  coalesce(week - max(CASE WHEN y = 1 THEN week END) OVER p, count(*) OVER p) AS weeks_since,
  coalesce(string_agg(CAST(y AS VARCHAR), '') OVER p, '') AS weekly_history FROM grid
  WINDOW o AS (PARTITION BY concept_id ORDER BY week), p AS (PARTITION BY concept_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def concept_events(spark, sf):
    """Events as mentions of concepts: type and user name the concept, weeks count from 2024-01-01."""
    week = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 604800).cast("int")
    return table(spark, sf, "events").select(F.concat_ws(".", "event_type", F.col("user_id").cast("string")).alias("concept_id"), F.col("event_type").alias("subject"), week.alias("week"), "value", "event_id")


def grid(spark, sf):
    rows = concept_events(spark, sf)
    counts = rows.groupBy("concept_id", "week").agg(F.count("*").alias("n"))
    return model.weekly_grid(counts, counts.select("concept_id"), counts.select("week"))


@query(f"WITH {_GRID} SELECT concept_id, week, n, y FROM grid")
def weekly_grid(spark, sf):
    """Dense concept by week counts."""
    return grid(spark, sf)


@query(f"WITH {_GRID} SELECT concept_id, week, y, CAST(n_hits AS BIGINT) AS n_hits, n_weeks, appeared_last, CAST(weeks_since AS INTEGER) AS weeks_since, weekly_history FROM hist")
def history_features(spark, sf):
    """Features of strictly earlier weeks."""
    h = model.history(grid(spark, sf))
    digits = F.array_join(F.transform("weekly_history", lambda x: x.cast("string")), "")
    return h.select("concept_id", "week", "y", "n_hits", "n_weeks", "appeared_last", "weeks_since", digits.alias("weekly_history"))


@query("""WITH m AS (SELECT event_type AS book, CAST(user_id AS VARCHAR) AS concept_id, event_id % 12 AS chapter FROM events),
 t AS (SELECT book, count(DISTINCT chapter) AS total FROM m GROUP BY 1), c AS (SELECT book, concept_id, count(DISTINCT chapter) AS chapters FROM m GROUP BY 1, 2)
 SELECT book, concept_id, chapters, total, round((chapters - 1) / greatest(total - 1, 1), 6) AS bridge_score FROM c JOIN t USING (book)""")
def bridge_score(spark, sf):
    """How far concepts spread over chapters."""
    m = table(spark, sf, "events").select(F.col("event_type").alias("book"), F.col("user_id").cast("string").alias("concept_id"), (F.col("event_id") % 12).alias("chapter"))
    return model.bridge_score(m).withColumn("bridge_score", F.round("bridge_score", 6))


@query("""SELECT subject, concept_id, pages, exercises, round(0.5 * coalesce(pages / nullif(sum(pages) OVER s, 0), 0) + 0.5 * coalesce(exercises / nullif(sum(exercises) OVER s, 0), 0), 6) AS book_weight FROM
 (SELECT lang AS subject, source AS concept_id, count(*) AS pages, CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS exercises FROM documents GROUP BY 1, 2) WINDOW s AS (PARTITION BY subject)""")
def book_weight(spark, sf):
    """Weights of concepts from page and exercise shares."""
    sections = table(spark, sf, "documents").select(F.col("lang").alias("subject"), F.col("source").alias("concept_id"), F.lit(1).alias("pages"), F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("exercises"))
    return model.book_weight(sections).withColumn("book_weight", F.round("book_weight", 6))


@query(f"""WITH {_GRID}, tot AS (SELECT subject, week, count(*) AS n FROM ev GROUP BY 1, 2), c AS (SELECT subject, week, concept_id, count(*) AS n FROM ev GROUP BY 1, 2, 3)
 SELECT subject, week, concept_id, c.n, round(c.n / tot.n, 6) AS share FROM c JOIN tot USING (subject, week)""")
def daily_signal(spark, sf):
    """Each concept's share of its subject's mentions in a week."""
    counts = concept_events(spark, sf).groupBy("subject", "week", "concept_id").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(model.share(counts, ["subject", "week"]), 6))


_FEATURES = f"""{_GRID}, base AS (SELECT h.*, split_part(concept_id, '.', 1) AS subject, TRY_CAST(split_part(concept_id, '.', 2) AS BIGINT) AS u FROM hist h),
 bank AS (SELECT concept_id, count(*) AS bank FROM ev GROUP BY 1),
 mixed AS (SELECT b.*, 0.6 * (u % 7 + 1) + 0.4 * bank AS mix FROM base b JOIN bank USING (concept_id)),
 prior AS (SELECT *, least(greatest(mix / sum(mix) OVER (PARTITION BY subject, week) * 10.0, 0.001), 0.999) AS prior FROM mixed),
 post AS (SELECT *, (prior * 8.0 + n_hits) / (8.0 + n_weeks) AS posterior FROM prior),
 lg AS (SELECT *, ln(least(greatest(posterior, 0.001), 0.999) / (1 - least(greatest(posterior, 0.001), 0.999))) AS base_logit FROM post),
 terms AS (SELECT *, 2.5 * (u % 5 <> 0)::INT AS t_syllabus, 0.9 * (u % 3) AS t_daily, -0.5 * appeared_last AS t_repeat, 0.3 * ln(1 + weeks_since) AS t_gap, 0.6 * (u % 2) AS t_diff, 0.4 * (u % 4 = 0)::INT AS t_prereq FROM lg),
 scored AS (SELECT *, base_logit + t_syllabus + t_daily + t_repeat + t_gap + t_diff + t_prereq AS logit, CASE WHEN u % 5 = 0 AND u % 2 = 0 THEN 0.08 ELSE 1.0 END AS gate_factor FROM terms),
 final AS (SELECT *, 1 / (1 + exp(-logit)) AS p_ungated, 1 / (1 + exp(-logit)) * gate_factor AS probability FROM scored),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY probability DESC, concept_id) AS rank FROM final)"""


def features(spark, sf):
    """A full feature table per concept and week, side signals made of the user's number."""
    rows = concept_events(spark, sf)
    bank = rows.groupBy("concept_id").agg(F.count("*").alias("bank"))
    u = F.element_at(F.split("concept_id", r"\."), 2).cast("long")
    h = model.history(grid(spark, sf)).join(bank, "concept_id").withColumn("u", u).withColumn("subject", F.substring_index("concept_id", ".", 1))
    subject_week = F.struct("subject", "week")
    prior = model.prior_mean((F.col("u") % 7 + 1).cast("double"), F.col("bank").cast("double"), subject_week, F.lit(10.0))
    return h.withColumn("prior", prior).withColumns({
        "posterior": model.posterior(F.col("prior"), F.col("n_hits"), F.col("n_weeks")), "syllabus": (F.col("u") % 5 != 0).cast("int"), "daily": F.col("u") % 3,
        "repeat": F.col("appeared_last"), "diff_set": F.col("u") % 2, "prereq": (F.col("u") % 4 == 0).cast("int"), "syllabus_known": F.col("u") % 2 == 0, "label": F.col("y"),
    })


@query(f"WITH {_FEATURES} SELECT concept_id, week, round(prior, 6) AS prior, round(posterior, 6) AS posterior FROM post")
def beta_posterior(spark, sf):
    """Prior and posterior mean of the base rate."""
    return features(spark, sf).select("concept_id", "week", F.round("prior", 6).alias("prior"), F.round("posterior", 6).alias("posterior"))


@query(f"""WITH {_FEATURES} SELECT concept_id, week, round(logit, 6) AS logit, round(p_ungated, 6) AS p_ungated, gate_factor, round(probability, 6) AS probability, CAST(rank AS INTEGER) AS rank
 FROM ranked WHERE rank <= 30""")
def ranked_concepts(spark, sf):
    """The thirty likeliest concepts of each week, gated by the syllabus."""
    top = model.rank(model.score(features(spark, sf)), ["week"], 30)
    r = lambda c: F.round(c, 6).alias(c)
    return top.select("concept_id", "week", r("logit"), r("p_ungated"), F.col("gate_factor").cast("double"), r("probability"), "rank")


@query(f"""WITH {_FEATURES} SELECT concept_id, week, term, round(value, 6) AS value FROM (
 SELECT concept_id, week, unnest(['posterior', 'syllabus', 'daily', 'repeat', 'gap', 'diff_set', 'prereq']) AS term, unnest([base_logit, t_syllabus, t_daily, t_repeat, t_gap, t_diff, t_prereq]) AS value FROM terms)""")
def contributions(spark, sf):
    """Every term of every score, in long form."""
    return model.score(features(spark, sf)).select("concept_id", "week", F.explode("contributions").alias("term", "value")).withColumn("value", F.round("value", 6))


@query(f"""WITH {_FEATURES} SELECT CAST(least(floor(probability / 0.2), 4) AS INTEGER) AS bucket, count(*) AS n, round(avg(probability), 6) AS predicted, round(avg(y), 6) AS observed FROM final GROUP BY 1""")
def calibration(spark, sf):
    """Predicted against observed rates in five buckets."""
    c = metrics.calibration(model.score(features(spark, sf)).select(F.col("probability").alias("p"), "y"))
    return c.select("bucket", "n", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"))


_RECALL = f"""{_FEATURES}, r AS (SELECT week, count_if(y = 1 AND rank <= 30) AS hits, count_if(y = 1) AS actual, sum(CASE WHEN y = 1 AND rank <= 30 THEN n END) AS hit_weight, sum(CASE WHEN y = 1 THEN n END) AS weight,
 sum(CASE WHEN y = 1 THEN 1.0 / rank ELSE 0 END) AS rr, count_if(y = 1 AND rank <= 10) AS h10, count_if(y = 1 AND rank <= 20) AS h20, count_if(y = 1 AND rank <= 50) AS h50 FROM ranked GROUP BY week)"""


def _ranked(spark, sf):
    scored = model.rank(model.score(features(spark, sf)), ["week"])
    ranked = scored.select(F.col("week").alias("list_id"), F.col("concept_id").alias("id"), "rank", F.col("probability").alias("p"), "y", "n")
    actual = ranked.where("y = 1").select("list_id", "id", F.col("n").cast("double").alias("weight"))
    return ranked, actual


@query(f"""WITH {_RECALL} SELECT week, round(hits / actual, 6) AS recall, round(hits / 30, 6) AS precision, round(coalesce(hit_weight, 0) / weight, 6) AS weighted_recall, round(rr / actual, 6) AS mrr FROM r""")
def ranking_metrics(spark, sf):
    """Recall, precision, weighted recall and reciprocal rank of each week's ranking."""
    ranked, actual = _ranked(spark, sf)
    m = metrics.ranking_metrics(ranked.select("list_id", "id", "rank"), actual, 30, actual)
    return m.select(F.col("list_id").alias("week"), *[F.round(c, 6).alias(c) for c in ("recall", "precision", "weighted_recall", "mrr")])


@query(f"""WITH {_RECALL} SELECT week, k, round(h / actual, 6) AS recall FROM (SELECT week, actual, unnest([10, 20, 30, 50]) AS k, unnest([h10, h20, hits, h50]) AS h FROM r)""")
def recall_curve(spark, sf):
    """Recall at several depths."""
    ranked, actual = _ranked(spark, sf)
    return metrics.recall_curve(ranked.select("list_id", "id", "rank"), actual).select(F.col("list_id").alias("week"), "k", F.round("recall", 6).alias("recall"))


@query(f"WITH {_FEATURES} SELECT week, round(avg((probability - y) * (probability - y)), 6) AS brier FROM final GROUP BY week")
def brier(spark, sf):
    """Mean squared error of each week's probabilities."""
    ranked, actual = _ranked(spark, sf)
    b = metrics.brier(ranked.select("list_id", "id", "p", F.col("rank").alias("pos")), actual)
    return b.select(F.col("list_id").alias("week"), F.round("brier", 6).alias("brier"))


@query(f"WITH {_RECALL} SELECT round(avg(hits / actual), 6) AS mean, round(min(hits / actual), 6) AS low, round(max(hits / actual), 6) AS high, round(stddev_pop(hits / actual), 6) AS std FROM r")
def fold_stats(spark, sf):
    """Mean, range and spread of recall over weeks."""
    ranked, actual = _ranked(spark, sf)
    m = metrics.fold_stats(metrics.ranking_metrics(ranked.select("list_id", "id", "rank"), actual, 30), "recall")
    return m.select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "std")])


@query(f"WITH {_FEATURES} SELECT subject, count(*) AS n, round(avg(probability), 6) AS mean FROM final GROUP BY ROLLUP (subject)")
def subject_split(spark, sf):
    """Mean probability of each subject and of all."""
    return metrics.by_subject(model.score(features(spark, sf)), "probability").withColumn("mean", F.round("mean", 6))


_TERMS = ("(u % 5 <> 0)::INT", "u % 3", "appeared_last", "ln(1 + weeks_since)", "u % 2", "(u % 4 = 0)::INT")


def _fit_sql(steps: int, terms: tuple[str, ...] = _TERMS, reg: float = 0.1) -> str:
    """Newton steps of the offset model in plain SQL: fold -1 leaves no week out, fold w leaves out week w."""
    last = len(terms)
    n = range(1, last + 1)
    x = ", ".join(f"{v} AS x{i}" for i, v in zip(n, terms, strict=True))
    out = [
        f"x AS MATERIALIZED (SELECT week, concept_id, y, n AS times, u, base_logit AS off, {x} FROM lg)",
        "cnt AS MATERIALIZED (SELECT fold, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS one FROM x JOIN (SELECT DISTINCT week AS fold FROM x UNION ALL SELECT -1) ON week <> fold GROUP BY 1)",
        "tr AS MATERIALIZED (SELECT fold, n, x.* EXCLUDE (u), CASE WHEN y = 1 THEN n / (2 * one) ELSE n / (2 * (n - one)) END AS w FROM x JOIN cnt ON week <> fold)",
        f"b0 AS (SELECT fold, {', '.join(f'0.0 AS b{i}' for i in n)} FROM cnt)",
    ]
    bs = ", ".join(f"b{i}" for i in n)
    for t in range(1, steps + 1):
        z = " + ".join(f"b{i} * x{i}" for i in n)
        g = ", ".join(f"sum(w * (y - p) * x{i}) / n - {reg} * b{i} AS g{i}" for i in n)
        h = ", ".join(f"sum(w * p * (1 - p) * x{i} * x{j}) / n + {reg if i == j else 0} AS h{i}{j}" for i in n for j in n if i <= j)
        q = f"SELECT fold, {bs}, {g}, {h} FROM (SELECT tr.*, {bs}, 1 / (1 + exp(-(off + {z}))) AS p FROM tr JOIN b{t - 1} USING (fold)) GROUP BY fold, n, {bs}"
        for k in range(1, last):  # elimination; the matrix is symmetric, so its upper half is kept
            at = lambda i, j: f"h{min(i, j)}{max(i, j)}"
            rest = range(k + 1, last + 1)
            cut = [f"{at(i, j)} - {at(k, i)} * {at(k, j)} / h{k}{k} AS {at(i, j)}" for i in rest for j in rest if i <= j] + [f"g{i} - {at(k, i)} * g{k} / h{k}{k} AS g{i}" for i in rest]
            q = f"SELECT * REPLACE ({', '.join(cut)}) FROM ({q})"
        for i in range(last, 0, -1):  # and back
            q = f"SELECT *, (g{i}{''.join(f' - h{i}{j} * d{j}' for j in range(i + 1, last + 1))}) / h{i}{i} AS d{i} FROM ({q})"
        most = f"greatest({', '.join(f'abs(d{i})' for i in n)}, 1e-300)"
        out.append(f"b{t} AS MATERIALIZED (SELECT fold, {', '.join(f'b{i} + d{i} * least(1, 2.0 / {most}) AS b{i}' for i in n)} FROM ({q}))")
    return ", ".join(out)


_FIT = f"{_FEATURES}, {_fit_sql(model.STEPS)}"


@query(f"""WITH {_FIT} SELECT CAST(fold AS INTEGER) AS fold, term, round(value, 4) AS value FROM (SELECT fold, unnest(['syllabus', 'daily', 'repeat', 'gap', 'diff_set', 'prereq']) AS term, unnest([b1, b2, b3, b4, b5, b6]) AS value FROM b{model.STEPS})""")
def offset_fit(spark, sf):
    """Weights of the terms fitted on all weeks (fold -1) and with each week left out."""
    fitted = model.fit_folds(features(spark, sf))
    rows = [(-1 if week is None else week, term, value) for week, (weights, _) in fitted.items() for term, value in weights.items()]
    return spark.createDataFrame(rows, "fold int, term string, value double").withColumn("value", F.round("value", 4))


@query(f"""WITH {_FEATURES}, {_fit_sql(model.STEPS, (*_TERMS, "u % 4 * 0.5", "1 / (1 + weeks_since)", "u % 7 / 6"))} SELECT CAST(fold AS INTEGER) AS fold, term, round(value, 4) AS value
 FROM (SELECT fold, unnest([{', '.join(f"'{t}'" for t in model.REVISED)}]) AS term, unnest([b1, b2, b3, b4, b5, b6, b7, b8, b9]) AS value FROM b{model.STEPS})""")
def revised_fit(spark, sf):
    """Fitted weights of the revised model's terms."""
    rows = features(spark, sf).withColumns({"daily_frequency": F.col("u") % 4 * 0.5, "bridge_score": F.col("u") % 7 / 6})
    fitted = model.fit_folds(rows, terms=model.REVISED)
    made = [(-1 if week is None else week, term, value) for week, (weights, _) in fitted.items() for term, value in weights.items()]
    return spark.createDataFrame(made, "fold int, term string, value double").withColumn("value", F.round("value", 4))


@query(f"""WITH {_FIT}, pr AS (SELECT x.*, round(1 / (1 + exp(-(off + b1 * x1 + b2 * x2 + b3 * x3 + b4 * x4 + b5 * x5 + b6 * x6))) * CASE WHEN u % 5 = 0 AND u % 2 = 0 THEN 0.08 ELSE 1.0 END, 9) AS p FROM x JOIN b{model.STEPS} ON fold = week),
 rk AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY p DESC, concept_id) AS rank FROM pr),
 r AS (SELECT week, count_if(y = 1 AND rank <= 30) / count_if(y = 1) AS recall, count_if(y = 1 AND rank <= 30) / 30 AS precision, sum(CASE WHEN y = 1 THEN 1.0 / rank ELSE 0 END) / count_if(y = 1) AS mrr FROM rk GROUP BY 1)
 SELECT week, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr, (SELECT max(recall) - min(recall) > 0.25 OR count(*) < 2 FROM r) AS published FROM r""")
def backtest_weeks(spark, sf):
    """Each week ranked by weights fitted on the others, and whether the folds disagree so that published weights are used."""
    rows = features(spark, sf)
    folds, weights, _ = model.backtest(rows, rows.where("label = 1").select("week", "concept_id"))
    r = lambda c: F.round(c, 6).alias(c)
    return folds.select("week", r("recall"), r("precision"), r("mrr"), F.lit(weights == model.WEIGHTS).alias("published"))


@query(f"""WITH {_FEATURES} SELECT week, subject, grouping(subject) = 1 AS whole, count(*) AS ids, CAST(count_if(y = 1) AS BIGINT) AS real, round(coalesce(count_if(y = 1 AND rank <= 30) / nullif(count_if(y = 1), 0), 0), 6) AS recall,
 round(coalesce(count_if(y = 1 AND rank <= 30) / nullif(count_if(rank <= 30), 0), 0), 6) AS precision, round(coalesce(sum(CASE WHEN y = 1 AND rank <= 30 THEN n END) / sum(CASE WHEN y = 1 THEN n END), 0), 6) AS weighted_recall,
 round(coalesce(sum(CASE WHEN y = 1 THEN 1.0 / rank END) / nullif(count_if(y = 1), 0), 0), 6) AS mrr, round(avg((probability - y) * (probability - y)), 6) AS brier, round(avg(CAST((probability >= 0.5) = (y = 1) AS INTEGER)), 6) AS accuracy
 FROM ranked GROUP BY GROUPING SETS ((week, subject), (week))""")
def metric_rollup(spark, sf):
    """All metrics of each week, by subject and overall."""
    scored = model.rank(model.score(features(spark, sf)), ["week"])
    rows = scored.select("week", "subject", "rank", "y", F.col("n").cast("double").alias("weight"), F.col("probability").alias("p"), ((F.col("probability") >= 0.5) == (F.col("y") == 1)).alias("correct"))
    m = metrics.metric_rollup(rows, "week")
    return m.select("week", "subject", "whole", "ids", "real", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "weighted_recall", "mrr", "brier", "accuracy")])


@query(f"""WITH ev AS (SELECT event_type || '.' || user_id AS concept_id, {_WEEK} AS week, ts FROM events), folds AS (SELECT week AS fold, min(ts) AS held_out_at FROM ev GROUP BY 1)
 SELECT fold, count(*) AS rows_before, count(DISTINCT concept_id) AS concepts FROM ev JOIN folds ON ts < held_out_at GROUP BY 1""")
def strict_history(spark, sf):
    """What each fold may learn from: rows older than its first event."""
    ev = concept_events(spark, sf).join(table(spark, sf, "events").select("event_id", F.col("ts").alias("captured_at")), "event_id")
    folds = ev.groupBy(F.col("week").alias("fold")).agg(F.min("captured_at").alias("held_out_at"))
    return model.history_sizes(ev, folds)
