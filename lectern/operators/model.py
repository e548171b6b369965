"""Leakage-free weekly features and a Beta-Binomial plus log-linear score with attributable terms."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the published model.
KAPPA = 8.0
SHARES = {"book": 0.6, "bank": 0.4}
WEIGHTS = {"syllabus": 2.5, "daily": 0.9, "repeat": -0.5, "gap": 0.3, "diff_set": 0.6, "prereq": 0.4}
GATE = 0.08
SPREAD = 0.25
LOW = 1e-3


def weekly_grid(counts: DataFrame, concepts: DataFrame, weeks: DataFrame) -> DataFrame:
    """concept_id, week, n and y (n > 0) for every concept and week; ``counts`` has concept_id, week, n.

    The weeks are few by nature, so each concept's row is expanded by them in place.
    """
    span = weeks.agg(F.sort_array(F.collect_set("week")).alias("weeks"))
    dense = concepts.select("concept_id").distinct().crossJoin(F.broadcast(span)).select("concept_id", F.explode("weeks").alias("week"))
    total = counts.groupBy("concept_id", "week").agg(F.sum("n").alias("n"))
    return dense.join(total, ["concept_id", "week"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("y", (F.col("n") > 0).cast("int"))


def history(grid: DataFrame) -> DataFrame:
    """Features from strictly earlier weeks: past hits and weeks, last week's hit, gap and history.

    All windows share one partitioning and order, so the grid is shuffled and sorted once.
    """
    order = W.partitionBy("concept_id").orderBy("week")
    past = order.rowsBetween(W.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("y") == 1, F.col("week")), ignorenulls=True).over(past)
    return grid.withColumns({
        "n_hits": F.coalesce(F.sum("y").over(past), F.lit(0)), "n_weeks": F.count("*").over(past),
        "appeared_last": F.coalesce(F.lag("y").over(order), F.lit(0)),
        "weeks_since": F.coalesce(F.col("week") - seen, F.count("*").over(past)).cast("int"),
        "weekly_history": F.collect_list("y").over(past),
    })


def share(rows: DataFrame, by: list[str], value: str = "n") -> Column:
    """Each row's part of its group's total, as a window column."""
    return F.col(value) / F.sum(value).over(W.partitionBy(*by))


def book_weight(sections: DataFrame) -> DataFrame:
    """Half the share of pages and half that of exercises within the subject, per concept."""
    total = W.partitionBy("subject")
    by = sections.groupBy("subject", "concept_id").agg(F.sum("pages").alias("pages"), F.sum("exercises").alias("exercises"))
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(total)), F.lit(0.0))
    return by.withColumn("book_weight", 0.5 * part("pages") + 0.5 * part("exercises"))


def bridge_score(mentions: DataFrame) -> DataFrame:
    """How far over the chapters a concept spreads: (chapters - 1) / (all chapters - 1), per book."""
    total = mentions.groupBy("book").agg(F.count_distinct("chapter").alias("total"))
    own = mentions.groupBy("book", "concept_id").agg(F.count_distinct("chapter").alias("chapters"))
    return own.join(total, "book").withColumn("bridge_score", (F.col("chapters") - 1) / F.greatest(F.col("total") - 1, F.lit(1)))


def prior_mean(book: Column, bank: Column, subject: Column, expected: Column) -> Column:
    """A subject's mixed shares times its expected number of distinct concepts, kept off 0 and 1."""
    mixed = SHARES["book"] * F.coalesce(book, F.lit(0.0)) + SHARES["bank"] * F.coalesce(bank, F.lit(0.0))
    whole = F.sum(mixed).over(W.partitionBy(subject))
    return F.least(F.greatest(F.coalesce(F.try_divide(mixed, whole), F.lit(0.0)) * expected, F.lit(LOW)), F.lit(1 - LOW))


def posterior(prior: Column, hits: Column, weeks: Column, kappa: float = KAPPA) -> Column:
    return (prior * kappa + hits) / (F.lit(kappa) + weeks)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(LOW)), F.lit(1 - LOW))
    return F.ln(q / (1 - q))


def _terms(names) -> dict[str, Column]:
    """The values that the weights of terms multiply, in that order, without nulls."""
    value = {"gap": F.log1p("weeks_since"), "recency": 1 / (1 + F.col("weeks_since"))}
    return {t: F.coalesce((value[t] if t in value else F.col(t)).cast("double"), F.lit(0.0)) for t in names}


def score(features: DataFrame, weights: Mapping[str, float | Column] | None = None, gate: float = GATE) -> DataFrame:
    """features with contributions (which sum to the logit), p_ungated, gate_factor and probability.

    ``weights`` are numbers, or columns where rows differ in them; their names are the terms, by default those of TERMS.

    ``features`` has posterior, syllabus, daily, repeat, weeks_since, diff_set, prereq and
    syllabus_known. The gate multiplies the probability where the syllabus is known and
    lacks the concept, so it is no term of the logit.
    """
    w = weights or WEIGHTS
    terms = {"posterior": logit(F.col("posterior"))} | {k: (w[k] if isinstance(w[k], Column) else F.lit(float(w[k]))) * v for k, v in _terms(w).items()}
    total = sum(terms.values(), F.lit(0.0))
    shut = F.col("syllabus_known") & (F.coalesce(F.col("syllabus").cast("double"), F.lit(0.0)) == 0)
    return (
        features.withColumn("contributions", F.create_map(*[x for k, v in terms.items() for x in (F.lit(k), v)]))
        .withColumn("logit", total).withColumn("p_ungated", 1 / (1 + F.exp(-F.col("logit"))))
        .withColumn("gate_factor", F.when(shut, F.lit(gate)).otherwise(F.lit(1.0)))
        .withColumn("probability", F.col("p_ungated") * F.col("gate_factor"))
    )


def rank(scored: DataFrame, by: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Ranked by probability, ties by concept_id; the best ``top`` of each group if given."""
    order = W.partitionBy(*(by or [])).orderBy(F.desc("probability"), "concept_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top) if top else ranked


def expected_count(p: Column, questions: Column, distinct: Column) -> Column:
    return p * questions / F.nullif(distinct, F.lit(0))


TERMS = ("syllabus", "daily", "repeat", "gap", "diff_set", "prereq")
#: The terms of the revised model: also daily_frequency, recency (1 / (1 + weeks_since)) and bridge_score. They have no published weights, only fitted ones.
REVISED = (*TERMS, "daily_frequency", "recency", "bridge_score")
#: Newton steps of a fit, and the most that a weight moves in one.
STEPS, MOST_STEP = 6, 2.0
#: Products worked on at once: rows times folds.
_CELLS = 1 << 20


def _moments(rows: DataFrame, terms, coefficients: np.ndarray, held_out: list, balance: np.ndarray) -> np.ndarray:
    """For each fold, over the rows of other weeks: gradient and second moments of its weighted log-likelihood.

    One pass over the rows serves all folds; what is shuffled is a matrix for each task and fold.
    """
    folds, size = coefficients.shape
    weeks = np.array([np.iinfo(np.int64).min if w is None else w for w in held_out], dtype=np.int64)

    def run(batches):
        total = np.zeros((folds, size + size * size))
        step = max(1, _CELLS // folds)
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            x, offset, y, week = np.column_stack([column(t) for t in terms]), column("offset"), column("label"), column("week")
            for a in range(0, len(x), step):
                own, label = x[a : a + step], y[a : a + step, None]
                p = 1 / (1 + np.exp(-np.clip(offset[a : a + step, None] + own @ coefficients.T, -500, 500)))
                w = np.where(label == 1, balance[:, 1], balance[:, 0]) * (week[a : a + step, None] != weeks)
                pairs = (own[:, :, None] * own[:, None, :]).reshape(len(own), -1)
                total += np.hstack([(w * (label - p)).T @ own, (w * p * (1 - p)).T @ pairs])
        fold, at = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(fold.ravel()), pa.array(at.ravel()), pa.array(total.ravel())], names=["fold", "at", "value"])

    out = np.zeros((folds, size + size * size))
    for r in rows.mapInArrow(run, "fold long, at long, value double").groupBy("fold", "at").agg(F.sum("value").alias("value")).collect():
        out[r["fold"], r["at"]] = r["value"]
    return out


def fit_folds(training: DataFrame, reg: float = 0.1, steps: int = STEPS, terms: tuple[str, ...] = TERMS) -> dict[int | None, tuple[dict[str, float], bool]]:
    """By held-out week, and for None over all weeks: the weights of the terms, and whether they were fitted.

    Ridge logistic regression with the posterior's logit as offset and no intercept: Newton
    steps from zero on the mean log-likelihood, in which rarer labels weigh more, less
    reg / 2 times the squared weights; a step in which a weight would move by more than
    MOST_STEP is shortened. Each step is one aggregation for all folds, and the driver solves
    one small system a week. Where a fold's labels are all alike the published weights stand (0 for terms without).

    ``training`` has week, the columns of score() and label; rows without label are left out,
    and rows without week are never held out.
    """
    rows = training.where("label is not null").select(
        F.coalesce(F.col("week").cast("long"), F.lit(-(1 << 62))).alias("week"), *[v.alias(t) for t, v in _terms(terms).items()],
        F.coalesce(logit(F.col("posterior")), F.lit(0.0)).alias("offset"), F.col("label").cast("double").alias("label"),
    )
    found = {r["week"]: (r["n"], r["one"]) for r in rows.groupBy("week").agg(F.count("*").alias("n"), F.sum("label").alias("one")).collect()}
    weeks = [None, *sorted(w for w in found if w > -(1 << 62))]
    n = np.array([sum(v[0] for w, v in found.items() if w != week) for week in weeks], dtype=float)
    one = np.array([sum(v[1] for w, v in found.items() if w != week) for week in weeks], dtype=float)
    fitted = (one > 0) & (one < n)
    with np.errstate(divide="ignore", invalid="ignore"):
        balance = np.where(fitted[:, None], np.column_stack([n / (2 * (n - one)), n / (2 * one)]), 0.0)
    beta = np.zeros((len(weeks), len(terms)))
    for _ in range(steps if fitted.any() else 0):
        m = _moments(rows, terms, beta, weeks, balance) / np.maximum(n, 1)[:, None]
        gradient = m[:, : len(terms)] - reg * beta
        curve = m[:, len(terms) :].reshape(len(weeks), len(terms), -1) + reg * np.eye(len(terms))
        move = np.linalg.solve(curve, gradient[..., None])[..., 0]
        beta += move * np.minimum(1, MOST_STEP / np.maximum(np.abs(move).max(axis=1, keepdims=True), 1e-300))
    made = lambda b: {t: round(float(x), 9) for t, x in zip(terms, b, strict=True)}
    return {w: (made(b), True) if f else ({t: WEIGHTS.get(t, 0.0) for t in terms}, False) for w, b, f in zip(weeks, beta, fitted, strict=True)}


def fit(training: DataFrame, reg: float = 0.1) -> dict[str, float]:
    """Weights of the terms over all rows of ``training``, as of fit_folds()."""
    rows = training if "week" in training.columns else training.withColumn("week", F.lit(None).cast("int"))
    return fit_folds(rows, reg)[None][0]


def backtest(features: DataFrame, actual: DataFrame, k: int = 30, reg: float = 0.1, steps: int = STEPS) -> tuple[DataFrame, dict[str, float], list[str]]:
    """Leave-one-week-out metrics at k of each week, the weights to use, and warnings.

    Each week is scored by the weights fitted on the others, which go to its rows by a map of one
    entry a week. A spread of recall above SPREAD, or fewer than two weeks, falls back to the published weights.
    """
    from lectern.operators.metrics import ranking_metrics

    fitted = fit_folds(features, reg, steps)
    weeks = [w for w in fitted if w is not None]
    of = lambda t: F.create_map(*[F.lit(x) for w in weeks for x in (w, fitted[w][0][t])])[F.col("week").cast("long")] if weeks else F.lit(WEIGHTS[t])
    scored = score(features.where("week is not null"), {t: of(t) for t in TERMS}).withColumn("probability", F.round("probability", 9))
    ranked = rank(scored, ["week"]).select(F.col("week").alias("list_id"), F.col("concept_id").alias("id"), "rank")
    real = actual.join(features.select("week").distinct(), "week", "left_semi").select(F.col("week").alias("list_id"), F.col("concept_id").alias("id"))
    folds = ranking_metrics(ranked, real, k).withColumnRenamed("list_id", "week")
    spread = folds.agg(F.max("recall") - F.min("recall"), F.count("*")).first()
    warnings = []
    if len(TERMS) > features.count() / 2:
        warnings.append("more features than half the observations")
    if (spread[0] or 0.0) > SPREAD or spread[1] < 2:
        warnings.append("unfitted: folds disagree, published weights are used")
        return folds, dict(WEIGHTS), warnings
    return folds, fitted[None][0], warnings


def calibrate(scores: DataFrame, least_weeks: int = 8):
    """An isotonic model of y on p where there are enough weeks, else None."""
    from pyspark.ml.regression import IsotonicRegression

    if scores.select("week").distinct().count() < least_weeks:
        return None
    return IsotonicRegression(featuresCol="p", labelCol="y").fit(scores.select(F.col("p").cast("double"), F.col("y").cast("double"), F.lit(1.0).alias("weight")))


def form_diversity(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct question forms seen of each concept."""
    return labels.groupBy(*(by or ["concept_id"])).agg(F.count_distinct("question_form").alias("form_diversity"))


def assemble_features(
    hist: DataFrame, bank: DataFrame, daily: DataFrame, diff_sets: DataFrame, syllabus: DataFrame, prerequisites: DataFrame, labels: DataFrame
) -> DataFrame:
    """One row per concept and week with all signals of the model, without nulls.

    ``hist`` is history() with subject; ``bank`` has concept_id and n; ``daily`` subject,
    week, concept_id and n; ``diff_sets`` week and concept_id; ``syllabus`` week and
    concept_id (a week without rows is unknown); ``prerequisites`` concept_id and needs;
    ``labels`` concept_id and question_form. A prerequisite is covered once its concept was
    hit in an earlier week; concepts without prerequisites are covered.
    """
    key = ["concept_id", "week"]
    flag = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(1))
    told = daily.groupBy("subject", "week", "concept_id").agg(F.sum("n").alias("n"))
    shares = told.withColumn("daily", share(told, ["subject", "week"])).select(*key, "daily")
    per_bank = bank.groupBy("concept_id").agg(F.sum("n").alias("bank_frequency"))
    seen = hist.where("y = 1").groupBy("concept_id").agg(F.min("week").alias("first_week"))
    needs = prerequisites.select("concept_id", "needs").distinct().join(seen.select(F.col("concept_id").alias("needs"), "first_week"), "needs", "left")
    ready = needs.groupBy("concept_id").agg(F.max(F.coalesce("first_week", F.lit((1 << 31) - 1))).alias("ready"))
    known = syllabus.select("week").distinct().withColumn("syllabus_known", F.lit(True))
    joined = (
        hist.join(per_bank, "concept_id", "left").join(shares, key, "left").join(flag(diff_sets, "diff_set"), key, "left")
        .join(flag(syllabus, "syllabus"), key, "left").join(known, "week", "left").join(ready, "concept_id", "left")
        .join(form_diversity(labels), "concept_id", "left")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        *key, "subject", "y", "n_hits", "n_weeks", F.col("appeared_last").alias("repeat"), "weeks_since", zero("bank_frequency"),
        F.coalesce("daily", F.lit(0.0)).alias("daily"), zero("diff_set"), zero("syllabus"), F.coalesce("syllabus_known", F.lit(False)).alias("syllabus_known"),
        (F.coalesce("ready", F.lit(-1)) < F.col("week")).cast("int").alias("prereq"), zero("form_diversity"),
    )


#: Folds that are looked through in place; among more their place is searched.
MAX_FOLDS = 1000


def history_sizes(rows: DataFrame, folds: DataFrame, ts: str = "captured_at", concept: str = "concept_id") -> DataFrame:
    """fold, rows_before and concepts: what each fold may learn from, as rows strictly older than its held-out time.

    Rows and first sights of concepts are counted by the first fold that may see them, and
    those counts are summed up over the folds in order, so no row is repeated per fold. The
    tasks and the driver know the folds' times, 8 bytes each. Folds with nothing before them get no row.
    """
    times = sorted({r[0] for r in folds.select(F.unix_micros(F.col("held_out_at").cast("timestamp"))).distinct().collect() if r[0] is not None})
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    if len(times) <= MAX_FOLDS:
        slot = lambda c: F.size(F.filter(F.lit(times).cast("array<bigint>"), lambda t: t <= micros(c)))
    else:
        place = F.pandas_udf(lambda us: pd.Series(np.searchsorted(np.array(times), us.to_numpy(), side="right").astype(np.int32)), "int")
        slot = lambda c: place(micros(c))
    n = rows.where(F.col(ts).isNotNull()).groupBy(slot(F.col(ts)).alias("slot")).agg(F.count("*").alias("r"))
    first = rows.where(F.col(ts).isNotNull() & F.col(concept).isNotNull()).groupBy(concept).agg(F.min(ts).alias("at"))
    c = first.groupBy(slot(F.col("at")).alias("slot")).agg(F.count("*").alias("c"))
    counted = n.join(c, "slot", "left").select("slot", "r", F.coalesce("c", F.lit(0)).alias("c"), F.lit(None).cast(folds.schema["fold"].dataType).alias("fold"))
    asked = folds.where("held_out_at is not null").select((slot(F.col("held_out_at")) - 1).alias("slot"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"), "fold")
    upto = W.orderBy("slot").rangeBetween(W.unboundedPreceding, 0)  # two rows a fold at most
    summed = counted.unionByName(asked).select("fold", F.sum("r").over(upto).alias("rows_before"), F.sum("c").over(upto).alias("concepts"))
    return summed.where("fold is not null and rows_before > 0")


def before(rows: DataFrame, folds: DataFrame, ts: str = "captured_at") -> DataFrame:
    """Rows strictly older than each fold's held-out time; ``folds`` (fold, held_out_at) is a handful of rows.

    Every row is repeated for each fold that may see it; history_sizes() counts without that.
    """
    return rows.join(F.broadcast(folds), F.col(ts) < F.col("held_out_at"))
