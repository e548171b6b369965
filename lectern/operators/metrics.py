"""Ranking and probability metrics over long tables.

Rankings have (list_id, id, rank): a list's places from 1, where repeated ids use up
places and count once, at their first. Actuals have (list_id, id). Every list that has a
ranking or actuals gets a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CURVE = (10, 20, 30, 50)
HEADLINE = 30


def _joined(ranked: DataFrame, actual: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    first = ranked.groupBy("list_id", "id").agg(F.min("rank").alias("rank"))
    real = actual.select("list_id", "id").distinct().withColumn("y", F.lit(1))
    if weights is not None:
        real = real.join(weights.groupBy("list_id", "id").agg(F.max("weight").alias("weight")), ["list_id", "id"], "left")
    else:
        real = real.withColumn("weight", F.lit(1.0))
    return first.join(real, ["list_id", "id"], "full_outer").withColumn("weight", F.when(F.col("y") == 1, F.coalesce("weight", F.lit(1.0))))


def ranking_metrics(ranked: DataFrame, actual: DataFrame, k: int = HEADLINE, weights: DataFrame | None = None) -> DataFrame:
    """list_id, recall, precision, weighted_recall and mrr at k. One shuffle on the lists' ids."""
    hit = (F.col("y") == 1) & (F.col("rank") <= k)
    n = F.count("y")
    return _joined(ranked, actual, weights).groupBy("list_id").agg(
        F.coalesce(F.try_divide(F.count_if(hit), n), F.lit(0.0)).alias("recall"),
        (F.count_if(hit) / F.lit(k) if k else F.lit(0.0)).cast("double").alias("precision"),
        F.coalesce(F.try_divide(F.sum(F.when(hit, F.col("weight"))), F.sum("weight")), F.lit(0.0)).alias("weighted_recall"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("y") == 1, F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))), n), F.lit(0.0)).alias("mrr"),
    )


def recall_curve(ranked: DataFrame, actual: DataFrame, ks=CURVE) -> DataFrame:
    """list_id, k and recall at each k, from one pass."""
    n = F.count("y")
    at = [F.coalesce(F.try_divide(F.count_if((F.col("y") == 1) & (F.col("rank") <= k)), n), F.lit(0.0)) for k in ks]
    both = F.array(*[F.struct(F.lit(k).alias("k"), r.alias("recall")) for k, r in zip(ks, at, strict=True)])
    return _joined(ranked, actual).groupBy("list_id").agg(both.alias("curve")).select("list_id", F.inline("curve"))


def brier(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    """Mean squared error over predicted and actual ids.

    ``predictions`` has list_id, id, p and pos: of repeated ids the last place holds.
    """
    p = predictions.groupBy("list_id", "id").agg(F.max_by("p", "pos").alias("p"))
    y = actual.select("list_id", "id").distinct().withColumn("y", F.lit(1.0))
    err = F.coalesce("p", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
    return p.join(y, ["list_id", "id"], "full_outer").groupBy("list_id").agg(F.avg(err * err).alias("brier"))


def calibration(scores: DataFrame, width: float = 0.2) -> DataFrame:
    """Buckets of predicted probability with the observed rate; the last one takes 1.0 in."""
    bucket = F.least(F.floor(F.col("p") / width), F.lit(int(round(1 / width)) - 1)).cast("int")
    return scores.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg(F.col("y").cast("double")).alias("observed"))


def fold_stats(values: DataFrame, value: str) -> DataFrame:
    return values.agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_pop(value).alias("std"))


def by_subject(rows: DataFrame, value: str) -> DataFrame:
    """The mean of each subject, and of all (null subject)."""
    return rows.rollup("subject").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def metric_rollup(rows: DataFrame, by: str = "list_id", subject: str = "subject", k: int = HEADLINE) -> DataFrame:
    """All metrics of each list by subject and, with a null subject, of the whole list, from one aggregation.

    ``rows`` has a row for each id that is ranked or real: its list and subject, rank (null if
    not ranked), y (1 if real), weight, p, and correct (null if not labelled). Every metric is a
    quotient of counts and sums, so subjects add up to lists. Ranks are those of the whole list; a
    subject without name is one of its own, told from the whole by ``whole``.
    """
    real, ranked = F.coalesce(F.col("y"), F.lit(0)) == 1, F.col("rank").isNotNull()
    hit, err = real & (F.col("rank") <= k), F.coalesce("p", F.lit(0.0)) - F.coalesce(F.col("y").cast("double"), F.lit(0.0))
    weight = F.when(real, F.coalesce("weight", F.lit(1.0)))
    sums = {
        "ids": F.count("*"), "real": F.count_if(real), "hits": F.count_if(hit), "top": F.count_if(ranked & (F.col("rank") <= k)), "hit_weight": F.coalesce(F.sum(F.when(hit, weight)), F.lit(0.0)),
        "all_weight": F.sum(weight), "reciprocal": F.sum(F.when(real & ranked, 1.0 / F.col("rank"))), "squares": F.sum(err * err),
        "labelled": F.count("correct"), "right": F.count_if(F.col("correct")),
    }
    per = rows.groupingSets([[F.col(by), F.col(subject)], [F.col(by)]], F.col(by), F.col(subject)).agg(F.grouping(subject).cast("boolean").alias("whole"), *[v.alias(c) for c, v in sums.items()])
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return per.select(
        by, subject, "whole", "ids", "real", part("hits", "real").alias("recall"), part("hits", "top").alias("precision"), part("hit_weight", "all_weight").alias("weighted_recall"),
        part("reciprocal", "real").alias("mrr"), (F.col("squares") / F.col("ids")).alias("brier"), F.try_divide("right", "labelled").alias("accuracy"),
    )


def label_accuracy(predicted: DataFrame, truth: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Subject, concept and parent accuracy of labels joined on qid; ``parents`` has concept_id and parent."""
    t = truth.select("qid", F.col("subject").alias("t_subject"), F.col("concept_id").alias("t_concept"))
    both = predicted.join(t, "qid")
    if parents is not None:
        up = parents.select("concept_id", "parent")
        both = both.join(up, "concept_id", "left").join(up.select(F.col("concept_id").alias("t_concept"), F.col("parent").alias("t_parent")), "t_concept", "left")
    else:
        both = both.withColumn("parent", F.lit(None).cast("string")).withColumn("t_parent", F.lit(None).cast("string"))
    mean = lambda c: F.avg(c.cast("double"))
    same_parent = F.coalesce(F.col("parent"), F.col("concept_id")) == F.coalesce(F.col("t_parent"), F.col("t_concept"))
    return both.agg(
        F.count("*").alias("n"), mean(F.col("subject") == F.col("t_subject")).alias("subject_accuracy"),
        mean(F.col("concept_id") == F.col("t_concept")).alias("concept_accuracy"), mean(same_parent).alias("parent_accuracy"),
    )


def needs_review(labels: DataFrame, least: int = 60) -> DataFrame:
    """Labels with low confidence or a concept that was no candidate."""
    return labels.where((F.col("confidence") < least) | ~F.coalesce(F.array_contains("concept_candidates", F.col("concept_id")), F.lit(False)))


def gates(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metric, value, threshold and passed; a metric without a value fails."""
    return thresholds.join(values, "metric", "left").withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def scorecard(week: int, recall: dict[int, float], weighted_recall: float, brier_score: float, mrr: float, stages: dict | None = None, warnings: list | None = None) -> dict:
    """Rounded figures of one target week."""
    return {
        "target_week": week, "concept_recall": {f"@{k}": round(recall[k], 4) for k in sorted(recall)}, "weighted_recall@30": round(weighted_recall, 4),
        "brier": round(brier_score, 4), "mrr": round(mrr, 4), "stage_metrics": dict(stages or {}), "warnings": list(warnings or []),
    }


def scorecard_text(card: dict) -> str:
    """The scorecard for people, with the headline marked."""
    rows = [(f"concept_recall{k}", v, "   <- HEADLINE" if k == f"@{HEADLINE}" else "") for k, v in card["concept_recall"].items()]
    rows += [("weighted_recall@30", card["weighted_recall@30"], ""), ("brier", card["brier"], ""), ("MRR", card["mrr"], "")]
    parts = [f"SCORECARD -- target week {card['target_week']}", "", "PREDICTION", *(f"  {n:<20} {v:.4f}{mark}" for n, v, mark in rows)]
    if card["stage_metrics"]:
        parts += ["", "STAGE HEALTH", *(f"  {n:<30} {v}" for n, v in card["stage_metrics"].items())]
    if card["warnings"]:
        parts += ["", "WARNINGS", *(f"  ! {w}" for w in card["warnings"])]
    return "\n".join(parts)


def selftest() -> dict:
    """A scorecard without data, which shows that the harness runs."""
    return scorecard(0, dict.fromkeys(CURVE, 0.0), 0.0, 0.0, 0.0, warnings=["selftest: no data loaded"])


def question_hits(ranked: DataFrame, real: DataFrame, generated: DataFrame, k: int = HEADLINE) -> DataFrame:
    """list_id, questions, hits and question_hit: real questions that a generated one of a concept ranked in the top k matches.

    ``ranked`` has list_id, id and rank; ``real`` list_id and qid; ``generated`` list_id, id
    (its concept), qid (the real question compared with) and match.
    """
    top = ranked.where(F.col("rank") <= k).select("list_id", "id").distinct()
    matched = generated.where("match").join(top, ["list_id", "id"], "left_semi").select("list_id", "qid").distinct().withColumn("hit", F.lit(1))
    questions = real.select("list_id", "qid").distinct().join(matched, ["list_id", "qid"], "left")
    return questions.groupBy("list_id").agg(F.count("*").alias("questions"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("question_hit"))


def solvability_pass(generated: DataFrame) -> DataFrame:
    """Generated questions, and the share that an independent solver answers as stated."""
    agrees = F.coalesce(F.col("solvable") & (F.col("solver_answer") == F.col("stated_answer")), F.lit(False))
    return generated.agg(F.count("*").alias("generated"), F.avg(agrees.cast("double")).alias("solvability_pass"))


def decoding_metrics(questions: DataFrame) -> DataFrame:
    """decode_clean_rate, decode_cer, math_conversion_rate and option_completeness.

    ``questions`` has clean, decoded, reference (null where nobody transcribed it), math_ok,
    math_total and options (letter, text).
    """
    from lectern.functions.text import cer

    full = F.size(F.filter("options", lambda o: F.trim(o["text"]) != "")) == 4
    return questions.agg(
        F.avg(F.col("clean").cast("double")).alias("decode_clean_rate"), F.avg(cer(F.col("decoded"), F.col("reference"))).alias("decode_cer"),
        F.try_divide(F.sum("math_ok"), F.sum("math_total")).alias("math_conversion_rate"), F.avg(full.cast("double")).alias("option_completeness"),
    )


def leakage_checklist(features: DataFrame, bank: DataFrame, daily: DataFrame, taxonomy: DataFrame, prompts: DataFrame, held_out: DataFrame) -> DataFrame:
    """rule, and the number of rows that break it, for each rule of a held-out exam.

    ``held_out`` has qid and week; ``features`` qid, week (target) and last_week_used; ``bank`` source;
    ``daily`` source, week and target_week; ``taxonomy`` source; ``prompts`` key_parts (names
    of what the cache key is made of).
    """
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("broken"))
    rules = [
        count(features.join(held_out.select("qid").distinct(), "qid", "left_semi"), "held-out questions in the features"),
        count(bank.where("source is null or source <> 'bank'"), "bank frequency from more than the bank"),
        count(daily.where("source is null or source <> 'daily' or week is null or week <> target_week"), "daily signal from more than the week's dailies"),
        count(features.where("last_week_used is not null and last_week_used <> week - 1"), "last week isn't the one before the target"),
        count(taxonomy.where("source is null or source <> 'books'"), "taxonomy from more than books"),
        count(prompts.where(~F.coalesce(F.array_contains("key_parts", "week"), F.lit(False))), "cache keys without the week"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def leaks(features: DataFrame, labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """rule and the number of rows that break it: nothing may use the target week or later."""
    count = lambda df, name: df.agg(F.lit(name).alias("rule"), F.count("*").alias("rows"))
    return (
        count(features.where("last_week_used >= target_week"), "features use the target week")
        .union(count(labels.where("week >= target_week"), "labels come from the target week"))
        .union(count(taxonomy.where("source <> 'books'"), "taxonomy is not from books"))
    )
