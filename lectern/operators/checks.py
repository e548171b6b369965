"""Reports and searches over decoded questions, concept trees, and logs of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import names
from lectern.functions.legacy import is_clean
from lectern.session import discard, materialise


def unknown_topics(files: DataFrame) -> DataFrame:
    """Questions of unknown topic with text; ``files`` has path and questions (topic, text, q_index)."""
    q = files.select("path", F.explode("questions").alias("q")).where((F.col("q.topic") == "Unknown") & (F.trim("q.text") != ""))
    return q.select(
        F.coalesce(names.basename(F.col("path")), F.lit("?")).alias("file"), F.coalesce("q.q_index", F.lit(0)).alias("q_index"), F.substring("q.text", 1, 200).alias("text"),
    )


def glyph_search(questions: DataFrame, glyphs: list[str], n: int = 5) -> DataFrame:
    """At most ``n`` questions per glyph whose raw stem or option math holds it, with its code point."""
    wanted = F.explode(F.array(*[F.lit(g) for g in glyphs])).alias("glyph")
    rows = questions.select("*", wanted).where(F.contains("raw", F.col("glyph")) | F.exists("option_math", lambda m: F.contains(m, F.col("glyph"))))
    first = F.row_number().over(W.partitionBy("glyph").orderBy("qid"))
    point = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("glyph")), 4, "0"))
    return rows.withColumn("place", first).where(F.col("place") <= n).select("glyph", point.alias("code_point"), "qid", "place")


def unmapped_glyphs(decoded: DataFrame, column: str = "decoded") -> DataFrame:
    """Glyphs without a mapping, most frequent first."""
    u = decoded.select(F.explode(F.col(column)["unmapped"]).alias("u"))
    return u.groupBy(F.col("u.glyph").alias("glyph")).agg(F.sum("u.count").alias("n")).orderBy(F.desc("n"), "glyph")


def decode_report(decoded: DataFrame, column: str = "decoded") -> DataFrame:
    clean = is_clean(F.col(column))
    return decoded.agg(F.count("*").alias("questions"), F.count_if(clean).alias("clean"), F.avg(clean.cast("double")).alias("clean_rate"))


def classify_report(labels: DataFrame, review: DataFrame) -> DataFrame:
    """Labelled questions, those for review, and their rate."""
    n = labels.agg(F.count("*").alias("labelled"))
    r = review.agg(F.count("*").alias("needs_review"))
    return n.join(r, F.lit(True)).withColumn("review_rate", F.try_divide("needs_review", "labelled"))


#: Ways in which a wrong option is made of the right one, in the order in which they are tried.
DISTRACTORS = ("same", "negated", "shifted point", "doubled or halved", "next to it", "same digits", "other number", "same words", "other text")


def distractor_pattern(option: Column, answer: Column) -> Column:
    """How ``option`` differs from the ``answer``: by sign, decimal point, factor, a step of one, order of digits or of words, or otherwise."""
    number = lambda c: F.try_to_number(F.when(F.rlike(c, F.lit(r"^[+-]?\d{1,12}(?:\.\d{1,6})?$")), c), F.lit("S999999999999.999999")).cast("double")
    text = lambda c: F.lower(F.trim(c))
    o, a = number(text(option)), number(text(answer))
    power = F.abs(F.log10(F.abs(o / F.nullif(a, F.lit(0.0)))))
    digits = lambda c: F.array_sort(F.regexp_extract_all(text(c), F.lit(r"\d"), F.lit(0)))
    words = lambda c: F.array_sort(F.split(text(c), r"\s+"))
    both = o.isNotNull() & a.isNotNull()
    name = dict(zip(DISTRACTORS, map(F.lit, DISTRACTORS), strict=True))
    return (
        F.when((text(option) == text(answer)) | (both & (o == a)), name["same"]).when(both & (o == -a), name["negated"]).when(both & (o != 0) & (power > 0.5) & (F.abs(power - F.round(power)) < 1e-9), name["shifted point"])
        .when(both & ((o == 2 * a) | (a == 2 * o)), name["doubled or halved"]).when(both & (F.abs(o - a) <= 1), name["next to it"]).when(both & (digits(option) == digits(answer)), name["same digits"])
        .when(both, name["other number"]).when(words(option) == words(answer), name["same words"]).otherwise(name["other text"])
    )


def distractor_patterns(questions: DataFrame, by: str = "subject", top: int = 3) -> DataFrame:
    """by, pattern, n, share and place of the ``top`` most frequent patterns of wrong options.

    ``questions`` has options (letter, text) and correct_letter; questions without it, or without an option of that letter, tell nothing.
    """
    right = F.get(F.filter("options", lambda o: o["letter"] == F.col("correct_letter")), F.lit(0))["text"]
    wrong = questions.withColumn("_answer", right).where("_answer is not null").select(by, "_answer", F.explode(F.filter("options", lambda o: o["letter"] != F.col("correct_letter"))).alias("_o"))
    counted = wrong.groupBy(by, distractor_pattern(F.col("_o.text"), F.col("_answer")).alias("pattern")).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "pattern"))  # as many rows as there are patterns
    return counted.select(by, "pattern", "n", (F.col("n") / F.sum("n").over(W.partitionBy(by))).alias("share"), place.alias("place")).where(F.col("place") <= top)


def house_style(questions: DataFrame, by: str = "subject", accuracy: int = 1000, top: int = 3) -> DataFrame:
    """Stem lengths, numeric ranges, the usual number of options and the usual distractors of a subject's questions.

    Stem lengths are the 10th, 50th and 90th percentile from summaries that merge; their ranks are off by
    at most n / ``accuracy``, and exact for fewer rows than that. ``questions`` has question_text
    and options, and correct_letter for distractors, which are else empty.
    """
    numbers = F.transform(F.regexp_extract_all("question_text", F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    style = questions.withColumn("numbers", numbers).groupBy(by).agg(
        F.percentile_approx(F.length("question_text"), [0.1, 0.5, 0.9], accuracy).alias("stem_length"), F.min(F.array_min("numbers")).alias("least"),
        F.max(F.array_max("numbers")).alias("most"), F.mode(F.size("options"), True).alias("options"),
    )
    if "correct_letter" not in questions.columns:
        return style.withColumn("distractors", F.array().cast("array<string>"))
    usual = distractor_patterns(questions, by, top).groupBy(F.col(by).alias("_by")).agg(F.array_sort(F.collect_list(F.struct("place", "pattern"))).alias("_d"))
    return style.join(usual, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("distractors", F.coalesce(F.col("_d.pattern"), F.array().cast("array<string>"))).drop("_by", "_d")


def _doubled(jump: DataFrame) -> DataFrame:
    """Jumps (concept_id, up) of twice the length; those that would lead beyond a root end."""
    on = jump.select(F.col("concept_id").alias("up"), F.col("up").alias("above"))
    return materialise(jump.join(on, "up").select("concept_id", F.col("above").alias("up")))


def _parents(concepts: DataFrame) -> DataFrame:
    return concepts.where("concept_id is not null and parent is not null").select("concept_id", F.col("parent").alias("up"))


def ancestors(concepts: DataFrame, depth: int | None = None) -> DataFrame:
    """concept_id, ancestor and level for all parents, or those up to ``depth`` levels up.

    By doubling: what is known up to 2^i levels, taken from where a jump of 2^i levels leads, gives what is known up to
    twice that, so joins grow with the logarithm of the depth. Raises where concepts are their
    own ancestors, which a tree rules out.
    """
    jump = materialise(_parents(concepts))
    out, reach, nodes = jump.select("concept_id", F.col("up").alias("ancestor"), F.lit(1).alias("level")), 1, jump.count()
    while not jump.isEmpty() and (depth is None or reach < depth):
        if reach > nodes:
            raise ValueError("a concept is its own ancestor")
        known = out.select(F.col("concept_id").alias("up"), "ancestor", "level")
        further = jump.join(known, "up").select("concept_id", "ancestor", (F.col("level") + reach).alias("level"))
        before, out = out, materialise(out.unionByName(further))
        last, jump, reach = jump, _doubled(jump), 2 * reach
        discard(before, last)
    return out.where(F.col("level") <= depth) if depth is not None else out


def roots(concepts: DataFrame) -> DataFrame:
    """concept_id, root and depth of every concept with a parent, by pointer jumping: a chain of n takes log2(n) joins."""
    jump = materialise(_parents(concepts).withColumn("depth", F.lit(1)))
    nodes, reach = jump.count(), 1
    while True:
        # Who points at a concept that points on takes over its pointer; who points at a root is done.
        on = jump.select(F.col("concept_id").alias("up"), F.col("up").alias("above"), F.col("depth").alias("more"))
        moved = materialise(jump.join(on, "up", "left").select("concept_id", F.coalesce("above", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("open")))
        discard(jump)
        jump, reach = moved, 2 * reach
        if moved.where("open").isEmpty():
            return jump.select("concept_id", F.col("up").alias("root"), "depth")
        if reach > 2 * nodes:
            raise ValueError("a concept is its own ancestor")


def citations(ranked: DataFrame, concepts: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concept_id, chunk_id, book, page_start, page_end) of the source chunks of ranked concepts, and the concepts without any.

    ``concepts`` has concept_id and section_ids; ``chunks`` a section_no.
    """
    wanted = ranked.select("concept_id").distinct()
    sections = concepts.join(wanted, "concept_id").select("concept_id", F.explode("section_ids").alias("section_no")).distinct()
    found = sections.join(chunks.select("section_no", "chunk_id", "book", "page_start", "page_end"), "section_no").drop("section_no")
    return found, wanted.join(found, "concept_id", "left_anti")


def disagreements(labels: DataFrame, files: DataFrame) -> DataFrame:
    """Labels (qid, doc_id, subject) whose subject isn't the one their file's name tells (``files``: doc_id, subject_hint)."""
    told = files.select("doc_id", F.col("subject_hint").alias("filename_subject")).where("filename_subject <> ''")
    return labels.join(told, "doc_id").where("subject <> filename_subject").select("qid", "doc_id", "subject", "filename_subject")


def log_outcomes(outcomes: DataFrame, path: str) -> None:
    """Append a week's outcomes (week, concept_id, n_questions, subject) to the log, once per week and concept."""
    from lectern.sources.files import append_new

    append_new(outcomes, path, ["week", "concept_id"])


def rescore(log: DataFrame, rankings: DataFrame, k: int = 30) -> DataFrame:
    """Metrics of stored rankings (week, concept_id, rank) against the logged outcomes of their weeks."""
    from lectern.operators.metrics import ranking_metrics

    ranked = rankings.select(F.col("week").alias("list_id"), F.col("concept_id").alias("id"), "rank")
    real = log.select(F.col("week").alias("list_id"), F.col("concept_id").alias("id"), F.col("n_questions").cast("double").alias("weight"))
    return ranking_metrics(ranked, real, k, real)


def diverse(questions: DataFrame, k: int, score: str = "score", vector: str = "embedding", by: str | None = None) -> DataFrame:
    """Up to ``k`` unlike questions of each group ``by`` (or of all): the best-scored one, then each time the one farthest from those chosen.

    The farthest is the one whose greatest cosine to the chosen is least (to nine places), ties
    by score and qid. Each round is one aggregation, and only chosen vectors are sent
    along. Questions without vector, or with one of zeros, are never chosen; ``place`` tells the order.
    """
    from lectern.functions.text import cosine

    group = F.col(by) if by else F.lit(0)
    v = F.col(vector).cast("array<double>")
    rows = questions.withColumn("_g", F.struct(group)).where(v.isNotNull() & F.exists(v, lambda x: x != 0))
    better = lambda far: F.max_by("qid", F.struct(far, F.col(score), F.struct(_descending("qid"))))
    chosen = materialise(rows.groupBy("_g").agg(better(F.lit(0.0)).alias("qid")).withColumn("place", F.lit(1)))
    for place in range(2, k + 1):
        held = rows.join(chosen.select("_g", "qid"), ["_g", "qid"], "left_semi").dropDuplicates(["_g", "qid"]).groupBy("_g").agg(F.collect_list(v).alias("_held"))
        left = rows.join(chosen.select("_g", "qid"), ["_g", "qid"], "left_anti").join(held, "_g")
        near = F.array_max(F.transform("_held", lambda c: cosine(c, v)))
        picked = left.groupBy("_g").agg(better(-F.round(near, 9)).alias("qid")).withColumn("place", F.lit(place))
        before, chosen = chosen, materialise(chosen.unionByName(picked))
        discard(before)
    return rows.dropDuplicates(["_g", "qid"]).join(chosen, ["_g", "qid"]).drop("_g")


def _descending(c: str) -> Column:
    """A whole number whose greatest value is that of the smallest id."""
    return -F.col(c).cast("long")
