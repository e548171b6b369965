"""Queries over embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import nearest, retrieve
from lectern.operators.graph import components, merge_components
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


_TOP = """n AS (SELECT q.vec_id AS q_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
 top AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, vec_id) AS rank FROM n)"""


def _neighbours(spark, sf, k=8):
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    from pyspark.sql import Window as W

    near = retrieve.top_k(queries, vectors, k + 1).where("q_id <> vec_id")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("rank") <= k)


@query(f"WITH {_TOP} SELECT q_id, vec_id, round(cosine, 5) AS cosine, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 8")
def cosine_top8(spark, sf):
    """Eight nearest vectors of every fiftieth, against all."""
    return _neighbours(spark, sf).select("q_id", "vec_id", F.round("cosine", 5).alias("cosine"), "rank")


@query(f"""WITH {_TOP}, h AS (SELECT q_id, max(CAST(e.label = q.label AS INTEGER)) AS hit, max(CAST(e.label = q.label AND rank = 1 AS INTEGER)) AS first FROM top JOIN embeddings e USING (vec_id) JOIN embeddings q ON q.vec_id = q_id WHERE rank <= 8 GROUP BY 1)
 SELECT count(*) AS queries, round(avg(hit), 6) AS ceiling, round(avg(first), 6) AS first_rate FROM h""")
def retrieval_ceiling(spark, sf):
    """How often the right label is among the neighbours, and first."""
    vectors = table(spark, sf, "embeddings")
    c = retrieve.retrieval_ceiling(_neighbours(spark, sf), vectors.select(F.col("vec_id").alias("q_id"), "label"), vectors.select("vec_id", "label"))
    return c.select("queries", F.round("ceiling", 6).alias("ceiling"), F.round("first_rate", 6).alias("first_rate"))


_PAIRS = "SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id"


@query(f"SELECT a, b, round(cosine, 5) AS cosine FROM ({_PAIRS}) WHERE cosine > 0.4")
def dedup_pairs(spark, sf):
    """Pairs of similar vectors."""
    return retrieve.similar_pairs(table(spark, sf, "embeddings"), 0.4).withColumn("cosine", F.round("cosine", 5))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM ({_PAIRS}) WHERE cosine > 0.45), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 walk(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT b, seen FROM walk JOIN both_ ON a = node)
 SELECT node AS vec_id, min(seen) AS canonical FROM walk GROUP BY 1""")
def dedup_components(spark, sf):
    """The canonical vector of each group of similar ones."""
    return retrieve.deduplicate(table(spark, sf, "embeddings"), 0.45)


@query(ORACLES["dedup_components"])
def alias_merge(spark, sf):
    """The same groups from two increments: the links of the second half of the vectors are merged into the components of the first."""
    vectors = table(spark, sf, "embeddings")
    first, second = vectors.where("vec_id % 2 = 0"), vectors.where("vec_id % 2 <> 0")
    known = components(retrieve.links(first, 0.45))
    merged, _ = merge_components(known, retrieve.links_to(second, first, 0.45))
    return vectors.select("vec_id").join(merged, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("component", "vec_id").alias("canonical"))


_REPEAT = """q AS (SELECT vec_id AS qid, 'c' || label AS concept_id, CAST(embedding AS DOUBLE[]) AS embedding, 'item ' || CASE WHEN vec_id % 3 = 0 THEN vec_id ELSE vec_id % 40 END || ' of ' || vec_id % 4 AS text FROM embeddings),
 m AS (SELECT n.qid, n.concept_id, max(CASE WHEN b.qid IS NULL THEN 0 WHEN n.text = b.text THEN 4 WHEN list_cosine_similarity(n.embedding, b.embedding) >= 0.45 AND n.text = b.text THEN 3
  WHEN list_cosine_similarity(n.embedding, b.embedding) >= 0.2 THEN 2 ELSE 1 END) AS tier_no
  FROM (SELECT * FROM q WHERE qid % 50 = 0) n LEFT JOIN q b ON n.concept_id = b.concept_id AND n.qid <> b.qid GROUP BY 1, 2)"""


@query(f"WITH {_REPEAT} SELECT qid, concept_id, CAST(tier_no AS INTEGER) AS tier_no FROM m")
def repeat_tiers(spark, sf):
    """How closely new questions repeat earlier ones of their concept."""
    return _repeats(spark, sf).select("qid", "concept_id", "tier_no")


@query(f"""WITH {_REPEAT} SELECT concept_id, count(*) AS questions, round(avg(CAST(tier_no >= 4 AS INTEGER)), 6) AS verbatim, round(avg(CAST(tier_no >= 3 AS INTEGER)), 6) AS exact, round(avg(CAST(tier_no >= 2 AS INTEGER)), 6) AS structural,
 CASE WHEN avg(CAST(tier_no >= 3 AS INTEGER)) >= 0.3 THEN 'reuse' WHEN avg(CAST(tier_no >= 3 AS INTEGER)) >= 0.1 THEN 'mixed' ELSE 'generate' END AS decision FROM m GROUP BY 1""")
def repeat_rate(spark, sf):
    """Rates of repetition by concept, and what they decide."""
    r = retrieve.reuse_rates(_repeats(spark, sf), "concept_id")
    return r.select("concept_id", "questions", *[F.round(c, 6).alias(c) for c in ("verbatim", "exact", "structural")], "decision")


def _repeats(spark, sf):
    number = F.when(F.col("vec_id") % 3 == 0, F.col("vec_id")).otherwise(F.col("vec_id") % 40)
    text = F.concat_ws(" ", F.lit("item"), number.cast("string"), F.lit("of"), (F.col("vec_id") % 4).cast("string"))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("concept_id"), "embedding", text.alias("text"))
    return retrieve.repeats(rows.where("qid % 50 = 0"), rows, 0.2, 0.45)


@query(f"WITH {_TOP} SELECT q_id, vec_id, round(cosine, 5) AS cosine, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 8")
def ivf_exact_top8(spark, sf):
    """Eight nearest vectors of every fiftieth by the inverted file, with every cell that could hold a nearer one."""
    return _indexed(spark, sf, exact=True).select("q_id", "vec_id", F.round("cosine", 5).alias("cosine"), "rank")


@query("SELECT count_if(vec_id % 50 = 0) AS queries, 8 * count_if(vec_id % 50 = 0) AS neighbours, true AS enough FROM embeddings")
def ivf_top8(spark, sf):
    """Whether probing some cells of the inverted file finds nine in ten of the eight nearest, for every fiftieth vector against all."""
    r = nearest.recall(_indexed(spark, sf, exact=False), _neighbours(spark, sf))
    return r.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("enough"))


def _indexed(spark, sf, exact):
    """Neighbours by the index; a query's own row is found too, so one more is asked for."""
    from pyspark.sql import Window as W

    vectors = table(spark, sf, "embeddings")
    index = nearest.build(vectors)
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    near = nearest.search(asked, index, 9, probes=max(1, 3 * len(index.centres) // 4), exact=exact).where("q_id <> vec_id")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("cosine"), "vec_id"))).where("rank <= 8")


_HISTORY = """q AS (SELECT vec_id AS qid, 's' || label % 3 AS subject, 'c' || label AS concept_id, CAST(embedding AS DOUBLE[]) AS embedding, vec_id // 4 % 9 AS week,
  CASE WHEN vec_id % 3 = 0 THEN 'bank' WHEN vec_id % 3 = 1 THEN 'daily' ELSE 'weekly' END AS kind, 'item ' || CASE WHEN vec_id % 7 = 0 THEN vec_id ELSE vec_id % 40 END || ' of ' || vec_id % 4 || CASE WHEN vec_id % 5 = 0 THEN ' again' ELSE '' END AS text FROM embeddings),
 n AS (SELECT q.*, history FROM q, (SELECT unnest(['bank', 'daily', 'weekly']) AS history) WHERE qid % 50 = 0),
 m AS (SELECT n.qid, n.subject, n.history, max(CASE WHEN b.qid IS NULL THEN 0 WHEN n.text = b.text THEN 4 WHEN list_cosine_similarity(n.embedding, b.embedding) >= 0.2 AND regexp_extract_all(n.text, '[0-9]+') = regexp_extract_all(b.text, '[0-9]+') THEN 3
  WHEN list_cosine_similarity(n.embedding, b.embedding) >= 0.1 THEN 2 ELSE 1 END) AS tier_no
  FROM n LEFT JOIN q b ON n.concept_id = b.concept_id AND n.qid <> b.qid AND b.kind = n.history AND (n.history = 'bank' OR n.history = 'daily' AND b.week = n.week OR n.history = 'weekly' AND b.week < n.week) GROUP BY 1, 2, 3)"""


@query(f"""WITH {_HISTORY} SELECT subject, history, count(*) AS questions, round(avg(CAST(tier_no = 4 AS INTEGER)), 6) AS verbatim, round(avg(CAST(tier_no = 3 AS INTEGER)), 6) AS same_numbers,
 round(avg(CAST(tier_no = 2 AS INTEGER)), 6) AS same_structure FROM m GROUP BY 1, 2""")
def repeat_history(spark, sf):
    """How often questions repeat the bank, the dailies of their week and earlier weeklies, by subject."""
    number = F.when(F.col("vec_id") % 7 == 0, F.col("vec_id")).otherwise(F.col("vec_id") % 40)
    more = F.when(F.col("vec_id") % 5 == 0, F.lit(" again")).otherwise(F.lit(""))
    kind = F.element_at(F.array(F.lit("bank"), F.lit("daily"), F.lit("weekly")), (F.col("vec_id") % 3 + 1).cast("int"))
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("qid"), F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("subject"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("concept_id"),
        "embedding", F.expr("cast(vec_id div 4 % 9 as int)").alias("week"), kind.alias("kind"),
        F.concat(F.lit("item "), number.cast("string"), F.lit(" of "), (F.col("vec_id") % 4).cast("string"), more).alias("text"),
    )
    rates = retrieve.history_rates(retrieve.repeat_history(rows, F.col("qid") % 50 == 0, 0.1, 0.2))
    return rates.select("subject", "history", "questions", *[F.round(c, 6).alias(c) for c in ("verbatim", "same_numbers", "same_structure")])


_COS = "round(list_cosine_similarity(x.v, {0}), 9)"


@query(f"""WITH x AS (SELECT vec_id AS qid, label, CAST(embedding AS DOUBLE[]) AS v, vec_id % 17 AS score FROM embeddings),
 a AS (SELECT label, arg_max(v, score * 1000000000 - qid) AS v1, arg_max(qid, score * 1000000000 - qid) AS q1 FROM x GROUP BY 1),
 b AS (SELECT DISTINCT ON (label) label, qid AS q2, x.v AS v2, v1, q1 FROM x JOIN a USING (label) WHERE qid <> q1 ORDER BY label, {_COS.format("v1")}, score DESC, qid),
 c AS (SELECT DISTINCT ON (label) label, qid AS q3, q1, q2 FROM x JOIN b USING (label) WHERE qid NOT IN (q1, q2) ORDER BY label, greatest({_COS.format("v1")}, {_COS.format("v2")}), score DESC, qid)
 SELECT label, CAST(place AS INTEGER) AS place, qid FROM (SELECT label, unnest([1, 2, 3]) AS place, unnest([q1, q2, q3]) AS qid FROM c)""")
def diverse_questions(spark, sf):
    """Three unlike questions of each concept, the best-scored first."""
    from lectern.operators import checks

    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), "label", "embedding", (F.col("vec_id") % 17).alias("score"))
    return checks.diverse(rows, 3, by="label").select("label", "place", "qid")
