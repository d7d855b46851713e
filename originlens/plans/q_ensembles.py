"""Ensembles of the three closed-form scores: weights from ``val`` rows, results on ``test`` rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from originlens.functions.hashing import uniform
from originlens.functions.vectors import l2_normalize
from originlens.operators import ensembles, metrics, models, neighbors
from originlens.operators.leakage import scored_queries
from originlens.plans import duck, views
from originlens.plans.registry import query
from originlens.plans.views import SCORE_MODELS, rounded
from originlens.session import materialise

_V = f"""WITH {duck.SCORES}, val AS (SELECT * FROM scores WHERE split = 'val'),
test AS (SELECT * FROM scores WHERE split = 'test')"""
_WEIGHTS = f"""{_V}, {duck.auc('val')},
raw AS (SELECT model, roc_auc, greatest(roc_auc - 0.5, 0.01) AS w FROM auc),
weights AS (SELECT model, roc_auc, w / sum(w) OVER () AS weight FROM raw)"""
_WEIGHTED = f"""{_WEIGHTS},
ens AS (SELECT doc_id, y, round(sum(weight * score) / sum(weight), 9) AS score FROM test JOIN weights USING (model) GROUP BY doc_id, y)"""


def _sides(spark, sf):
    s = views.scores(spark, sf)
    return s.filter("split = 'val'"), s.filter("split = 'test'")


@query("n1_auc_weights", f"{_WEIGHTS} SELECT model, round(roc_auc, 9) AS roc_auc, round(weight, 9) AS weight FROM weights")
def n1_auc_weights(spark, sf):
    return rounded(ensembles.auc_weights(_sides(spark, sf)[0]))


@query("n2_weighted_average", f"{_WEIGHTED} SELECT doc_id, y, score FROM ens")
def n2_weighted_average(spark, sf):
    val, test = _sides(spark, sf)
    return rounded(ensembles.weighted_average(test, ensembles.auc_weights(val), "doc_id", carry=["y"]))


@query(
    "n2_weighted_average_nulls",
    f"""{_WEIGHTS},
    holes AS (SELECT doc_id, y, model, CASE WHEN {duck.u('hole', 'doc_id', 'model')} >= 0.3 THEN score END AS score FROM test)
    SELECT doc_id, y, round(sum(weight * score) / sum(weight) FILTER (score IS NOT NULL), 9) AS score
    FROM holes JOIN weights USING (model) GROUP BY doc_id, y""",
)
def n2_weighted_average_nulls(spark, sf):
    """Three tenths of the scores are NULL: the mean is over the others."""
    val, test = _sides(spark, sf)
    holes = test.withColumn("score", F.when(uniform("hole", "doc_id", "model") >= 0.3, F.col("score")))
    return rounded(ensembles.weighted_average(holes, ensembles.auc_weights(val), "doc_id", carry=["y"]))


@query(
    "n2_weighted_ensemble_metrics",
    f"""{_WEIGHTED}, {duck.auc('ens', '', 'ea')}, {duck.curve('ens', '', 'curve')},
    best AS (SELECT score AS threshold, tp, fp, n_pos - tp AS fn, n_neg - fp AS tn FROM curve ORDER BY {duck.F1_SCORE} DESC, score LIMIT 1)
    SELECT round((SELECT roc_auc FROM ea), 9) AS roc_auc, threshold, tn, fp, fn, tp, {duck.RATES} FROM best""",
)
def n2_weighted_ensemble_metrics(spark, sf):
    val, test = _sides(spark, sf)
    ens = rounded(ensembles.weighted_average(test, ensembles.auc_weights(val), "doc_id", carry=["y"]))
    return rounded(metrics.model_summary(ens))


@query(
    "n3_pairwise_ensembles",
    f"""WITH {duck.SCORES}, p AS (
      SELECT a.model || '+' || b.model AS pair, a.doc_id, a.y, (a.score + b.score) / 2.0::DOUBLE AS score
      FROM scores a JOIN scores b ON a.doc_id = b.doc_id AND a.model < b.model),
    {duck.auc('p', 'pair')}, {duck.curve('p', 'pair')},
    best AS (
      SELECT pair, round(score, 9) AS threshold, tp, fp, n_pos - tp AS fn, n_neg - fp AS tn FROM curve
      QUALIFY row_number() OVER (PARTITION BY pair ORDER BY {duck.F1_SCORE} DESC, score) = 1)
    SELECT pair, round(roc_auc, 9) AS roc_auc, threshold, tn, fp, fn, tp, {duck.RATES} FROM best JOIN auc USING (pair)""",
)
def n3_pairwise_ensembles(spark, sf):
    return rounded(ensembles.pairwise_ensembles(views.scores(spark, sf), "doc_id"))


@query(
    "n4_moment_match",
    f"""{_V}, b AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd FROM test WHERE model = 'length'),
    t AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd FROM test WHERE model = 'word')
    SELECT doc_id, 1 AS imputed,
           round(greatest(least((v.score - b.mu) / (b.sd + 1e-8::DOUBLE) * t.sd + t.mu, 1), 0), 9) AS score
    FROM val v, b, t WHERE v.model = 'length'""",
)
def n4_moment_match(spark, sf):
    val, test = _sides(spark, sf)

    def of(df, model):
        return df.filter(F.col("model") == model)

    out = ensembles.moment_match(of(val, "length"), of(test, "length"), of(test, "word"))
    return rounded(out.select("doc_id", F.col("imputed").cast("int").alias("imputed"), "score"))


@query(
    "n5_stacked_scores",
    f"""WITH {duck.SCORES} SELECT doc_id, y, split, max(score) FILTER (model = 'comma') AS comma,
    max(score) FILTER (model = 'length') AS length, max(score) FILTER (model = 'word') AS word
    FROM scores GROUP BY doc_id, y, split""",
)
def n5_stacked_scores(spark, sf):
    return ensembles.stacked_scores(views.scores(spark, sf), SCORE_MODELS, "doc_id", carry=["y", "split"])


@query(
    "n6_vote_scores",
    f"""WITH {duck.SCORES} SELECT doc_id, y, max(score) AS max_score,
    CASE WHEN min(score) > 0 THEN round(exp(avg(CASE WHEN score > 0 THEN ln(score) END)), 9)
         WHEN min(score) = 0 THEN 0 END AS geometric_mean FROM scores GROUP BY doc_id, y""",
)
def n6_vote_scores(spark, sf):
    return rounded(ensembles.vote_scores(views.scores(spark, sf), "doc_id", carry=["y"]))


_E2E = f"""WITH {duck.EMB}, {duck.knn('near', 'train', 'query')}, {duck.knn_scored('scored', 'near', 'train', 'query')},
part AS (SELECT vec_id, y, v, CASE WHEN {duck.u('e2e', 'vec_id')} < 0.5 THEN 'val' ELSE 'test' END AS part FROM query),
sims AS (SELECT q.vec_id, r.y AS ry, list_dot_product(q.v, r.v) AS s FROM part q JOIN train r ON true),
rank_s AS (
  SELECT vec_id, greatest(least(0.5::DOUBLE * (coalesce(avg(s) FILTER (ry = 1), 0) - coalesce(avg(s) FILTER (ry = 0), 0) + 1), 1), 0) AS score
  FROM sims GROUP BY vec_id),
known AS (
  SELECT p.vec_id, p.y, p.part, 'knn' AS model, round(s.score, 7) AS score FROM part p JOIN scored s ON s.qid = p.vec_id
  UNION ALL SELECT p.vec_id, p.y, p.part, 'ranking', round(r.score, 7) FROM part p JOIN rank_s r USING (vec_id)
  UNION ALL SELECT vec_id, y, part, 'axis', round((v[1] + 1) / 2, 7) FROM part WHERE part = 'test'),
m_b AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd FROM known WHERE model = 'knn' AND part = 'test'),
m_t AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd FROM known WHERE model = 'axis'),
val AS (
  SELECT vec_id, y, model, score FROM known WHERE part = 'val'
  UNION ALL SELECT vec_id, y, 'axis', round(greatest(least((score - b.mu) / (b.sd + 1e-8::DOUBLE) * t.sd + t.mu, 1), 0), 7)
  FROM known, m_b b, m_t t WHERE model = 'knn' AND part = 'val'),
{duck.auc('val')},
weights AS (
  SELECT model, w / sum(w) OVER () AS weight FROM (SELECT model, greatest(roc_auc - 0.5, 0.01) AS w FROM auc)),
test AS (SELECT vec_id, y, model, score FROM known WHERE part = 'test'),
ens AS (
  SELECT vec_id, y, 'ensemble' AS model, round(sum(weight * score) / sum(weight), 7) AS score
  FROM test JOIN weights USING (model) GROUP BY vec_id, y),
every AS (SELECT * FROM test UNION ALL SELECT vec_id, y, model, score FROM ens),
{duck.auc('every', 'model', 'ea')}, {duck.curve('every')},
best AS (
  SELECT model, score AS threshold, tn, fp, fn, tp FROM (
    SELECT model, score, tp, fp, n_pos - tp AS fn, n_neg - fp AS tn,
           row_number() OVER (PARTITION BY model ORDER BY {duck.F1_SCORE} DESC, score) AS rn FROM curve) WHERE rn = 1)
SELECT model, round(roc_auc, 9) AS roc_auc, threshold, tn, fp, fn, tp, {duck.RATES}, round(coalesce(weight, 1), 9) AS weight
FROM best JOIN ea USING (model) LEFT JOIN weights USING (model)"""


def _evaluated(spark, sf):
    """Scores of three models on val and test rows: neighbours, references, and one with test scores only,
    whose val scores are stand-ins."""
    train, q = views.emb_sides(spark, sf)
    q = q.withColumn("part", F.when(uniform("e2e", "vec_id") < 0.5, "val").otherwise("test"))
    near = scored_queries(neighbors.knn_cosine(train, q, 5), train, q).select(F.col("qid").alias("vec_id"), "score")
    knn = q.select("vec_id", "y", "part").join(near, "vec_id")
    ranking = neighbors.reference_ranking_score(train, q).select("vec_id", "y", "part", "score")
    unit = l2_normalize(F.transform("embedding", lambda x: x.cast("double")))
    axis = q.filter("part = 'test'").select("vec_id", "y", "part", ((unit[0] + 1) / 2).alias("score"))
    known = knn.withColumn("model", F.lit("knn")).unionByName(ranking.withColumn("model", F.lit("ranking")))
    known = materialise(rounded(known.unionByName(axis.withColumn("model", F.lit("axis"))), 7, "score"), "model-scores")

    def of(model, part):
        return known.filter((F.col("model") == model) & (F.col("part") == part))

    moved = ensembles.moment_match(of("knn", "val"), of("knn", "test"), of("axis", "test"))
    stand_in = rounded(moved.withColumn("model", F.lit("axis")).drop("imputed"), 7, "score")
    return known.filter("part = 'val'").unionByName(stand_in), known.filter("part = 'test'")


@query("e2e_evaluation", _E2E)
def e2e_evaluation(spark, sf):
    """The evaluation chain in one query: neighbour and reference scores, a stand-in for a model without val
    scores, weights from val, the weighted mean on test, and every model's metrics beside it."""
    val, test = _evaluated(spark, sf)
    weights = materialise(ensembles.auc_weights(val).select("model", "weight"), "weights")
    ens = rounded(ensembles.weighted_average(test, weights, "vec_id", carry=["y"]), 7, "score")
    rows = test.drop("part").unionByName(ens.withColumn("model", F.lit("ensemble")))
    out = metrics.model_summary(rows, ["model"]).join(weights, "model", "left")
    return rounded(out.withColumn("weight", F.coalesce("weight", F.lit(1.0))))


@query("e2e_meta_learner")
def e2e_meta_learner(spark, sf):
    """The meta-learner fitted on val rows, stand-ins included, with its metrics on test rows."""
    models_ = ["axis", "knn", "ranking"]
    val, test = (ensembles.stacked_scores(d, models_, "vec_id", carry=["y"]) for d in _evaluated(spark, sf))
    fitted = models.fit_meta_learner(materialise(val, "stacked-val"), models_)
    return rounded(metrics.model_summary(models.meta_scores(fitted, test, models_)))
