"""Embeddings and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from originlens.functions.hashing import uniform
from originlens.functions.vectors import l2_normalize
from originlens.operators import metrics, neighbors
from originlens.operators.ann import NeighborIndex
from originlens.operators.leakage import scored_queries
from originlens.plans import duck, views
from originlens.plans.registry import query
from originlens.plans.views import rounded
from originlens.session import materialise, shared_dir


@query(
    "h1_l2_normalize",
    f"""WITH {duck.EMB}
    SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(v[i], 9) AS x
    FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM unit)""",
)
def h1_l2_normalize(spark, sf):
    e = views.table(spark, sf, "embeddings")
    unit = l2_normalize(F.transform("embedding", lambda x: x.cast("double")))
    return rounded(e.select("vec_id", F.posexplode(unit).alias("dim", "x")))


@query(
    "h2_masked_mean_pool",
    f"""WITH e AS (
      SELECT label, CASE WHEN {duck.u('mask', 'vec_id')} < 0.9 THEN 1 ELSE 0 END AS m,
             unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT label, CAST(dim AS INTEGER) AS dim, round(sum(x * m) / greatest(sum(m), 1e-9), 9) AS value
    FROM e GROUP BY label, dim""",
)
def h2_masked_mean_pool(spark, sf):
    e = views.table(spark, sf, "embeddings").withColumn("mask", (uniform("mask", "vec_id") < 0.9).cast("int"))
    return rounded(neighbors.masked_mean_pool(e, "label", "embedding", "mask"))


@query(
    "h3_knn_cosine",
    f"""WITH {duck.EMB}, {duck.knn('near', 'train', 'query')}
    SELECT qid, tid, distance, CAST(rn AS INTEGER) AS rn FROM near""",
)
def h3_knn_cosine(spark, sf):
    train, q = views.emb_sides(spark, sf)
    return neighbors.knn_cosine(train, q, 5)


@query(
    "h3_approximate_recall",
    f"WITH {duck.EMB} SELECT count(*) AS n_queries, 5 * count(*) AS n_neighbours, true AS recall_reached FROM query",
)
def h3_approximate_recall(spark, sf):
    """Recall of the tuned index against the exact search over all queries; 0.9 must be reached."""
    train, q = views.emb_sides(spark, sf)
    train, q = materialise(train, "train"), materialise(q, "query")
    index = NeighborIndex.build(train, shared_dir(spark, "index")).tuned(train)
    found = index.search(q).select("qid", "tid", F.lit(1).alias("hit"))
    exact = neighbors.knn_cosine(train, q, 5)
    both = exact.join(found, ["qid", "tid"], "left")
    return both.agg(
        F.countDistinct("qid").alias("n_queries"),
        F.count(F.lit(1)).alias("n_neighbours"),
        (F.sum("hit") >= F.lit(0.9) * F.count(F.lit(1))).alias("recall_reached"),
    )


_SCORED = f"WITH {duck.EMB}, {duck.knn('near', 'train', 'query')}, {duck.knn_scored('scored', 'near', 'train', 'query')}"


@query(
    "h4_knn_score",
    f"""{_SCORED} SELECT qid, y, round(mean_distance, 9) AS mean_distance,
    round(positive_ratio, 9) AS positive_ratio, round(score, 7) AS score FROM scored""",
)
def h4_knn_score(spark, sf):
    train, q = views.emb_sides(spark, sf)
    scored = scored_queries(neighbors.knn_cosine(train, q, 5), train, q)
    return rounded(rounded(scored, 9, "mean_distance", "positive_ratio"), 7, "score").select(
        "qid", "y", "mean_distance", "positive_ratio", "score"
    )


@query(
    "h5_reference_ranking_score",
    f"""WITH {duck.EMB},
    sims AS (
      SELECT q.vec_id, q.y, r.y AS ry, list_dot_product(q.v, r.v) AS s FROM unit q JOIN train r ON true)
    SELECT vec_id, y, round(greatest(least(0.5::DOUBLE * (coalesce(avg(s) FILTER (ry = 1), 0)
           - coalesce(avg(s) FILTER (ry = 0), 0) + 1), 1), 0), 9) AS score
    FROM sims GROUP BY vec_id, y""",
)
def h5_reference_ranking_score(spark, sf):
    train, _ = views.emb_sides(spark, sf)
    scored = neighbors.reference_ranking_score(train, views.emb(spark, sf))
    return rounded(scored.select("vec_id", "y", "score"))


@query(
    "h6_distance_by_agreement",
    f"""{_SCORED}
    SELECT round(avg(mean_distance) FILTER ((positive_ratio > 0.5) = (y = 1)), 9) AS same_class_distance,
           round(avg(mean_distance) FILTER ((positive_ratio > 0.5) <> (y = 1)), 9) AS diff_class_distance,
           count(*) FILTER ((positive_ratio > 0.5) = (y = 1)) AS n_same,
           count(*) FILTER ((positive_ratio > 0.5) <> (y = 1)) AS n_diff FROM scored""",
)
def h6_distance_by_agreement(spark, sf):
    train, q = views.emb_sides(spark, sf)
    summary = neighbors.neighbour_summary(neighbors.knn_cosine(train, q, 5), train)
    return rounded(neighbors.distance_by_agreement(summary, q))


@query(
    "h7_knn_exclude_self",
    f"""WITH {duck.EMB}, {duck.knn('near', 'unit', 'unit', 5, 'q.vec_id <> t.vec_id')}
    SELECT qid, tid, distance, CAST(rn AS INTEGER) AS rn FROM near""",
)
def h7_knn_exclude_self(spark, sf):
    e = views.emb(spark, sf)
    return neighbors.knn_cosine(e, e, 5, exclude_self=True)


@query(
    "flagship_knn_detector",
    f"""{_SCORED},
    s AS (SELECT y, round(score, 7) AS score FROM scored),
    {duck.auc('s', '', 'auc')}, {duck.curve('s', '', 'curve')},
    best AS (SELECT score AS threshold, tp, fp, n_pos, n_neg FROM curve ORDER BY {duck.F1_SCORE} DESC, score LIMIT 1),
    c AS (SELECT threshold, tp, fp, n_pos - tp AS fn, n_neg - fp AS tn FROM best)
    SELECT (SELECT round(roc_auc, 9) FROM auc) AS roc_auc, threshold, tn, fp, fn, tp, {duck.RATES} FROM c""",
)
def flagship_knn_detector(spark, sf):
    """Split, neighbours, score, AUC, best threshold and metrics at it in one plan."""
    train, q = views.emb_sides(spark, sf)
    scored = rounded(scored_queries(neighbors.knn_cosine(train, q, 5), train, q), 7, "score")
    return rounded(metrics.model_summary(scored))

