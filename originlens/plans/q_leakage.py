"""Leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from originlens.operators import leakage, neighbors
from originlens.plans import duck, views
from originlens.plans.registry import query
from originlens.plans.views import rounded
from originlens.session import materialise

_EMB = duck.EMB.replace("unit AS (", "unit AS MATERIALIZED (")
_NEAR = f"WITH {_EMB}, {duck.knn('near', 'train', 'query')}, {duck.knn_scored('scored', 'near', 'train', 'query')}"
_SHUFFLED = f"""perm AS (
  SELECT a.vec_id, b.y FROM
    (SELECT vec_id, {duck.shuffled('leak/rows', 'vec_id')} AS rn FROM train) a
    JOIN (SELECT y, {duck.shuffled('leak/labels', 'vec_id')} AS rn FROM train) b USING (rn)),
{duck.knn_scored('shuf', 'near', 'perm', 'query', 'l.y')},
shuf9 AS (SELECT y, round(score, 9) AS score FROM shuf), {duck.auc('shuf9', '', 'shuf_auc')}"""
_GAP = f"""ranked AS (SELECT *, {duck.shuffled('leak', 'vec_id')} AS rn, count(*) OVER () AS n FROM train),
ptrain AS (SELECT * FROM ranked WHERE rn <= floor(n * 0.8::DOUBLE)),
pval AS (SELECT * FROM ranked WHERE rn > floor(n * 0.8::DOUBLE)),
{duck.knn('pnear', 'ptrain', 'pval')}, {duck.knn_scored('pscored', 'pnear', 'ptrain', 'pval', 'l.y')},
ps9 AS (SELECT y, round(score, 9) AS score FROM pscored), {duck.auc('ps9', '', 'inner_auc')},
s9 AS (SELECT y, round(score, 9) AS score FROM scored), {duck.auc('s9', '', 'outer_auc')},
gap AS (SELECT (SELECT roc_auc FROM inner_auc) AS internal_cv_auc, (SELECT roc_auc FROM outer_auc) AS test_auc)"""


def _neighbours(spark, sf):
    train, q = views.emb_sides(spark, sf)
    return train, q, materialise(neighbors.knn_cosine(train, q, 5), "neighbours")


@query("k9_shuffled_label_auc", f"{_NEAR}, {_SHUFFLED} SELECT round(roc_auc, 9) AS shuffled_auc FROM shuf_auc")
def k9_shuffled_label_auc(spark, sf):
    train, q, near = _neighbours(spark, sf)
    return rounded(leakage.shuffled_label_auc(near, train, q, "leak"))


@query(
    "k10_cv_test_gap",
    f"""{_NEAR}, {_GAP} SELECT round(internal_cv_auc, 9) AS internal_cv_auc, round(test_auc, 9) AS test_auc,
    CAST(abs(internal_cv_auc - test_auc) > 0.05 AS INTEGER) AS gap_flag FROM gap""",
)
def k10_cv_test_gap(spark, sf):
    train, q, near = _neighbours(spark, sf)
    gap = leakage.cv_test_gap(leakage.scored_queries(near, train, q), train, "leak")
    return rounded(gap.withColumn("gap_flag", F.col("gap_flag").cast("int")))


@query(
    "k11_leakage_report",
    f"""{_NEAR}, {_SHUFFLED}, {_GAP},
    ov AS (SELECT count(*) AS sample_overlap FROM (SELECT DISTINCT md5(CAST(v AS VARCHAR)) FROM train
           INTERSECT SELECT DISTINCT md5(CAST(v AS VARCHAR)) FROM query)),
    r AS (SELECT (SELECT sample_overlap FROM ov) AS sample_overlap, (SELECT roc_auc FROM shuf_auc) AS shuffled_auc,
      avg(mean_distance) FILTER ((positive_ratio > 0.5) = (y = 1)) AS same_class_distance,
      avg(mean_distance) FILTER ((positive_ratio > 0.5) <> (y = 1)) AS diff_class_distance,
      min(score) AS score_min, max(score) AS score_max, avg(score) AS score_mean, stddev_pop(score) AS score_std,
      greatest(count(*) FILTER (score < 0.1), count(*) FILTER (score > 0.9)) > count(*) * 0.5 AS extreme,
      (SELECT internal_cv_auc FROM gap) AS internal_cv_auc, (SELECT test_auc FROM gap) AS test_auc FROM scored)
    SELECT sample_overlap, round(shuffled_auc, 7) AS shuffled_auc, round(same_class_distance, 7) AS same_class_distance,
      round(diff_class_distance, 7) AS diff_class_distance, round(score_min, 7) AS score_min, round(score_max, 7) AS score_max,
      round(score_mean, 7) AS score_mean, round(score_std, 7) AS score_std, round(internal_cv_auc, 7) AS internal_cv_auc,
      round(test_auc, 7) AS test_auc,
      concat_ws('; ', CASE WHEN sample_overlap > 0 THEN 'Sample overlap between train and test' END,
        CASE WHEN shuffled_auc > 0.6 THEN 'High AUC with shuffled labels' END,
        CASE WHEN extreme THEN 'Too many extreme predictions' END,
        CASE WHEN abs(internal_cv_auc - test_auc) > 0.05 THEN 'Large gap between CV and test' END) AS issues,
      CAST(sample_overlap = 0 AND shuffled_auc <= 0.6 AND NOT extreme AND abs(internal_cv_auc - test_auc) <= 0.05 AS INTEGER) AS is_safe
    FROM r""",
)
def k11_leakage_report(spark, sf):
    train, q, near = _neighbours(spark, sf)
    shared = train.select("embedding").intersect(q.select("embedding"))
    report = leakage.leakage_report(shared, near, train, q, "leak")
    return rounded(
        report.withColumn("issues", F.array_join("issues", "; ")).withColumn("is_safe", F.col("is_safe").cast("int")), 7
    )
