"""Metrics and cross-validation over the three closed-form scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from originlens.operators import metrics
from originlens.plans import duck, views
from originlens.plans.registry import query
from originlens.plans.views import rounded

_S = f"WITH {duck.SCORES}"


@query("k1_roc_auc", f"{_S}, {duck.auc('scores')} SELECT model, round(roc_auc, 4) AS roc_auc FROM auc")
def k1_roc_auc(spark, sf):
    return metrics.roc_auc(views.scores(spark, sf), ["model"], digits=4)


@query(
    "k2_pr_curve",
    f"""{_S}, {duck.curve('scores')}
    SELECT model, score AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, tp, fp FROM curve""",
)
def k2_pr_curve(spark, sf):
    return rounded(metrics.pr_curve(views.scores(spark, sf), ["model"]))


@query(
    "k3_best_f1_threshold",
    f"""{_S}, {duck.curve('scores')}
    SELECT model, score AS threshold, round(f, 9) AS best_f1
    FROM (SELECT *, {duck.F1_SCORE} AS f FROM curve)
    QUALIFY row_number() OVER (PARTITION BY model ORDER BY f DESC, score) = 1""",
)
def k3_best_f1_threshold(spark, sf):
    return rounded(metrics.best_f1_threshold(views.scores(spark, sf), ["model"]))


@query(
    "k4_threshold_metrics",
    f"""{_S}, c AS (SELECT model, {duck.confusion('>=', '0.5')} FROM scores GROUP BY model),
    d AS (SELECT model, {duck.confusion('>', '0.5')} FROM scores GROUP BY model)
    SELECT 'ge' AS rule, model, tn, fp, fn, tp, {duck.RATES} FROM c
    UNION ALL SELECT 'gt', model, tn, fp, fn, tp, {duck.RATES} FROM d""",
)
def k4_threshold_metrics(spark, sf):
    s = views.scores(spark, sf)
    ge = metrics.threshold_metrics(s, 0.5, ["model"]).withColumn("rule", F.lit("ge"))
    gt = metrics.threshold_metrics(s, 0.5, ["model"], strict=True).withColumn("rule", F.lit("gt"))
    return rounded(ge.unionByName(gt))


_REPORT_ROWS = "\n    UNION ALL ".join(
    f"SELECT model, '{label}' AS label, {p} AS precision, {r} AS recall, {f} AS f1, {n} AS support FROM k"
    for label, p, r, f, n in [
        ("0", "p0", "r0", "f0", "n0"),
        ("1", "p1", "r1", "f1", "n1"),
        ("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "n0 + n1"),
        (
            "weighted avg",
            "(p0 * n0 + p1 * n1) / (n0 + n1)",
            "(r0 * n0 + r1 * n1) / (n0 + n1)",
            "(f0 * n0 + f1 * n1) / (n0 + n1)",
            "n0 + n1",
        ),
    ]
)


@query(
    "k5_classification_report",
    f"""{_S}, c AS (SELECT model, {duck.confusion('>', '0.5')} FROM scores GROUP BY model),
    k AS (SELECT model, {duck.ratio('tn', 'tn + fn')} AS p0, {duck.ratio('tn', 'tn + fp')} AS r0,
          {duck.ratio('2 * tn', '2 * tn + fn + fp')} AS f0, tn + fp AS n0,
          {duck.ratio('tp', 'tp + fp')} AS p1, {duck.ratio('tp', 'tp + fn')} AS r1,
          {duck.ratio('2 * tp', '2 * tp + fn + fp')} AS f1, tp + fn AS n1 FROM c),
    r AS ({_REPORT_ROWS})
    SELECT model, label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r""",
)
def k5_classification_report(spark, sf):
    return rounded(metrics.classification_report(views.scores(spark, sf), 0.5, groups=["model"]))


@query(
    "k6_model_summary",
    f"""{_S}, {duck.auc('scores')}, {duck.curve('scores')},
    best AS (
      SELECT model, score AS threshold, tp, fp, n_pos - tp AS fn, n_neg - fp AS tn FROM curve
      QUALIFY row_number() OVER (PARTITION BY model ORDER BY {duck.F1_SCORE} DESC, score) = 1)
    SELECT model, round(roc_auc, 9) AS roc_auc, threshold, tn, fp, fn, tp, {duck.RATES} FROM best JOIN auc USING (model)""",
)
def k6_model_summary(spark, sf):
    return rounded(metrics.model_summary(views.scores(spark, sf), ["model"])).orderBy(F.col("roc_auc").desc())


@query(
    "k7_cv_report",
    f"""{_S},
    folds AS (
      SELECT doc_id, ({duck.shuffled('cv', 'doc_id', 'y')} - 1) % 5 AS fold FROM (SELECT DISTINCT doc_id, y FROM scores)),
    fs AS (SELECT s.*, f.fold FROM scores s JOIN folds f USING (doc_id)),
    {duck.auc('fs', 'model, fold')},
    c AS (SELECT model, fold, {duck.confusion('>=', '0.5')} FROM fs GROUP BY model, fold),
    m AS (SELECT model, roc_auc AS auc, {duck.ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
          {duck.ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy FROM c JOIN auc USING (model, fold))
    SELECT model, round(avg(auc), 9) AS auc_mean, round(stddev_pop(auc), 9) AS auc_std,
           round(avg(f1), 9) AS f1_mean, round(stddev_pop(f1), 9) AS f1_std,
           round(avg(accuracy), 9) AS accuracy_mean, round(stddev_pop(accuracy), 9) AS accuracy_std
    FROM m GROUP BY model""",
)
def k7_cv_report(spark, sf):
    return rounded(metrics.cv_report(views.scores(spark, sf), "cv", 5, key="doc_id"))


@query(
    "k8_score_stats",
    f"""{_S}
    SELECT model, y, min(score) AS min_score, max(score) AS max_score, round(avg(score), 9) AS mean_score,
           round(stddev_pop(score), 9) AS std_score, count(*) FILTER (score < 0.1) AS n_low,
           count(*) FILTER (score > 0.9) AS n_high, count(score) AS n_scores, round(median(score), 9) AS median_score
    FROM scores GROUP BY model, y""",
)
def k8_score_stats(spark, sf):
    return rounded(metrics.score_stats(views.scores(spark, sf), ["model", "y"]))


@query(
    "k12_error_summary",
    f"""{_S}, c AS (SELECT model, {duck.confusion('>=', '0.5')} FROM scores GROUP BY model)
    SELECT model, fp, fn, fp + fn AS total_errors, round({duck.ratio('fp + fn', 'tn + fp + fn + tp')}, 9) AS error_rate,
           round({duck.ratio('tn', 'tn + fp')}, 9) AS specificity,
           round(({duck.ratio('tn', 'tn + fp')} + {duck.ratio('tp', 'tp + fn')}) / 2, 9) AS balanced_accuracy FROM c""",
)
def k12_error_summary(spark, sf):
    return rounded(metrics.error_summary(views.scores(spark, sf), 0.5, ["model"]))


@query(
    "k13_class_distribution",
    f"WITH {duck.DOCS} SELECT prompt, y, count(*) AS n_rows FROM docs GROUP BY prompt, y",
)
def k13_class_distribution(spark, sf):
    return metrics.class_distribution(views.doc_labels(spark, sf), "y", ["prompt"])


@query(
    "m5_orient_scores",
    f"""{_S}, {duck.auc('scores')}
    SELECT doc_id, model, CAST(roc_auc < 0.5 AS INTEGER) AS flipped,
           CASE WHEN roc_auc < 0.5 THEN -score ELSE score END AS score FROM scores JOIN auc USING (model)""",
)
def m5_orient_scores(spark, sf):
    out = metrics.orient_scores(views.scores(spark, sf), ["model"])
    return out.select("doc_id", "model", F.col("flipped").cast("int").alias("flipped"), "score")
