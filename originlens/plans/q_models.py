"""Classifiers, the meta-learner and batched scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from originlens.functions.hashing import uniform
from originlens.operators import ensembles, features, kernels, models, packed
from originlens.operators.metrics import model_summary
from originlens.operators.sampling import holdout_permutation
from originlens.plans import duck, views
from originlens.plans.registry import query
from originlens.plans.views import SCORE_MODELS, rounded
from originlens.session import materialise


def _stacked(spark, sf):
    s = views.scores(spark, sf)
    return materialise(
        ensembles.stacked_scores(s, SCORE_MODELS, "doc_id", carry=["y", "split"]), "stacked"
    )


def _feature_table(spark, sf, seed="report"):
    """doc_id, y, part, features: the 100 fixed features of labelled documents.

    The split comes first; the n-gram model and the scaling are learned without the test documents."""
    labels = views.doc_labels(spark, sf).select("doc_id", "y")
    parts = materialise(holdout_permutation(labels, seed, 0.8, "doc_id"), "parts")
    test = parts.filter("part = 'test'").select("doc_id")
    texts = views.texts(spark, sf)
    model = packed.Corpus.make(texts.join(test, "doc_id", "left_anti"), "doc_id")
    asked = texts.join(parts.select("doc_id"), "doc_id", "left_semi")
    rows = packed.by_key(packed.vectors(asked, "doc_id", model), asked.select("doc_id"), "doc_id", every=False)
    long = materialise(features.custom_features(rows, "doc_id"), "features")
    z = features.zscore(long, long.join(test, "doc_id", "left_anti"), ["series", "stat"])
    z = z.select("doc_id", "series", "stat", F.col("z").alias("value"))
    return materialise(features.feature_matrix(z, "doc_id").join(parts, "doc_id"), "matrix")


def _score_features(spark, sf):
    """doc_id, y, split, features: the three scores as a small feature table."""
    return _stacked(spark, sf).select("doc_id", "y", "split", F.array(*SCORE_MODELS).alias("features"))


@query("m1_fit_meta_learner")
def m1_fit_meta_learner(spark, sf):
    """Fit on val rows; coefficients beside the AUC and best-F1 metrics on test rows."""
    s = _stacked(spark, sf)
    model = models.fit_meta_learner(s.filter("split = 'val'"), SCORE_MODELS)
    scored = models.meta_scores(model, s.filter("split = 'test'"), SCORE_MODELS)
    coefficients = models.meta_coefficients(model, SCORE_MODELS, spark)
    as_map = coefficients.agg(F.map_from_entries(F.collect_list(F.struct("model", "coefficient"))))
    return model_summary(scored).withColumn("coefficients", as_map.scalar())


@query(
    "m1_meta_gradient",
    "SELECT model, 0.0::DOUBLE AS gradient FROM (VALUES ('comma'), ('length'), ('word'), ('(intercept)')) t(model)",
)
def m1_meta_gradient(spark, sf):
    """The gradient at the meta-learner's coefficients, which is zero at the optimum."""
    val = _stacked(spark, sf).filter("split = 'val'")
    model = models.fit_meta_learner(val, SCORE_MODELS)
    g = models.meta_gradient(model, val, SCORE_MODELS)
    return g.select("model", (F.round("gradient", 4) + F.lit(0.0)).alias("gradient"))


@query(
    "m2_knn_classifier",
    f"""WITH {duck.SCORES},
    wide AS (
      SELECT doc_id AS vec_id, y, split, [max(score) FILTER (model = 'comma'), max(score) FILTER (model = 'length'),
             max(score) FILTER (model = 'word')] AS v FROM scores GROUP BY doc_id, y, split),
    unit AS (
      SELECT vec_id, y, split, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM wide),
    train AS (SELECT * FROM unit WHERE split = 'val'), query AS (SELECT * FROM unit WHERE split = 'test'),
    {duck.knn('near', 'train', 'query')}
    SELECT qid AS doc_id, round(avg(t.y::DOUBLE), 9) AS score FROM near JOIN train t ON t.vec_id = tid GROUP BY qid""",
)
def m2_knn_classifier(spark, sf):
    """The share of positives among the five nearest train rows by three scores."""
    f = _score_features(spark, sf)
    fitted = models.fit_classifier("knnc", f.filter("split = 'val'"), key="doc_id", c=5.0)
    return rounded(fitted.score(f.filter("split = 'test'")).select("doc_id", "score"))


@query("m2_fit_classifier")
def m2_fit_classifier(spark, sf):
    """Scores of every kind of classifier on the test rows, long form."""
    f = _score_features(spark, sf)
    train, test = f.filter("split = 'val'"), f.filter("split = 'test'")
    out = None
    for kind, fitted in models.fit_classifiers(models.KINDS, train, key="doc_id").items():
        part = fitted.score(test).select("doc_id", "y", F.lit(kind).alias("model"), "score")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "m2_svr_gradient",
    "SELECT CAST(unnest(range(65)) AS INTEGER) AS weight, 0.0::DOUBLE AS gradient",
)
def m2_svr_gradient(spark, sf):
    """The mean gradient at the weights of a support-vector regression, which is zero at the optimum."""
    train = _score_features(spark, sf).filter("split = 'val'")
    g = kernels.svr_gradient(kernels.fit_svr(train, components=64), train)
    return g.select("weight", (F.round("gradient", 3) + F.lit(0.0)).alias("gradient"))


@query(
    "m2_svc_probabilities",
    f"WITH {duck.SCORES} SELECT DISTINCT doc_id, true AS in_range FROM scores WHERE split = 'test'",
)
def m2_svc_probabilities(spark, sf):
    """Every test row gets a probability from the kernel classifier."""
    f = _score_features(spark, sf)
    fitted = models.fit_classifier("svc", f.filter("split = 'val'"), key="doc_id")
    return fitted.score(f.filter("split = 'test'")).select("doc_id", F.col("score").between(0.0, 1.0).alias("in_range"))


@query("m3_calibrated")
def m3_calibrated(spark, sf):
    f = _score_features(spark, sf)
    fitted = models.calibrated("log_reg", f.filter("split = 'val'"), "cal", key="doc_id")
    return fitted.score(f.filter("split = 'test'")).select("doc_id", "y", "score")


def make_comma_logit():
    """A plug-in scorer: log-odds from the share of commas in a text."""

    def predict(texts: np.ndarray) -> np.ndarray:
        flat = np.asarray(texts).reshape(-1)
        return np.array([20.0 * t.count(",") / max(len(t), 1) - 0.25 for t in flat], dtype="float64")

    return predict


@query(
    "m4_score_batches",
    f"""WITH t AS (SELECT doc_id, CASE WHEN {duck.u('null', 'doc_id')} >= 0.1 THEN text END AS text FROM documents),
    z AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN
            20.0::DOUBLE * (length(text) - length(replace(text, ',', '')))::DOUBLE / greatest(length(text), 1)::DOUBLE - 0.25 END AS z FROM t)
    SELECT doc_id, round(1.0 / (1.0 + exp(-z)), 9) AS score FROM z""",
)
def m4_score_batches(spark, sf):
    """A tenth of the texts is blanked to NULL and must come out with a NULL score."""
    d = views.texts(spark, sf).withColumn("text", F.when(uniform("null", "doc_id") >= 0.1, F.col("text")))
    return rounded(models.score_batches(d, make_comma_logit).select("doc_id", "score"))


@query("m6_holdout_report")
def m6_holdout_report(spark, sf):
    """Logistic regression on the 100 fixed features, four fifths against one fifth."""
    return models.holdout_report("log_reg", _feature_table(spark, sf), "report", key="doc_id")
