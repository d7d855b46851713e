"""Classifiers on feature tables (Spark ML) and batched scoring with plug-in models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LinearSVC, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originlens.operators.kernels import fit_svc, fit_svr
from originlens.operators.metrics import roc_auc, threshold_metrics
from originlens.operators.neighbors import knn_cosine, neighbour_summary
from originlens.operators.sampling import holdout_permutation, stratified_kfold
from originlens.session import materialise

KINDS = ["log_reg", "svc", "linear_svc", "svr", "elastic", "sgd", "rfc", "knnc", "vote"]
VOTERS = ["svc", "rfc"]
MIN_META_MODELS = 2
FOREST_DEPTH = 30  # the deepest trees Spark grows


def as_vectors(df: DataFrame, features: str, out: str = "features_vec") -> DataFrame:
    """Feature arrays as ML vectors."""
    return df.withColumn(out, array_to_vector(F.col(features)))


def fit_meta_learner(stacked: DataFrame, models: list[str], label: str = "y", c: float = 1.0, max_iter: int = 1000):
    """L2 logistic regression over one score column per model, or None for fewer than two.

    ``C`` weighs the summed loss against the penalty; Spark averages the loss, hence
    ``regParam = 1 / (C n)``. The fit needs complete rows; :func:`incomplete_rows` counts the others.
    """
    if len(models) < MIN_META_MODELS:
        return None
    rows = stacked.dropna(subset=[*models, label])
    assembled = VectorAssembler(inputCols=models, outputCol="features_vec").transform(rows)
    return _logistic(assembled, label, c, max_iter)


def _logistic(df: DataFrame, label: str, c: float, max_iter: int):
    n = df.count()
    return LogisticRegression(
        featuresCol="features_vec", labelCol=label, maxIter=max_iter, regParam=1.0 / (c * max(n, 1)),
        elasticNetParam=0.0, standardization=False, tol=1e-9,
    ).fit(df)


def load_meta_learner(path: str) -> LogisticRegressionModel:
    """A meta-learner that was written by its ``save(path)``."""
    return LogisticRegressionModel.load(path)


def incomplete_rows(stacked: DataFrame, models: list[str]) -> DataFrame:
    """One row: ``n_rows``, and ``n_incomplete`` of them that lack a model's score."""
    lacks = reduce(lambda a, b: a | b, [F.col(m).isNull() for m in models])
    return stacked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(lacks).alias("n_incomplete"))


def meta_coefficients(model, models: list[str], spark) -> DataFrame:
    """model, ``coefficient``; the intercept is the row ``(intercept)``."""
    rows = [*zip(models, [float(x) for x in model.coefficients]), ("(intercept)", float(model.intercept))]
    return spark.createDataFrame(rows, "model string, coefficient double")


def meta_gradient(model, stacked: DataFrame, models: list[str], label: str = "y", c: float = 1.0) -> DataFrame:
    """model, ``gradient``: the mean gradient of the penalised loss at the fitted coefficients, on the rows
    of the fit. All are near 0 if the fit has converged."""
    rows = meta_scores(model, stacked.dropna(subset=[*models, label]), models)
    off = F.col("score") - F.col(label)
    n = F.count(F.lit(1))
    w = [float(x) for x in model.coefficients]
    parts = [F.struct(F.lit(m).alias("model"), ((F.sum(off * F.col(m)) + F.lit(x / c)) / n).alias("gradient")) for m, x in zip(models, w)]
    parts.append(F.struct(F.lit("(intercept)").alias("model"), (F.sum(off) / n).alias("gradient")))
    return rows.agg(F.array(*parts).alias("g")).select(F.inline("g"))


def meta_scores(model, stacked: DataFrame, models: list[str]) -> DataFrame:
    """Add ``score``, the positive-class probability; NULL for a row that lacks a model's score."""
    lacks = reduce(lambda a, b: a | b, [F.col(m).isNull() for m in models])
    assembled = VectorAssembler(inputCols=models, outputCol="features_vec", handleInvalid="keep").transform(stacked)
    out = model.transform(assembled).withColumn("score", F.when(~lacks, vector_to_array("probability")[1]))
    return out.drop("features_vec", "rawPrediction", "probability", "prediction")


class FittedClassifier:
    """A fitted model that adds a ``score`` column to rows with ``features`` arrays."""

    def __init__(self, kind: str, scorer):
        self.kind = kind
        self._scorer = scorer

    def score(self, df: DataFrame) -> DataFrame:
        return self._scorer(df)


def _drop_ml(df: DataFrame) -> DataFrame:
    return df.drop("features_vec", "rawPrediction", "probability", "prediction")


def fit_classifier(
    kind: str, train: DataFrame, label: str = "y", features: str = "features", key: str = "id", c: float = 1.0, margins: bool = False
) -> FittedClassifier:
    """Fit one of :data:`KINDS` on ``train``.

    ``svc`` and ``svr`` have a Gaussian kernel (:mod:`kernels`); ``svc`` gives probabilities, or margins if ``margins``, and ``svr`` values.
    ``linear_svc`` is a hinge-loss fit on the features themselves, ``sgd`` a least-squares fit without penalty and
    ``elastic`` one with both penalties, ``knnc`` uses cosine distance and ``C`` neighbours, and ``vote``
    averages the probabilities of ``svc`` and ``rfc``.
    """
    if kind in ("svc", "svr"):
        machine = fit_svc(train, label, features, key, c, cv=0 if margins else 5) if kind == "svc" else fit_svr(train, label, features, c)
        return FittedClassifier(kind, lambda df: machine.score(df, features))
    v = as_vectors(train, features)
    if kind == "log_reg":
        model = _logistic(v, label, c, 1000)

        def score(df):
            return _drop_ml(
                model.transform(as_vectors(df, features)).withColumn("score", vector_to_array("probability")[1])
            )
    elif kind == "linear_svc":
        n = v.count()
        model = LinearSVC(
            featuresCol="features_vec", labelCol=label, regParam=1.0 / (c * max(n, 1)), standardization=False
        ).fit(v)

        def score(df):
            margin = vector_to_array("rawPrediction")[1]
            return _drop_ml(
                model.transform(as_vectors(df, features)).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))
            )
    elif kind in ("elastic", "sgd"):
        model = LinearRegression(
            featuresCol="features_vec", labelCol=label, regParam=1.0 if kind == "elastic" else 0.0,
            elasticNetParam=0.5 if kind == "elastic" else 0.0, standardization=False, solver="l-bfgs" if kind == "sgd" else "auto",
        ).fit(v)

        def score(df):
            return _drop_ml(model.transform(as_vectors(df, features)).withColumn("score", F.col("prediction")))
    elif kind == "rfc":
        model = RandomForestClassifier(
            featuresCol="features_vec", labelCol=label, numTrees=100, maxDepth=FOREST_DEPTH, maxBins=100, seed=42,
            cacheNodeIds=True,  # the same trees; no level walks down from the roots again
        ).fit(v)

        def score(df):
            return _drop_ml(
                model.transform(as_vectors(df, features)).withColumn("score", vector_to_array("probability")[1])
            )
    elif kind == "knnc":
        k = max(int(c), 1)

        def score(df):
            near = knn_cosine(train, df, k, key, features)
            ratio = neighbour_summary(near, train, key, label).select(
                F.col("qid").alias(key), F.col("positive_ratio").alias("score")
            )
            return df.join(ratio, key)
    elif kind == "vote":
        return voted(*[fit_classifier(k, train, label, features, key, c) for k in VOTERS])
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    return FittedClassifier(kind, score)


def voted(first: FittedClassifier, second: FittedClassifier) -> FittedClassifier:
    """The mean of the scores of two fitted classifiers."""

    def score(df: DataFrame) -> DataFrame:
        one = first.score(df).withColumnRenamed("score", "_a")
        return second.score(one).withColumn("score", (F.col("_a") + F.col("score")) / F.lit(2.0)).drop("_a")

    return FittedClassifier("vote", score)


def fit_classifiers(
    kinds: list[str], train: DataFrame, label: str = "y", features: str = "features", key: str = "id", c: float = 1.0, neighbours: int = 5
) -> dict[str, FittedClassifier]:
    """Each of ``kinds`` fitted on ``train``; ``vote`` takes the members that are among them, so that none is fitted twice."""
    fitted: dict[str, FittedClassifier] = {}

    def fit(kind: str) -> FittedClassifier:
        if kind not in fitted:
            if kind == "vote":
                fitted[kind] = voted(*[fit(k) for k in VOTERS])
            else:
                fitted[kind] = fit_classifier(kind, train, label, features, key, neighbours if kind == "knnc" else c)
        return fitted[kind]

    return {kind: fit(kind) for kind in kinds}


def calibrated(
    kind: str, train: DataFrame, seed, cv: int = 5, label: str = "y", features: str = "features", key: str = "id", c: float = 1.0
) -> FittedClassifier:
    """Out-of-fold sigmoid calibration: per fold a model fitted on the others and a
    one-feature logistic regression on its held-out scores; predictions are averaged."""
    folds = materialise(stratified_kfold(train, seed, cv, label, key), "folds")
    members = []
    for fold in range(cv):
        base = fit_classifier(kind, folds.filter(F.col("fold") != fold).drop("fold"), label, features, key, c, margins=True)
        held = base.score(folds.filter(F.col("fold") == fold))
        sigmoid = LogisticRegression(featuresCol="features_vec", labelCol=label, regParam=0.0).fit(
            as_vectors(held.withColumn("_one", F.array("score")), "_one")
        )
        members.append((base, float(sigmoid.coefficients[0]), float(sigmoid.intercept)))

    def score(df: DataFrame) -> DataFrame:
        names = []
        for i, (base, a, b) in enumerate(members):
            z = F.lit(a) * F.col("score") + F.lit(b)
            df = base.score(df).withColumn(f"_p{i}", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).drop("score")
            names.append(f"_p{i}")
        mean = reduce(lambda x, y: x + y, [F.col(n) for n in names]) / F.lit(float(cv))
        return df.withColumn("score", mean).drop(*names)

    return FittedClassifier(f"calibrated {kind}", score)


def holdout_report(
    kind: str, df: DataFrame, seed, label: str = "y", features: str = "features", key: str = "id", c: float = 1.0,
    calibrate: bool = False,
) -> DataFrame:
    """kind, F1, accuracy, AUC (rounded to 3) on the held-out fifth.

    ``df`` may have a column ``part`` (train, test) already: features that are themselves learned must
    come from train rows, so the split comes before them."""
    parts = materialise(df if "part" in df.columns else holdout_permutation(df, seed, 0.8, key), "holdout")
    train = parts.filter("part = 'train'").drop("part")
    test = parts.filter("part = 'test'").drop("part")
    model = (
        calibrated(kind, train, seed, 5, label, features, key, c) if calibrate
        else fit_classifier(kind, train, label, features, key, c)
    )
    scored = model.score(test).select(key, "score", label)
    at_half = threshold_metrics(scored, 0.5, None, "score", label, strict=True)
    auc = roc_auc(scored, None, "score", label)
    return at_half.select(
        F.lit(kind).alias("model"),
        F.round("f1", 3).alias("f1"),
        F.round("accuracy", 3).alias("accuracy"),
        F.round(auc.scalar(), 3).alias("auc"),
    )


def score_batches(df: DataFrame, make_logit_fn, text: str = "text", batch_size: int = 64) -> DataFrame:
    """Add ``score = sigmoid(logit)`` from a plug-in model; a NULL text gets a NULL score.

    ``make_logit_fn()`` runs once per Python worker and returns a function from an array of
    texts to an array of logits. Batches travel as Arrow; whole texts are passed on.
    """
    logit = predict_batch_udf(make_logit_fn, return_type=T.DoubleType(), batch_size=batch_size)
    z = logit(F.coalesce(F.col(text), F.lit("")))
    score: Column = F.when(F.col(text).isNull(), F.lit(None).cast("double")).otherwise(
        F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z")))
    )
    return df.withColumn("_z", z).withColumn("score", score).drop("_z")

