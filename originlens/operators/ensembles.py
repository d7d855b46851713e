"""Combining the scores of several models, in long form (key, model, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlens.operators.metrics import model_summary, roc_auc

MIN_WEIGHT = 0.01


def auc_weights(val: DataFrame, model: str = "model", score: str = "score", label: str = "y") -> DataFrame:
    """model, ``weight``: AUC above chance, at least 0.01, scaled to sum to 1."""
    raw = roc_auc(val, [model], score, label).withColumn(
        "_w", F.greatest(F.col("roc_auc") - F.lit(0.5), F.lit(MIN_WEIGHT))
    )
    return raw.select(model, "roc_auc", (F.col("_w") / raw.agg(F.sum("_w")).scalar()).alias("weight"))


def weighted_average(scores: DataFrame, weights: DataFrame, key: str = "id", model: str = "model", score: str = "score", carry: list[str] | None = None) -> DataFrame:
    """key, ``score``: the weighted mean over the models of a key.

    There is one weight per model, so the weights go in as one map; joining on the model would
    shuffle all scores onto a handful of keys. A NULL score takes no part in its key's mean, nor does its
    weight; a key with NULL scores only gets NULL. A model without a weight is an error."""
    by_model = weights.agg(F.map_from_entries(F.collect_list(F.struct(model, "weight"))))
    found = F.try_element_at(by_model.scalar(), F.col(model))
    lacking = F.raise_error(F.concat(F.lit("no weight for model "), F.coalesce(F.col(model), F.lit("NULL"))))
    w = scores.withColumn("_w", F.coalesce(found, lacking.cast("double")))
    mean = F.sum(F.col("_w") * F.col(score)) / F.sum(F.when(F.col(score).isNotNull(), F.col("_w")))
    return w.groupBy(key, *(carry or [])).agg(mean.alias("score"))


def pairwise_scores(scores: DataFrame, key: str = "id", model: str = "model", score: str = "score", label: str = "y") -> DataFrame:
    """``pair``, key, label, ``score``: the mean of each unordered pair of models.

    A key's models are gathered once and paired inside the row (a handful of models), so the
    scores are shuffled once and there is no join."""
    m = F.sort_array(F.collect_list(F.struct(F.col(model).alias("m"), F.col(score).alias("s"))))
    rows = scores.groupBy(key, label).agg(m.alias("_m"))
    pairs = F.flatten(
        F.transform(
            "_m",
            lambda a: F.transform(
                F.filter("_m", lambda b: b["m"] > a["m"]),
                lambda b: F.struct(
                    F.concat(a["m"], F.lit("+"), b["m"]).alias("pair"),
                    ((a["s"] + b["s"]) / F.lit(2.0)).alias("score"),
                ),
            ),
        )
    )
    return rows.select(key, label, F.inline(pairs))


def pairwise_ensembles(scores: DataFrame, key: str = "id", model: str = "model", score: str = "score", label: str = "y") -> DataFrame:
    """Metrics of every pairwise mean."""
    return model_summary(pairwise_scores(scores, key, model, score, label), ["pair"], "score", label)


def moment_match(base: DataFrame, base_test: DataFrame, target_test: DataFrame, score: str = "score") -> DataFrame:
    """Stand-in scores for a model with test scores only: a base model's scores moved to the
    target's test mean and deviation, clipped to [0, 1] and flagged ``imputed``."""
    def moments(df: DataFrame):
        return df.select(score).agg(
            F.struct(F.avg(score).alias("mu"), F.stddev_pop(score).alias("sd")).alias("m")
        )

    d = base.withColumn("_b", moments(base_test).scalar()).withColumn("_t", moments(target_test).scalar())
    moved = (F.col(score) - F.col("_b.mu")) / (F.col("_b.sd") + F.lit(1e-8)) * F.col("_t.sd") + F.col("_t.mu")
    clipped = F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))
    return d.withColumn(score, clipped).withColumn("imputed", F.lit(True)).drop("_b", "_t")


def stacked_scores(scores: DataFrame, models: list[str], key: str = "id", model: str = "model", score: str = "score", carry: list[str] | None = None) -> DataFrame:
    """Wide table: one column per model."""
    return scores.groupBy(key, *(carry or [])).pivot(model, models).agg(F.max(score))


def vote_scores(scores: DataFrame, key: str = "id", score: str = "score", carry: list[str] | None = None) -> DataFrame:
    """key, ``max_score`` and ``geometric_mean`` over the models; the latter is NULL for keys with a
    negative score, for which it is not defined, and 0 for keys with a score of 0."""
    s = F.col(score)
    mean = F.exp(F.avg(F.when(s > 0, F.ln(s))))
    return scores.groupBy(key, *(carry or [])).agg(
        F.max(score).alias("max_score"),
        F.when(F.min(s) > 0, mean).when(F.min(s) == 0, F.lit(0.0)).alias("geometric_mean"),
    )
