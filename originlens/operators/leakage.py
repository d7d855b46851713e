"""Leakage checks of a nearest-neighbour detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlens.operators.metrics import roc_auc, score_stats
from originlens.operators.neighbors import (
    distance_by_agreement,
    knn_cosine,
    knn_score,
    neighbour_summary,
)
from originlens.operators.sampling import holdout_permutation, permute_labels
from originlens.session import materialise

# Limits above which a check reports an issue, and the issue texts.
MAX_SHUFFLED_AUC = 0.6
MAX_EXTREME_SHARE = 0.5
MAX_CV_GAP = 0.05
ISSUES = {
    "overlap": "Sample overlap between train and test",
    "shuffled": "High AUC with shuffled labels",
    "extreme": "Too many extreme predictions",
    "gap": "Large gap between CV and test",
}


def scored_queries(neighbours: DataFrame, train: DataFrame, query: DataFrame, key: str = "vec_id", label: str = "y") -> DataFrame:
    """key, mean_distance, positive_ratio, score and the query's own label ``y``.

    The summary, one row per query, is stored: scaling reads it twice, the search runs once."""
    scored = knn_score(materialise(neighbour_summary(neighbours, train, key, label), "neighbour-summary"))
    own = query.select(F.col(key).alias("qid"), F.col(label).alias("y"))
    return scored.join(own, "qid")


def shuffled_label_auc(neighbours: DataFrame, train: DataFrame, query: DataFrame, seed, key: str = "vec_id", label: str = "y") -> DataFrame:
    """AUC of the neighbour score when the train labels are permuted; about 0.5 without leaks.
    The neighbours do not depend on labels, so they are found once for all checks."""
    shuffled = permute_labels(train.select(key, label), seed, label, key, "y_shuffled")
    scored = scored_queries(neighbours, shuffled.select(key, F.col("y_shuffled").alias(label)), query, key, label)
    return roc_auc(scored).select(F.col("roc_auc").alias("shuffled_auc"))


def cv_test_gap(scored: DataFrame, train: DataFrame, seed, k: int = 5, key: str = "vec_id", label: str = "y") -> DataFrame:
    """AUC inside the train set (80 % against 20 %), AUC of the ``scored`` query set, and whether
    they differ by more than 0.05."""
    parts = materialise(holdout_permutation(train, seed, 0.8, key), "holdout")
    a = parts.filter("part = 'train'").drop("part")
    b = parts.filter("part = 'test'").drop("part")
    inner = roc_auc(scored_queries(knn_cosine(a, b, k, key), a, b, key, label))
    outer = roc_auc(scored)
    return inner.select(F.col("roc_auc").alias("internal_cv_auc")).select(
        "internal_cv_auc", outer.scalar().alias("test_auc")
    ).withColumn("gap_flag", F.abs(F.col("internal_cv_auc") - F.col("test_auc")) > MAX_CV_GAP)


def leakage_report(
    overlap: DataFrame, neighbours: DataFrame, train: DataFrame, query: DataFrame, seed, k: int = 5,
    key: str = "vec_id", label: str = "y",
) -> DataFrame:
    """One row: all check values, the list of issues and ``is_safe``. ``overlap`` holds the
    shared samples of train and query."""
    scored = materialise(scored_queries(neighbours, train, query, key, label), "scored")
    stats = score_stats(scored)
    distances = distance_by_agreement(
        scored.select("qid", "mean_distance", "positive_ratio"), query, key, label
    ).select(F.struct("same_class_distance", "diff_class_distance").alias("d"))
    gap = cv_test_gap(scored, train, seed, k, key, label).select(F.struct("*").alias("g"))
    row = stats.select(
        overlap.agg(F.count(F.lit(1))).scalar().alias("sample_overlap"),
        shuffled_label_auc(neighbours, train, query, seed, key, label).scalar().alias("shuffled_auc"),
        distances.scalar().alias("d"),
        gap.scalar().alias("g"),
        F.col("min_score").alias("score_min"),
        F.col("max_score").alias("score_max"),
        F.col("mean_score").alias("score_mean"),
        F.col("std_score").alias("score_std"),
        (F.greatest("n_low", "n_high") > F.col("n_scores") * MAX_EXTREME_SHARE).alias("extreme"),
    ).select("*", "d.*", "g.internal_cv_auc", "g.test_auc", "g.gap_flag").drop("d", "g")
    checks = [
        (F.col("sample_overlap") > 0, "overlap"),
        (F.col("shuffled_auc") > MAX_SHUFFLED_AUC, "shuffled"),
        (F.col("extreme"), "extreme"),
        (F.col("gap_flag"), "gap"),
    ]
    issues = F.filter(F.array(*[F.when(c, F.lit(ISSUES[n])) for c, n in checks]), lambda x: x.isNotNull())
    return row.withColumn("issues", issues).withColumn("is_safe", F.size("issues") == 0).drop("extreme", "gap_flag")
